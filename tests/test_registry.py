"""The driver's contract, and streams and job matching on small tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_oracles_parse():
    import duckdb

    con = duckdb.connect()
    if not os.path.isdir(DATA):
        pytest.skip("test tables are not here")
    from registered.common import TABLES

    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    for name, sql in entry.oracle_sql().items():
        assert con.sql(f"explain {sql}") is not None, name


@needs_data
def test_two_batches_of_ingestion(spark, tmp_path):
    """A text that comes again in a later batch makes no second profile."""
    from rankspark.operators.embedding import hash_embedder
    from rankspark.streaming import jobs
    from registered import common as c

    kind = "id long, text string"
    texts = [(k, f"The profile of person {k}, a r programmer of many things.") for k in range(6)]
    for batch in range(2):
        spark.createDataFrame(texts[batch * 2: batch * 2 + 4], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.ingest_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"),
                           c.PROSE, hash_embedder(c.PROSE, digest="md5")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "profiles")).select("id", "batch").collect()
    assert sorted((r.id, r.batch) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
