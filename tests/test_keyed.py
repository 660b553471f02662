"""Tables changed in place, and streams that keep one row of each content."""

import os

from pyspark.sql import functions as F

from rankspark.operators.embedding import hash_embedder
from rankspark.sources.keyed import KeyedTable
from rankspark.streaming import jobs
from registered import common as c


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, value string, part string")


def state(stored):
    return {r["id"]: r["value"] for r in stored.rows().collect()}


def test_only_touched_folders_are_rewritten(spark, tmp_path):
    stored = KeyedTable(spark, str(tmp_path / "t"), "id bigint, value string", partitions=8)
    assert stored.rows().count() == 0 and stored.lookup(table(spark, [(1, "", "")])).count() == 0
    stored.upsert(table(spark, [(i, f"v{i}", "x") for i in range(400)]))
    before = files(tmp_path / "t" / "rows")
    stored.upsert(table(spark, [(7, "new", "x"), (7, "later", "x"), (None, "lost", "x")]))
    after = files(tmp_path / "t" / "rows")
    folders = {os.path.dirname(f) for f in before ^ after}
    assert len(folders) == 1 and len(before & after) == len(before) - 1
    want = {i: f"v{i}" for i in range(400)} | {7: "new"}
    assert state(stored) == want
    stored.delete(table(spark, [(8, "", ""), (9999, "", "")]))
    want.pop(8)
    assert state(stored) == want
    got = stored.lookup(table(spark, [(7, "", ""), (8, "", ""), (9, "", ""), (9, "", "")]))
    assert {(r["id"], r["value"]) for r in got.collect()} == {(7, "new"), (9, "v9")}
    assert "part" in got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1][:40]


def test_folders_may_run_empty_and_fill_again(spark, tmp_path):
    stored = KeyedTable(spark, str(tmp_path / "t"), "id bigint, value string", partitions=3)
    rows = table(spark, [(i, "a", "") for i in range(10)])
    stored.upsert(rows)
    stored.delete(rows)
    assert state(stored) == {} and stored.lookup(rows).count() == 0
    stored.upsert(table(spark, [(3, "b", ""), (3, "c", "")]), prefer="value")
    assert state(stored) == {3: "b"}


def test_three_batches_keep_the_first_and_smallest(spark, tmp_path):
    """Rows, not counts: the smallest id of a content in the first batch that has it."""
    source = tmp_path / "in"
    source.mkdir()

    def arrive(name, rows):
        frame = spark.createDataFrame(rows, "id string, text string")
        frame.coalesce(1).write.parquet(str(tmp_path / name))
        part = next(f for f in files(tmp_path / name))
        os.rename(part, source / f"{name}.parquet")
        stream = spark.readStream.schema("id string, text string").parquet(str(source))
        jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "check"), c.PROSE, hash_embedder(c.PROSE, digest="md5")).awaitTermination()

    def text(word):
        return f"this is the text of the {word} and it is long enough to be kept"

    arrive("one", [("5", text("first")), ("3", text("first")), ("4", text("second"))])
    arrive("two", [("1", text("first")), ("9", text("third")), ("8", text("third")), ("2", "short")])
    arrive("three", [("0", text("third")), ("7", text("fourth")), ("6", text("second"))])
    kept = spark.read.parquet(str(tmp_path / "out" / "profiles"))
    assert {(r["id"], r["batch"]) for r in kept.select("id", "batch").collect()} == {("3", 0), ("4", 0), ("8", 1), ("7", 2)}
    assert spark.read.parquet(str(tmp_path / "out" / "vectors")).select("id").distinct().count() == 4
    assert spark.read.parquet(str(tmp_path / "out" / "hashes" / "rows")).where(F.col("content_hash").isNotNull()).count() == 4
