"""Searches with more queries than fit a matrix: scored by classes and blocks, no rows for pairs."""

import random

import pytest
from pyspark.sql import functions as F

from rankspark.operators import lexical, rerank, vector
from rankspark.plans import search as plan


def rows_of(frame):
    return sorted((r.query_id, r.rank, r.id, r.score, tuple(r.matched_terms)) for r in frame.collect())


@pytest.mark.parametrize("scoped", [False, True])
def test_classes_equal_matrix(spark, monkeypatch, scoped):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(12)]
    docs = [(k, [rng.choice(words) for _ in range(rng.randint(0, 5))] + [f"own{k}"]) for k in range(200)]
    docs += [(1000 + k, docs[k % 7][1][:-1] + [f"own{1000 + k}"]) for k in range(90)]  # classes larger than the limit
    asked = [(q, rng.sample(words, rng.randint(0, 4)) + ["nowhere"] + (["own3"] if q % 9 == 0 else [])) for q in range(60)]
    docs = spark.createDataFrame(docs, "id long, tokens array<string>").repartition(5)
    asked = spark.createDataFrame(asked, "query_id long, terms array<string>")
    if scoped:
        docs = docs.withColumn("scope", F.explode(F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
        asked = asked.withColumn("scope", F.when(F.col("query_id") % 2 == 0, "a").otherwise("b"))
    want = rows_of(lexical.bm25(asked, docs, 6))
    monkeypatch.setattr(lexical, "MATRIX_QUERIES", 10)
    assert rows_of(lexical.bm25(asked, docs, 6)) == want and len(want) > 200
    if not scoped:
        stats = lexical.term_statistics(docs, lexical.query_term_rows(asked), False)
        assert rows_of(lexical.bm25(asked, lexical.postings(docs), 6, statistics=stats)) == want


def test_many_alike_queries_make_no_pairs(spark, monkeypatch):
    """What is summed are the parts of one class for one leader, whatever the number of documents and of queries."""
    monkeypatch.setattr(lexical, "MATRIX_QUERIES", 10)
    seen = []
    monkeypatch.setattr(lexical, "dealt_by", lambda frame, *keys: seen.append(frame) or frame)
    docs = spark.range(2000).select("id", F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.array(F.lit("a"), F.lit("b")).alias("terms"))
    found = lexical.bm25(asked, docs, 5)
    assert found.count() == 1500 and [r.id for r in found.where("query_id = 7").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert seen[-1].count() == 2


def test_single_precision_only_screens(spark):
    """Scores that differ by less than single precision tells apart are ranked as in double precision."""
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.standard_normal(48)
    pool = base + rng.standard_normal((700, 48)) * 3e-4
    pool[500:600] = pool[3]  # ties
    asked = base + rng.standard_normal((5, 48)) * 0.3
    got = vector._kernel(20, 6)(np.arange(5), asked, np.arange(700), pool)
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    exact = np.round(unit(asked) @ unit(pool).T, 6)
    order = np.argsort(-exact, axis=1, kind="stable")[:, :20]
    assert (got[1].reshape(5, 20) == order).all()
    assert np.abs(got[2].reshape(5, 20) - np.take_along_axis(exact, order, 1)).max() < 1e-9


def test_blocks_are_not_dealt_by_scope(spark, tmp_path):
    """All rows may be in one scope: a shuffle by it would send them through one task."""
    spark.range(300).select("id", F.array(F.col("id") % 7 + 1.0, F.col("id") % 5 - 2.0).alias("embedding")).write.parquet(f"{tmp_path}/v")
    pool = spark.read.parquet(f"{tmp_path}/v")
    found = vector.vector_topk(pool.withColumnRenamed("id", "query_id"), pool, 4, sent_queries=0)
    dealt = found._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(scope#")[1:]
    assert dealt and all("qb#" in part.split(")")[0] for part in dealt)
    assert found.count() == 1200


def test_rejects_are_dropped_after_parsing(spark, monkeypatch, tmp_path):
    """A filter on what is parsed would be moved below the spreading of the customers over the cores."""
    from registered import searches

    spark.createDataFrame([(k, f"Customer#{k:09d}", k % 3, 1.0, "BUILDING") for k in range(40)],
                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
                          ).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    seen, write = [], searches.written
    monkeypatch.setattr(searches, "written", lambda frame: seen.append(frame) or write(frame))
    kept = searches.people_profiles(spark, str(tmp_path))
    lines = seen[0]._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any(line.lstrip(" +-:").startswith("Filter") for line in lines)
    assert "reject_reason" not in kept.columns and 0 < kept.count() < 40


def test_many_rows_read_headlines_once_a_profile(spark, monkeypatch):
    engine = plan.Engine(None)
    profiles = spark.createDataFrame([(1, "Data Scientist"), (2, None)], "id long, headline string")
    profiles = plan.as_profiles(profiles)
    prepared = spark.sql("select 5L as query_id, 'x' as parsed, 'y' as filters")
    fused = spark.createDataFrame([(5, 1), (5, 2)], "query_id long, id long")
    monkeypatch.setattr(rerank, "intent_of", lambda parsed, filters: parsed)
    few = plan._with_profiles(fused, prepared, profiles, True, engine)
    monkeypatch.setattr(plan, "rows_at_most", lambda *_: False)
    many = plan._with_profiles(fused, prepared, profiles, True, engine)
    pick = lambda f: sorted((r.id, str(r.own_family)) for r in f.select("id", "own_family").collect())
    assert pick(few) == pick(many) == [(1, "data scientist"), (2, "None")]
