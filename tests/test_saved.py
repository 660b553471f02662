"""Saved searches re-run on what is new against full runs; stored runs and job descriptions."""

import random

from pyspark.sql import functions as F

from rankspark.operators.embedding import hash_embedder
from rankspark.plans.saved import SavedSearches, store_jobs, store_run
from rankspark.plans.search import Engine
from rankspark.operators import vector
from rankspark.sources.tables import latest
from registered import common as c

ENGINE = Engine(c.SAMPLE, hash_embedder(c.SAMPLE, digest="md5"))
WORDS = [f"word{k}" for k in range(30)]


def vectors(spark, pool):
    rows = spark.createDataFrame([(i, t, v) for i, (t, v) in pool.items()], "id long, text string, version long")
    return ENGINE.embed(rows.select("id", "text")).join(rows.select("id", "version"), "id").select("id", "embedding", "version")


def full(spark, saved, rows, depth):
    asked = ENGINE.embed(spark.createDataFrame([(i, t) for i, t in saved.items()], "id long, text string"))
    found = vector.vector_topk(asked.select(F.col("id").alias("query_id"), "embedding"), rows.select("id", "embedding"), depth)
    return sorted((r.query_id, r.rank, r.id, r.score) for r in found.collect())


def test_reruns_equal_full_runs(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(6))
    own = SavedSearches(spark, str(tmp_path / "saved"), ENGINE, depth=5, partitions=2)
    saved = {k: text() for k in range(4)}
    frame = (lambda some: spark.createDataFrame([(k, f"n{k}", some[k]) for k in some], "saved_id long, name string, raw string"))
    own.create(frame(saved))
    pool = {i: (text(), 1) for i in range(40)}

    def check():
        rows = vectors(spark, pool)
        assert sorted(map(tuple, own.rerun(rows).collect())) == full(spark, saved, rows, 5)

    check()
    pool |= {100 + i: (text(), 2) for i in range(10)}                    # rows are added
    check()
    hit = own.state.rows().where("saved_id = 1").first()["hits"][0]["id"]
    pool.pop(hit)                                                        # a hit is deleted
    other = own.state.rows().where("saved_id = 2").first()["hits"][0]["id"]
    if other in pool:
        pool[other] = (text(), 3)                                        # a hit is changed
    check()
    own.delete(frame({3: ""}))
    saved.pop(3)
    saved |= {1: text(), 9: text()}                                      # one is saved anew, one is new
    own.create(frame({k: saved[k] for k in (1, 9)}))
    check()
    log = {(r.saved_id, r.seen): r.whole for r in own.runs().collect()}
    assert len([1 for r in own.runs().collect()]) == 16
    assert not any(log[k, 2] for k in range(4)) and log[9, max(s for _, s in log)]


def test_no_searches_and_no_rows(spark, tmp_path):
    own = SavedSearches(spark, str(tmp_path / "saved"), ENGINE, partitions=2)
    rows = vectors(spark, {1: ("word1", 1)})
    assert own.rerun(rows).count() == 0
    own.create(spark.createDataFrame([(1, "n", "word1"), (None, "n", "lost")], "saved_id long, name string, raw string"))
    assert own.rerun(rows.where("id < 0")).count() == 0
    assert [r.id for r in own.rerun(rows).collect()] == [1]


def test_stored_runs_and_jobs(spark, tmp_path):
    measures = spark.createDataFrame([("hybrid", 0.5), ("lexical", 0.4)], "strategy string, p double")
    for day, part in (("2024-01-01", measures), ("2024-01-03", measures.withColumn("p", F.col("p") * 2)), ("2024-01-02", measures)):
        store_run(part, str(tmp_path / "runs"), F.to_timestamp(F.lit(day)))
    newest = latest(spark.read.parquet(str(tmp_path / "runs"))).first()
    assert [(m.strategy, m.p) for m in newest.measures] == [("hybrid", 1.0), ("lexical", 0.8)]
    jobs = spark.createDataFrame([("Senior engineer with react and python, 5+ years", "Engineer"), (None, None),
                                  ("Senior engineer with react and python, 5+ years", "Engineer")], "jd_text string, title string")
    stored = store_jobs(jobs, ENGINE, str(tmp_path / "jobs"))
    again = spark.read.parquet(str(tmp_path / "jobs"))
    assert stored.count() == again.count() == 2 and again.select("job_id").distinct().count() == 2
    assert again.where("title is not null").first()["parsed_jd"] is not None
