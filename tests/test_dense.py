"""Few queries scored as a matrix, against the joins that serve any number of them."""

import random

import pytest
from pyspark.sql import functions as F

from rankspark.operators import dense, lexical, vector

SHUFFLED = "Exchange hashpartitioning(query_id"


def rows_of(frame):
    return sorted((r.query_id, r.rank, r.id, r.score, tuple(r.matched_terms)) for r in frame.collect())


@pytest.mark.parametrize("tile", [1, 4_000_000])
def test_matrix_equals_joins(spark, monkeypatch, tile):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, [rng.choice(words) for _ in range(rng.randint(0, 12))]) for k in range(300)]
    docs += [(1000 + k, docs[k % 5][1]) for k in range(60)]  # ties go to the smaller id
    asked = [(q, rng.sample(words, rng.randint(0, 6)) + ["nowhere"]) for q in range(25)]
    docs = spark.createDataFrame(docs, "id long, tokens array<string>").repartition(5)
    asked = spark.createDataFrame(asked, "query_id long, terms array<string>")
    monkeypatch.setattr(dense, "TILE_CELLS", tile)
    got = [rows_of(lexical.bm25(asked, docs, 7)), rows_of(lexical.or_rank(asked, docs, 7, matrix=True))]
    post = lexical.postings(docs)
    stats = lexical.term_statistics(docs, lexical.query_term_rows(asked), True)
    indexed = rows_of(lexical.bm25(asked, post, 7, statistics=stats))
    monkeypatch.setattr(dense, "fits", lambda *_: False)
    assert got == [rows_of(lexical.bm25(asked, docs, 7)), rows_of(lexical.or_rank(asked, docs, 7))]
    assert indexed == got[0] and len(got[0]) > 100


def test_pairs_are_not_shuffled(spark):
    """A task sends its best rows of each query, whatever the number of documents."""
    docs = spark.range(4000).select("id", F.array(F.lit("a"), F.lit("b")).alias("tokens")).repartition(2)
    asked = spark.createDataFrame([(q, ["a", "b"]) for q in range(20)], "query_id long, terms array<string>")
    found = lexical.bm25(asked, docs, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "HashAggregate" not in plan
    assert [r.id for r in found.where("query_id = 3").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_words_are_counted_without_shuffling_them(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["a"])], "id long, tokens array<string>")
    frame = lexical.document_frequency(docs)
    assert {(r.term, r.df, r.cf) for r in frame.collect()} == {("a", 2, 3), ("b", 1, 1)}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(term#" in plan and ", id#" not in plan.split("hashpartitioning(term")[1].split(")")[0]


def test_blocks_hold_few_scores(spark, monkeypatch):
    """Small tiles and small blocks give what one block does, and hits are dealt once."""
    rng = random.Random(5)
    pool = spark.createDataFrame([(k, [float(rng.randint(-2, 2)) for _ in range(4)]) for k in range(120)], "id long, embedding array<float>")
    asked = pool.select(F.col("id").alias("query_id"), "embedding")
    whole = [tuple(r) for r in vector.vector_topk(asked, pool, 6).orderBy("query_id", "rank").collect()]
    monkeypatch.setattr(vector, "TILE_CELLS", 50)
    monkeypatch.setattr(vector, "LEAST_ROWS", 16)
    split = vector.vector_topk(asked, pool, 6, sent_queries=0)
    assert [tuple(r) for r in split.orderBy("query_id", "rank").collect()] == whole and len(whole) == 720
    assert split._jdf.queryExecution().executedPlan().toString().count(SHUFFLED) == 1
