"""Hand values of fusion, metrics, rerank features, vectors and texts."""

import math

import pytest
from pyspark.sql import functions as F

from rankspark.functions import text as tx
from rankspark.operators import embedding, fusion, lexical, metrics, rerank, vector

HITS = "query_id long, retriever string, id long, rank int, score double"


def test_reciprocal_rank_fusion(spark):
    hits = spark.createDataFrame([(1, "a", 10, 1, 9.0), (1, "a", 20, 2, 5.0), (1, "b", 20, 1, 0.9), (1, "b", 30, 2, 0.8), (2, "a", 7, 1, 1.0)], HITS)
    got = {(r.query_id, r.id): r for r in fusion.reciprocal_rank_fusion(hits).collect()}
    assert got[1, 20].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-8) and got[1, 20].fused_rank == 1
    assert got[1, 10].score == pytest.approx(1 / 61, abs=1e-8) and got[1, 30].score == pytest.approx(1 / 62, abs=1e-8)
    assert (got[1, 20].normalized, got[1, 30].normalized, got[2, 7].normalized) == (1.0, 0.0, 1.0)
    weighted = {r.id: r.score for r in fusion.reciprocal_rank_fusion(hits, weights={"a": 2.0}).where("query_id = 1").collect()}
    assert weighted[10] == pytest.approx(2 / 61, abs=1e-8)


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([("s", 1, 10, 1), ("s", 1, 11, 2), ("s", 1, 12, 3), ("s", 2, 99, 1)], "strategy string, query_id long, id long, rank int")
    grades = spark.createDataFrame([(1, 10, 2), (1, 12, 1), (1, 13, 2), (2, 5, 1)], "query_id long, id long, grade int")
    rows = {r.query_id: r.asDict() for r in metrics.evaluate_rankings(ranking, grades, k=3).collect()}
    ideal = 3 / math.log2(2) + 3 / math.log2(3) + 1 / math.log2(4)
    assert rows[1]["precision_at_k"] == pytest.approx(2 / 3, abs=1e-4) and rows[1]["recall_at_k"] == pytest.approx(2 / 3, abs=1e-4)
    assert rows[1]["mrr"] == 1.0 and rows[1]["ndcg_at_k"] == pytest.approx((3 + 1 / 2) / ideal, abs=1e-4)
    assert rows[2]["mrr"] == 0 and rows[2]["ndcg_at_k"] == 0


def test_years_fit(spark):
    rows = spark.createDataFrame([(1, 8.0, 5.0, None), (2, 3.0, 5.0, None), (3, None, 5.0, None), (4, 12.0, None, 10.0), (5, 4.0, None, None)],
                                 "id int, y double, lo double, hi double")
    got = {r.id: round(r.f, 4) for r in rows.select("id", rerank.years_fit(F.col("y"), F.col("lo"), F.col("hi")).alias("f")).collect()}
    assert got == {1: 1.0, 2: 0.6, 3: 0.5, 4: 0.8, 5: 0.5}


def test_texts(spark):
    row = spark.createDataFrame([("Python and C++, 5+ years.\nNode.js",)], "t string").select(
        tx.tokenize(F.col("t")).alias("k"), tx.parse_years(F.col("t")).alias("y"),
        tx.snippet(F.col("t"), tx.words_array(["node"])).alias("s")).first()
    assert row.k[0] == "python" and "node.js" in row.k and row.y == 5.0 and "Node.js" in row.s


@pytest.mark.parametrize("partitions", [1, 7])
def test_embedding_has_unit_length_and_ignores_batches(spark, partitions, monkeypatch):
    texts = spark.createDataFrame([(k, "alpha beta gamma " * (k % 5)) for k in range(40)], "id long, text string").repartition(partitions)
    embed = embedding.hash_embedder(None, dims=32, value_type="double")
    first = {r.id: r.embedding for r in embed(texts).collect()}
    for k, v in first.items():
        assert sum(x * x for x in v) == pytest.approx(1.0 if k % 5 else 0.0)
        assert v == pytest.approx(first[k % 5] if k % 5 else [0.0] * 32)
    monkeypatch.setattr(embedding, "TOKENS_AT_ONCE", 5)
    assert {r.id: r.embedding for r in embed(texts).collect()} == first


def test_vector_variants_agree(spark):
    import random

    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)]
    pool = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = pool.where("id % 40 = 0").select(F.col("id").alias("query_id"), "embedding")
    sent = {(r.query_id, r.id, r.rank) for r in vector.vector_topk(queries, pool, 5).collect()}
    blocks = {(r.query_id, r.id, r.rank) for r in vector.vector_topk(queries, pool, 5, sent_queries=0).collect()}
    assert sent == blocks and len(sent) == 25
    assert {(q, i) for q, i, rank in sent if rank == 1} == {(q, q) for q in range(0, 200, 40)}


@pytest.mark.parametrize("partitions", ["1", "8", "200"])
def test_bm25_by_hand(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = spark.createDataFrame([(1, "apple pie apple"), (2, "pie crust"), (3, "unrelated words here")], "id long, text string")
        queries = spark.createDataFrame([(1, ["apple", "pie"])], "query_id long, terms array<string>")
        got = [(r.id, r.score) for r in lexical.bm25(queries, lexical.tokenized(docs), 10).orderBy("rank").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    n, average = 3, 8 / 3
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, length: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))
    want = [(1, idf(1) * part(2, 3) + idf(2) * part(1, 3)), (2, idf(2) * part(1, 2))]
    assert [i for i, _ in got] == [1, 2] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-6)
