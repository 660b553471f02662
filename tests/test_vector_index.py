"""The stored vector index: recall against exact search, what a search reads, and odd vectors."""

import numpy as np
import pytest

from rankspark.operators import vector
from rankspark.plans.vector_index import VectorIndex, best_codes, code_reader, encode, fit_centroids, recall

SCHEMA = "id bigint, embedding array<double>, cell string, code string"


def pool_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else list(map(float, v)), None, None) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    return [(i, centres[i % 12] + rng.normal(size=16)) for i in range(1500)]


def test_recall_and_reads(spark, tmp_path, clustered):
    """Neighbours lie in few cells, so a search finds them in a small part of the folders."""
    pool = pool_of(spark, clustered)
    VectorIndex.write(pool, str(tmp_path / "index"))
    index = VectorIndex.read(spark, str(tmp_path / "index"))
    assert index.vectors.count() == index.codes.count() == 1500
    queries = pool.where("id % 50 = 0").select(pool.id.alias("query_id"), "embedding")
    found, exact = index.search(queries, 10), vector.vector_topk(queries, pool.select("id", "embedding"), 10)
    row = recall(found, exact).first()
    assert row["n_queries"] == 30 and row["recall"] >= 0.9
    assert index.settings["probes"] * 3 <= len(index.centroids) and index.settings["rerank"] <= 150
    counts = found.groupBy("query_id").count().collect()
    assert {r["count"] for r in counts} == {10}
    one = queries.where("query_id = 0")
    plan = index.search(one, 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1][:60]


def test_all_cells_and_codes_are_exact(spark, tmp_path, clustered):
    """With every cell probed and every vector reranked, the answer is the exact one."""
    rows = clustered[:300] + [(5000 + k, clustered[k][1]) for k in range(20)]  # equal vectors: ties by id
    pool = pool_of(spark, rows)
    VectorIndex.write(pool, str(tmp_path / "index"), cells=9)
    index = VectorIndex.read(spark, str(tmp_path / "index"))
    queries = pool.where("id < 25").select(pool.id.alias("query_id"), "embedding")
    got = index.search(queries, 7, probes=9, rerank=len(rows)).collect()
    want = vector.vector_topk(queries, pool.select("id", "embedding"), 7).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=5)) for k in range(40)]
    odd = [(100, None), (101, []), (102, [0, 0, 0, 0, 0]), (103, [float("nan"), 1, 1, 1, 1]), (104, [1, 2, 3]), (None, [1, 1, 1, 1, 1])]
    VectorIndex.write(pool_of(spark, rows + odd), str(tmp_path / "index"))
    index = VectorIndex.read(spark, str(tmp_path / "index"))
    assert {r.id for r in index.vectors.select("id").collect()} == set(range(40))
    queries = pool_of(spark, rows[:2] + odd).selectExpr("id as query_id", "embedding")
    assert {r.query_id for r in index.search(queries, 3).collect()} == {0, 1}
    with pytest.raises(ValueError):
        VectorIndex.write(pool_of(spark, odd[:3]), str(tmp_path / "none"))


def test_codes_and_centroids():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = rng.normal(size=(50, 7))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    codes = encode(rows, unit.std())
    back = code_reader(7)(pa.array([c.tobytes() for c in codes], pa.binary()))
    assert codes.shape == (50, 2) and back.shape == (50, 7)
    near = np.argmax((back / np.linalg.norm(back, axis=1, keepdims=True)) @ unit.T, axis=0)
    assert (near == np.arange(50)).mean() > 0.9
    copies = np.tile(rows[:1], (30, 1))
    assert fit_centroids(copies, 8).shape == (8, 7)


def test_a_block_keeps_the_best_of_all_cells():
    """A block of many cells returns k hits for each query, not k for each cell, and those of its own cells alone."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows, cells = rng.normal(size=(400, 8)), np.arange(400) % 40
    codes = encode(rows, 0.35)
    left = pa.table({"query_id": [7, 9], "embedding": rows[:2].tolist(), "cells": [list(range(40)), [3, 4]]})
    right = pa.table({"id": np.arange(400), "code": [c.tobytes() for c in codes], "cell": pa.array(cells, pa.int32())})
    got = best_codes(8, 40, 5)(left, right).to_pylist()
    level = code_reader(8)(right.column("code").combine_chunks())
    score = np.round((rows[:2] / np.linalg.norm(rows[:2], axis=1)[:, None]) @ (level / np.linalg.norm(level, axis=1)[:, None]).T, 6)
    want = []
    for k, (name, mine) in enumerate(((7, range(40)), (9, (3, 4)))):
        order = sorted((-score[k, i], i) for i in range(400) if cells[i] in mine)[:5]
        want += [(name, i) for _, i in order]
    assert [(r["query_id"], r["id"]) for r in got] == want
