"""Nearest neighbours against all cosines."""

import math

import numpy as np
from pyspark.sql import functions as F

from rankspark.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def brute(rows, every=50, k=5):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in fine:
        if q % every:
            continue
        scored = [(-(x @ y) / (math.sqrt(x @ x) * math.sqrt(y @ y)), i) for i, y in fine if i != q and len(y) == len(x)]
        out[q] = [(i, round(-s, 9)) for s, i in sorted((round(s, 12), i) for s, i in scored)[:k]]
    return out


def got(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    return out


def test_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 64)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(700)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)] + [(5000 + i, [x * 4 for x in rows[50][1]]) for i in range(8)]
    want = brute(rows)
    assert got(neighbours.neighbours(table(spark, rows).repartition(5))) == want
    assert got(neighbours.neighbours(table(spark, rows).repartition(2), block=3)) == want


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (100, [1e-30, 3e-30]), (9, [3e38, 1e38])]
    out = neighbours.neighbours(table(spark, rows).withColumn("v", F.lit(1)).withColumn("score", F.lit("x")))
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and dict(out.dtypes)["rank"] == "int"
    assert got(out) == brute(rows)
    assert neighbours.neighbours(table(spark, [])).count() == 0
    assert neighbours.neighbours(table(spark, [(50, [1.0])])).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(2)
    a, b = (neighbours.Quantised(np.arange(50), rng.normal(size=(50, 33)) ** 3) for _ in range(2))
    near = neighbours.products(a.codes, b.codes) * a.unit_scale[:, None] * b.unit_scale[None, :]
    true = np.array([neighbours.cosines(np.repeat(x[None], 50, 0), b.vectors) for x in a.vectors])
    assert (np.abs(near - true) <= a.left[:, None] + b.left[None, :] * (1 + a.left[:, None])).all()
