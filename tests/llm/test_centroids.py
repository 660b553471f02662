"""Bit-plane distances and whole rounds against plain integer arithmetic."""

import hashlib

import numpy as np
from helpers import seeded

from rankspark.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, planes string"


def brute(rows, clusters, rounds):
    from fractions import Fraction

    kept = [(i, [int(Fraction(x) * 256 // 1) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else ""))
    at = [list(v) for _, v in order[:clusters]]

    def assigned():
        far = [[sum((x - y) ** 2 for x, y in zip(v, c)) for c in at] for _, v in kept]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rounds):
        now = assigned()
        for k in range(len(at)):
            own = [v for (_, v), (c, _) in zip(kept, now) if c == k]
            if own:
                at[k] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, k, d) for (i, _), (k, d) in zip(kept, assigned())], at


def made(spark, rows):
    return spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)


def compare(spark, rows, clusters=6, rounds=3):
    frame, at = centroids.clustered(made(spark, rows).repartition(3), clusters, rounds)
    want, there = brute(rows, clusters, rounds)
    key = (lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    assert sorted(map(tuple, frame.collect()), key=key) == sorted([(i, k, min(d, centroids.LONGEST)) for i, k, d in want], key=key)
    assert at == there


def test_dot_products_are_exact():
    rng = np.random.default_rng(2)
    for low, high in ((-3, 3), (-256, 256), (-(1 << 27), 1 << 27), (-(1 << 40), 1 << 40)):
        a, b = rng.integers(low, high, (20, 64)), rng.integers(low, high, (7, 64))
        pa, pb = (centroids.packed(x, max(map(centroids.planes_needed, x))) for x in (a, b))
        assert (centroids.dots(pa, pb) == a.astype(object) @ b.astype(object).T).all()
        assert (centroids.squares(pa) == (a.astype(object) ** 2).sum(axis=1)).all()
        assert [centroids.unpacked(w.tobytes()) for w in pa] == a.tolist()


def test_rounds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) + 3 * (i % 5 == np.arange(64) % 5)).tolist()) for i in range(300)]
    compare(spark, rows + [(1000 + i, rows[3][1]) for i in range(40)])
    compare(spark, rows[:4])


def test_any_size(spark):
    """Components far beyond 64 bits beside ordinary ones."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 3)).tolist()) for i in range(60)]
    rows += [(100, [1e30] * 64), (101, [-1e12] * 64), (102, [1e12] * 32 + [0.001] * 32), (103, [-1.7e308] * 64)]
    compare(spark, rows, 8, 2)


def test_edge_cases(spark):
    good = [0.5] * 64
    rows = [(1, None), (2, []), (3, [0.1] * 63), (4, [None] + [0.1] * 63), (5, [float("nan")] + [0.1] * 63), (6, [float("inf")] * 64),
            (7, good), (7, good), (8, [-0.001] * 64), (None, [0.0] * 64)]
    compare(spark, rows)
    out = centroids.cluster_digest(made(spark, rows))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and out.count() == 4
    assert centroids.cluster_digest(made(spark, [])).count() == 0
    assert centroids.cluster_digest(made(spark, rows[:6])).count() == 0


def test_hot_copies(spark):
    rng = seeded(1)
    rows = [(i, [0.25] * 64) for i in range(500)] + [(1000 + i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(100)]
    compare(spark, rows, 5, 2)
