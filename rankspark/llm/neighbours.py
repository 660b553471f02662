"""Nearest neighbours by a block matrix join over int8 tiles.

Queries are cut into blocks of at most about ``BLOCK`` rows; each block in turn is sent to all tasks and
meets all candidates, tile by tile.  Unit vectors are quantised to int8 with one scale each; the product
of two int8 tiles gives every cosine up to an error that is known, as the length of what rounding left
over is stored with each vector:

    |cos - scale_q * scale_c * <q, c>| <= left_q + left_c * (1 + left_q)

A candidate survives if its upper bound reaches the query's k-th best lower bound so far.  Survivors are
recomputed in double precision from the original vectors; each tile's best go to a bounded heap for each
query, each task returns its heaps, and heaps are merged by (score descending, vec_id ascending).

Edge cases: vectors that are null, empty or zero, hold a null or a value that is not finite, or have a
null vec_id take no part; vectors of another dimension than the query's are no candidates for it; a repeated vec_id
is one row each, but never a neighbour of itself; with fewer candidates than k, all come; ties go to
the smaller vec_id; an empty table gives no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import staged

EVERY, K = 50, 5
BLOCK, TILE = 2048, 1024
_EXACT = 1 << 24  # whole numbers that float32 holds exactly; 127 * 127 * dims must stay below
KINDS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the embedding as doubles, of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0))


class Quantised:
    """Vectors of one dimension as int8, with the scale of each and the length of its rounding error."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        top = np.abs(vectors).max(axis=1, keepdims=True)
        scaled = vectors / top                                   # no overflow or underflow of squares
        unit = scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
        self.unit_scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.unit_scale[:, None]).astype(np.int8)
        self.left = np.sqrt(((unit - self.codes * self.unit_scale[:, None]) ** 2).sum(axis=1)) + 1e-12

    def part(self, a: int, b: int) -> Quantised:
        out = object.__new__(Quantised)
        for name in ("ids", "vectors", "unit_scale", "codes", "left"):
            setattr(out, name, getattr(self, name)[a:b])
        return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``, in double precision."""
    dot = lambda x, y: np.einsum("ij,ij->i", x, y)
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))
    odd = ~np.isfinite(out)
    if odd.any():  # squares beyond the range of doubles: scale first
        x, y = (m[odd] / np.abs(m[odd]).max(axis=1, keepdims=True) for m in (a, b))
        out[odd] = dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of int8 tiles, by float32 matrix products of so many columns that none is rounded."""
    step = _EXACT // (127 * 127)
    total = np.zeros((len(q), len(c)))
    for k in range(0, q.shape[1], step):
        total += q[:, k: k + step].astype(np.float32) @ c[:, k: k + step].astype(np.float32).T
    return total


class Heaps:
    """The k best of every query so far: arrays queries x k, best first."""

    def __init__(self, queries: Quantised, k: int):
        self.q, self.k = queries, k
        self.score = np.full((len(queries.ids), k), -np.inf)
        self.id = np.full((len(queries.ids), k), np.iinfo(np.int64).max)

    def meet(self, tile: Quantised) -> None:
        q = self.q
        near = products(q.codes, tile.codes) * q.unit_scale[:, None] * tile.unit_scale[None, :]
        error = q.left[:, None] + tile.left[None, :] * (1 + q.left[:, None]) + 1e-9
        own = q.ids[:, None] == tile.ids[None, :]
        low = np.where(own, -np.inf, near - error)
        k = min(self.k, low.shape[1])
        floor = self.score[:, -1].copy()
        if k == self.k:
            floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(~own & (near + error >= floor[:, None]))
        if not len(row):
            return
        for a in range(0, len(row), 1 << 18):  # bounded memory when very many tie
            self._merge(row[a: a + (1 << 18)], col[a: a + (1 << 18)], tile)

    def _merge(self, row: np.ndarray, col: np.ndarray, tile: Quantised) -> None:
        score = cosines(self.q.vectors[row], tile.vectors[col])
        touched = np.unique(row)
        rows = np.concatenate([row, np.repeat(touched, self.k)])
        scores = np.concatenate([score, self.score[touched].ravel()])
        ids = np.concatenate([tile.ids[col], self.id[touched].ravel()])
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < self.k
        self.score[rows[best], place[best]] = scores[best]
        self.id[rows[best], place[best]] = ids[best]

    def frame(self) -> pd.DataFrame:
        row, col = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"query_id": self.q.ids[row], "vec_id": self.id[row, col], "score": self.score[row, col]})


def by_dimension(ids: list[int], vectors: list) -> dict[int, Quantised]:
    sizes = np.array([len(v) for v in vectors])
    out = {}
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out[int(d)] = Quantised(np.array([ids[i] for i in at], np.int64), np.array([vectors[i] for i in at], float))
    return out


def neighbours(vectors: DataFrame, every: int = EVERY, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    queries = staged(rows.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"]))
    blocks = max(1, math.ceil(queries.count() / block))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for at in range(blocks):
        held = dealt.filter(F.col("block") == at).toArrow()
        shared = spark.sparkContext.broadcast((held.column("vec_id").to_numpy(), held.column("v").to_pylist()))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            heaps = {d: Heaps(q, k) for d, q in by_dimension(*shared.value).items()} if len(shared.value[0]) else {}
            for batch in batches:
                for d, tile in by_dimension(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist()).items():
                    if d in heaps:
                        for a in range(0, len(tile.ids), TILE):
                            heaps[d].meet(tile.part(a, a + TILE))
            for heap in heaps.values():
                yield pa.RecordBatch.from_pandas(heap.frame(), preserve_index=False)

        part = rows.mapInArrow(search, KINDS)
        found = part if found is None else found.unionByName(part)
    return merged(found, k)


def merged(found: DataFrame, k: int = K) -> DataFrame:
    """The k best of the tasks' heaps: at most k rows for each query and task come in."""
    best = F.expr(f"slice(array_sort(collect_list(struct(-score as worse, vec_id))), 1, {k})")
    lists = found.groupBy("query_id").agg(best.alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.worse")).alias("score"))
