"""Centroid clustering with bit planes.

Components become integers.  The 64 components of a vector are cut into bit planes, each packed into one
64-bit word; the top plane is the sign's (two's complement).  A dot product is then the sum over pairs of
planes of their weights times the number of ones in the AND of the two words, exact in integers, and so
are squared distances.

Each round sends the centroids (at most ``CLUSTERS``) to all tasks, which assign their vectors and return
one partial sum for each cluster, component and limb of ``LIMB`` bits, not one for each vector; only the
new centroids come back to the driver.

Edge cases: vectors that are null, have not ``COMPONENTS`` components, or hold a null or a value that is not
finite take no part; repeated rows are vectors each; ties of the hash (repeated vec_ids) go by the components;
a null vec_id has no hash and comes last as a start; fewer vectors than clusters make as many clusters as
vectors; integers may have any size (vectors are grouped by their number of planes, and sums past 64 bits
are Python's), but distances and inertias above the largest long are given as that; an empty table gives
no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import staged

COMPONENTS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
LIMB = 30
LONGEST = (1 << 63) - 1
SLICE = 2048             # vectors that are compared at a time


def integers(values: np.ndarray) -> list[int] | np.ndarray:
    """floor(SCALE * x) of each component, exact at any size."""
    if np.abs(values).max(initial=0) < 2.0 ** 50:
        return np.floor(values * SCALE).astype(np.int64)
    return np.array([math.floor(x * SCALE) if abs(x) < 2.0 ** 50 else int(x) * SCALE for x in values.tolist()], object)


def planes_needed(values) -> int:
    """Bits of the widest component in two's complement, rounded up to an even number."""
    bits = 1 + max(int(v).bit_length() if v >= 0 else int(~v).bit_length() for v in (min(values), max(values)))
    return bits + bits % 2


def packed(values: np.ndarray, planes: int) -> np.ndarray:
    """rows x planes words of rows x COMPONENTS integers; bit k of a word is component k's."""
    shifts = np.arange(planes)
    if planes > 62:
        bits = np.array([[[(int(v) >> int(p)) & 1 for v in row] for p in shifts] for row in values], np.uint8)
    else:
        bits = ((values[:, None, :] >> shifts[None, :, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def weights(planes: int) -> list[int]:
    return [1 << p for p in range(planes - 1)] + [-(1 << (planes - 1))]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """rows(a) x rows(b) dot products of packed vectors, by weighted counts of common ones."""
    wa, wb = weights(a.shape[1]), weights(b.shape[1])
    wide = a.shape[1] + b.shape[1] + 6 > 62
    total = np.zeros((len(a), len(b)), object if wide else np.int64)
    for i, x in enumerate(wa):
        ones = np.zeros((len(a), len(b)), object if wide else np.int64)
        for j, y in enumerate(wb):
            common = np.bitwise_count(a[:, i, None] & b[None, :, j])
            ones += common.astype(object if wide else np.int64) * y
        total += ones * x
    return total


def squares(a: np.ndarray) -> np.ndarray:
    """Dot product of each packed vector with itself."""
    w = weights(a.shape[1])
    wide = 2 * a.shape[1] + 6 > 62
    total = np.zeros(len(a), object if wide else np.int64)
    for i, x in enumerate(w):
        for j, y in enumerate(w):
            total += np.bitwise_count(a[:, i] & a[:, j]).astype(object if wide else np.int64) * (x * y)
    return total


class Centroids:
    """Packed centroids, grouped by their number of planes."""

    def __init__(self, rows: list[list[int]]):
        groups: dict[int, list[int]] = {}
        for k, row in enumerate(rows):
            groups.setdefault(planes_needed(row), []).append(k)
        self.groups = []
        for planes, numbers in sorted(groups.items()):
            words = packed(np.array([rows[k] for k in numbers], object if planes > 62 else np.int64), planes)
            self.groups.append((np.array(numbers), words, squares(words)))
        self.many = len(rows)

    def nearest(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each packed vector (ties: the smaller) and the squared distance."""
        own = squares(words)
        parts = [(numbers, dots(words, theirs), norms) for numbers, theirs, norms in self.groups]
        wide = any(x.dtype == object for x in (own, *(p[1] for p in parts), *(p[2] for p in parts)))
        found = np.zeros((len(words), self.many), object if wide else np.int64)
        for numbers, dot, norms in parts:
            found[:, numbers] = own[:, None] + norms[None, :] - 2 * dot
        best = np.array(found.argmin(axis=1), np.int64)
        return best, found[np.arange(len(words)), best]


def packed_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, planes (little-endian words, as many as the vector needs) of the vectors that take part."""
    value = F.col("embedding").cast("array<double>")
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("v")).filter(
        (F.size("v") == COMPONENTS) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, COMPONENTS)
            words: list[bytes] = [b""] * len(rows)
            groups: dict[int, list[int]] = {}
            whole = [integers(r) for r in rows]
            for k, row in enumerate(whole):
                groups.setdefault(planes_needed(row), []).append(k)
            for planes, at in groups.items():
                for k, w in zip(at, packed(np.array([whole[k] for k in at]), planes)):
                    words[k] = w.astype("<u8").tobytes()
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "planes": pa.array(words, pa.binary())})

    return kept.mapInArrow(pack, "vec_id long, planes binary")


def unpacked(planes: bytes) -> list[int]:
    """The integers of a packed vector."""
    words = np.frombuffer(planes, "<u8")
    bits = np.unpackbits(words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int(sum(w * int(b) for w, b in zip(weights(len(words)), column))) for column in bits.T]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, words) of a batch's vectors, SLICE at a time, those with as many planes together."""
    column = batch.column("planes").to_pylist()
    sizes = np.array([len(x) for x in column])
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        for at in range(0, len(places), SLICE):
            part = places[at: at + SLICE]
            yield part, np.frombuffer(b"".join(column[k] for k in part), "<u8").reshape(len(part), -1)


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """A sum in limbs of LIMB bits; the last one carries the sign."""
    place = 0
    while not -(1 << LIMB) <= total < 1 << LIMB:
        yield place, total & ((1 << LIMB) - 1)
        total >>= LIMB
        place += 1
    yield place, total


def moved(vectors: DataFrame, rows: list[list[int]]) -> list[list[int]]:
    """The centroids after one round; those without vectors stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        total = np.zeros((len(rows), COMPONENTS), object)
        count = np.zeros(len(rows), np.int64)
        for batch in batches:
            for _, words in _groups(batch):
                best, _ = centroids.nearest(words)
                count += np.bincount(best, minlength=len(rows))
                bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1, 8), axis=2, bitorder="little")
                for plane, weight in enumerate(weights(words.shape[1])):
                    ones = np.zeros((len(rows), COMPONENTS), np.int64)
                    np.add.at(ones, best, bits[:, plane])
                    total += ones.astype(object) * weight
        found = [(c, -1, 0, int(n)) for c, n in enumerate(count) if n]
        found += [(c, k, place, part) for c in np.flatnonzero(count) for k in range(COMPONENTS) for place, part in limbs(int(total[c, k]))]
        if found:
            cluster, component, limb, part = zip(*found)
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(map(int, cluster), pa.int32()), "component": pa.array(component, pa.int32()),
                "limb": pa.array(limb, pa.int32()), "part": pa.array(part, pa.int64())})

    partial = vectors.mapInArrow(sums, "cluster int, component int, limb int, part long")
    out = [list(r) for r in rows]
    totals: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("cluster", "component", "limb").agg(F.sum("part").alias("part")).collect():
        totals[r.cluster, r.component] = totals.get((r.cluster, r.component), 0) + (r.part << (LIMB * r.limb))
    for (cluster, component), total in totals.items():
        if component >= 0:
            out[cluster][component] = total // totals[cluster, -1]
    return out


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that takes part, and the final centroids."""
    vectors = staged(packed_vectors(embeddings))
    order = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    hashed = vectors.withColumn("order", order).orderBy(F.asc_nulls_last("order"), F.length("planes"), "planes")
    rows = [unpacked(bytes(r.planes)) for r in hashed.limit(clusters).collect()]
    for _ in range(rounds if rows else 0):
        rows = moved(vectors, rows)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows)
        for batch in batches:
            best, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for places, words in _groups(batch):
                cluster, distance = centroids.nearest(words)
                best[places] = cluster
                far[places] = np.minimum(distance, LONGEST).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": pa.array(best), "distance": pa.array(far)})

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), rows


def cluster_digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    frame, rows = clustered(embeddings)
    frame = staged(frame)
    spark = embeddings.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    by_cluster = {r.cluster: int(r.total) for r in frame.groupBy("cluster").agg(total.alias("total")).collect()}
    sides = [(k, min(by_cluster.get(k, 0), LONGEST), min(sum(by_cluster.values()), LONGEST),
              hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for k, row in enumerate(rows)]
    # one row for each centroid
    side = spark.createDataFrame(sides, "c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return frame.join(F.broadcast(side), frame["cluster"] == side["c"]).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
