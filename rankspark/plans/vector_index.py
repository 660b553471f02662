"""A stored vector index: an inverted file of cells, short codes and full vectors.

    centroids   cell, vector            at most MOST_CELLS rows
    codes       cell, id, code          two bits for each component; one folder for each cell
    vectors     cell, id, embedding     one folder for each cell
    settings    one row

Centroids are fitted by spherical k-means on a sample of at most ``sample_rows`` vectors, those first by a
hash of their id; every vector is then assigned and stored.  A search goes through three steps, each
reading less than the one before would have to: the folders of the cells nearest to some query, their
codes, and the full vectors of each query's best codes, which are ranked by exact cosine.

How many cells and how many full vectors a query needs is measured when the index is written: for
``tune_queries`` of the sample the exact neighbours are looked up among the cells and the codes, and the
quantiles of their places are kept.  Data without clusters ask for more cells; the settings say so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import vector
from ..operators.shape import late_join, top_k
from ..session import written

# Most cells (folders) of an index, and the vectors aimed at in one file.
MOST_CELLS, FILE_VECTORS = 4096, 500_000
SAMPLE_ROWS, TUNE_QUERIES, TUNE_DEPTH, QUANTILE = 16_384, 64, 10, 0.98
# Codes that meet a block of queries at most, hits that a block may hold, and scores that a task makes at once.
BLOCK_CODES, BLOCK_HITS, TILE_CELLS = 262_144, 1_000_000, 1_000_000
LEVELS = (-1.5, -0.5, 0.5, 1.5)  # what the two bits stand for, in standard deviations


def _unit(rows):
    import numpy as np

    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def fit_centroids(rows, cells: int, rounds: int = 10, seed: int = 7):
    """Unit centroids of unit rows by spherical k-means; a cell that runs empty takes the worst-served row."""
    import numpy as np

    rows = _unit(np.asarray(rows, dtype=np.float64))
    cells = min(cells, len(rows))
    at = rows[np.random.default_rng(seed).choice(len(rows), cells, replace=False)]
    for _ in range(rounds):
        near = rows @ at.T
        best = near.argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, best, rows)
        empty = np.flatnonzero(np.bincount(best, minlength=cells) == 0)
        sums[empty] = rows[np.argsort(near.max(axis=1))[: len(empty)]]
        at = _unit(sums)
    return at


def encode(rows, scale: float):
    """rows x ceil(dims / 4) bytes: each component of the unit row as one of four levels."""
    import numpy as np

    unit = _unit(np.asarray(rows, dtype=np.float64)) / scale
    level = np.clip(np.floor(unit) + 2, 0, 3).astype(np.uint8)
    pad = -level.shape[1] % 4
    level = np.pad(level, ((0, 0), (0, pad))).reshape(len(level), -1, 4)
    return (level << np.array([0, 2, 4, 6], np.uint8)).sum(axis=2, dtype=np.uint8)


def code_reader(dims: int):
    """Arrow column of codes -> matrix of levels, for the comparison of ``vector``."""
    levels = LEVELS

    def read(column):
        import numpy as np

        width = -(-dims // 4)
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
        bits = (raw[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
        return np.array(levels)[bits.reshape(len(raw), -1)[:, :dims]]

    return read


def best_codes(dims: int, n_cells: int, k: int, digits: int = vector.SIMILARITY_DIGITS):
    """The comparison of a block of queries with a block of codes: the best k codes of each query in its cells."""
    read, tile_cells = code_reader(dims), TILE_CELLS

    def meet(left, right):
        import numpy as np
        import pyarrow as pa

        def unit(rows):
            norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
            norms[norms == 0] = 1.0
            return rows / norms[:, None]

        def column(table, name):
            return table.column(name).combine_chunks()

        def cut():
            at, ids, score = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, -score, at))
            at, ids, score = at[order], ids[order], score[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            last, keep = place == k - 1, place < k
            least[at[last]] = score[last]
            return at[keep], ids[keep], score[keep]

        n = left.num_rows
        least, size = np.full(n, -np.inf), 0
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        names = np.zeros(0, np.int64)
        if n and right.num_rows:
            names, lists = column(left, "query_id").to_numpy(), column(left, "cells")
            wanted = unit(column(left, "embedding").flatten().to_numpy(zero_copy_only=False).reshape(n, dims))
            asks = np.zeros((n, n_cells), bool)
            asks[np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
            ids, codes, cell = column(right, "id").to_numpy(), column(right, "code"), column(right, "cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            kinds, starts = np.unique(cell[order], return_index=True)
            for kind, start, stop in zip(kinds, starts, [*starts[1:], len(cell)], strict=True):
                asking = np.flatnonzero(asks[:, kind])
                step = max(1, tile_cells // max(1, len(asking)))
                for first in range(start, stop if len(asking) else start, step):
                    place = order[first:min(first + step, stop)]
                    scores = wanted[asking] @ unit(read(codes.take(pa.array(place)))).T
                    # scores are compared when rounded
                    at, near = np.nonzero(scores >= least[asking, None] - 10.0 ** -digits)
                    score, at, near = np.round(scores[at, near], digits) + 0.0, asking[at], ids[place[near]]
                    keep = score >= least[at]
                    held.append((at[keep], near[keep], score[keep]))
                    size += int(keep.sum())
                    if size > 3 * k * n:
                        held = [cut()]
                        size = len(held[0][0])
        at, near, score = cut()
        return pa.Table.from_arrays([pa.array(names[at]), pa.array(near), pa.array(score)], ["query_id", "id", "score"])

    return meet


def _vectors(pool: DataFrame, key: str, dims: int | None = None) -> DataFrame:
    """Rows whose vector is complete, finite and not zero (of ``dims`` components, if given)."""
    value = F.col("embedding").cast("array<double>")
    rows = pool.select(F.col(key).cast("bigint").alias(key), value.alias("embedding"))
    good = (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col(key).isNotNull() & good & F.exists("embedding", lambda x: x != 0))
    return rows if dims is None else rows.where(F.size("embedding") == dims)


@dataclass(frozen=True)
class VectorIndex:
    codes: DataFrame
    vectors: DataFrame
    centroids: list          # unit vectors by cell
    settings: dict           # dims, scale, n_vectors, probes, rerank

    @classmethod
    def write(
        cls, pool: DataFrame, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS,
        tune_queries: int = TUNE_QUERIES, depth: int = TUNE_DEPTH, quantile: float = QUANTILE,
    ) -> None:
        """Fit, assign and store; vectors of another length than the first of the sample are left out."""
        import numpy as np

        spark = pool.sparkSession
        whole = _vectors(pool, "id")
        drawn = whole.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()  # bounded sample
        if not drawn:
            raise ValueError("an index needs at least one vector")
        dims = len(drawn[0]["embedding"])
        drawn = [r for r in drawn if len(r["embedding"]) == dims]
        whole = whole.where(F.size("embedding") == dims)
        n = whole.count()
        sample = _unit(np.array([r["embedding"] for r in drawn]))
        cells = cells or max(1, min(MOST_CELLS, round(math.sqrt(n))))
        centroids = fit_centroids(sample, cells)
        scale = float(sample.std()) or 1.0
        sent = spark.sparkContext.broadcast(centroids)
        step = max(1, TILE_CELLS // len(centroids))

        def assign(batches):
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                rows = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                cell = np.concatenate([
                    (_unit(rows[at:at + step]) @ sent.value.T).argmax(axis=1) for at in range(0, len(rows), step)]).astype("int32")
                codes = [c.tobytes() for c in encode(rows, scale)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), batch.column("id"), pa.array(codes, pa.binary()), batch.column("embedding")],
                    ["cell", "id", "code", "embedding"])

        files = max(1, math.ceil(n / FILE_VECTORS))  # a cell may hold a third of all vectors
        dealt = whole.mapInArrow(assign, "cell int, id bigint, code binary, embedding array<double>").withColumn(
            "embedding", F.col("embedding").cast("array<float>")
        ).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(files)))
        for name, column in (("codes", "code"), ("vectors", "embedding")):
            dealt.select("cell", "id", column).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/{name}")
        spark.createDataFrame(
            [(k, row.tolist()) for k, row in enumerate(centroids)], "cell int, vector array<double>"
        ).write.mode("overwrite").parquet(f"{path}/centroids")
        draft = cls(
            spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), list(centroids),
            {"dims": dims, "scale": scale, "n_vectors": n, "probes": len(centroids), "rerank": n})
        asked = [(r["id"], r["embedding"]) for r in drawn[:tune_queries]]
        probes, rerank = draft._needed(
            spark.createDataFrame(asked, "query_id bigint, embedding array<double>"), depth, quantile)
        spark.createDataFrame(
            [(dims, scale, n, probes, rerank)], "dims int, scale double, n_vectors bigint, probes int, rerank int"
        ).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
        return cls(
            spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors"), [r["vector"] for r in rows],
            spark.read.parquet(f"{path}/settings").first().asDict())

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, cells (nearest first), embedding: one row for each query."""
        import numpy as np

        sent = queries.sparkSession.sparkContext.broadcast(np.array(self.centroids))
        dims, step = self.settings["dims"], max(1, TILE_CELLS // len(self.centroids))

        def nearest(batches):
            import pyarrow as pa

            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    rows = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                    order = np.argsort(-(rows @ sent.value.T), axis=1, kind="stable")[:, :probes].astype("int32")
                    ends = np.arange(len(order) + 1, dtype="int32") * order.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id"), pa.ListArray.from_arrays(ends, pa.array(order.ravel())), part.column("embedding")],
                        ["query_id", "cells", "embedding"])

        return _vectors(queries, "query_id", dims).mapInArrow(
            nearest, "query_id bigint, cells array<int>, embedding array<double>")

    def _candidates(self, asked: DataFrame, codes: DataFrame, rerank: int) -> DataFrame:
        """query_id, id, rank: the best codes of the cells asked.

        Blocks of queries meet blocks of codes.  A block keeps a query's best over all its cells, so neither
        what a task holds nor what it returns grows with the number of cells or their size.
        """
        n, cores = self.settings["n_vectors"], asked.sparkSession.sparkContext.defaultParallelism
        code_blocks = math.ceil(n / BLOCK_CODES)
        query_blocks = max(math.ceil(asked.count() * min(rerank, n) / BLOCK_HITS), math.ceil(2 * cores / code_blocks))

        def dealt(frame, key, own, of, other, others):
            return frame.withColumn(own, F.pmod(F.xxhash64(key), F.lit(of)).cast("int")).withColumn(
                other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("qb", "cb")

        wanted = dealt(asked.select("query_id", "embedding", "cells"), "query_id", "qb", query_blocks, "cb", code_blocks)
        coded = dealt(codes.select("id", "code", "cell"), "id", "cb", code_blocks, "qb", query_blocks)
        meet = best_codes(self.settings["dims"], len(self.centroids), rerank)
        hits = wanted.cogroup(coded).applyInArrow(meet, vector.HIT_TYPE)
        return top_k(hits, ["query_id"], [F.desc("score"), F.asc("id")], rerank)

    def search(
        self, queries: DataFrame, k: int = fixed.RETRIEVER_DEPTH, probes: int | None = None, rerank: int | None = None
    ) -> DataFrame:
        """Nearest vectors found: query_id, id, rank, score.  Folders of cells that no query asks are not read."""
        probes = probes or self.settings["probes"]
        rerank = max(k, rerank or self.settings["rerank"])
        asked = written(self.probed(queries, probes))
        cells = [r["cell"] for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most MOST_CELLS
        here = F.col("cell").isin(cells)
        best = written(self._candidates(asked, self.codes.where(here), rerank).select("query_id", "id"))
        own = asked.select("query_id", F.col("embedding").alias("wanted"))
        full = self.vectors.where(here).select("id", "embedding")
        rows = late_join(best, full, "id").join(own, "query_id")
        exact = F.round(vector.cosine(F.col("wanted"), F.col("embedding")), vector.SIMILARITY_DIGITS)
        ranked = top_k(rows.select("query_id", "id", exact.alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], k)
        return ranked.select("query_id", "id", "rank", "score")

    def _needed(self, queries: DataFrame, depth: int, quantile: float) -> tuple[int, int]:
        """Cells and full vectors at which the share ``quantile`` of the exact neighbours is found.

        A neighbour's place among the codes is the number of codes that score higher, counted in the tasks.
        """
        import numpy as np

        asked = {r["query_id"]: r["embedding"] for r in queries.collect()}  # at most tune_queries
        exact = written(vector.vector_topk(queries, self.vectors.select("id", "embedding"), depth).select("query_id", "id"))
        rows = late_join(exact, self.codes, "id").collect()  # at most tune_queries * depth
        ids = sorted(asked)
        wanted = _unit(np.array([asked[q] for q in ids], dtype=np.float64))
        order = np.argsort(-(wanted @ np.array(self.centroids).T), axis=1, kind="stable")
        row_of = {q: k for k, q in enumerate(ids)}
        at = np.array([row_of[r["query_id"]] for r in rows])
        places = [int(np.flatnonzero(order[k] == r["cell"])[0]) + 1 for k, r in zip(at, rows, strict=True)]
        dims = self.settings["dims"]
        read = code_reader(dims)

        def scores(matrix):
            return wanted @ _unit(matrix).T

        import pyarrow as pa

        own = np.einsum("ij,ij->i", wanted[at], _unit(read(pa.array([r["code"] for r in rows], pa.binary()))))

        step = max(1, TILE_CELLS // max(1, len(own)))

        def count(batches):
            above = np.zeros(len(own), np.int64)
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    near = scores(read(batch.column("code").slice(start, step)))
                    above += (near[at] > own[:, None] + 1e-12).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(own))), pa.array(above)], ["hit", "above"])

        counted = self.codes.select("code").mapInArrow(count, "hit bigint, above bigint")
        above = [r["above"] + 1 for r in counted.groupBy("hit").agg(F.sum("above").alias("above")).collect()]
        return (
            max(1, math.ceil(np.quantile(places, quantile))),
            max(depth, math.ceil(np.quantile(above, quantile))),
        )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_queries and the share of the exact rows, by score, that were found.

    A row found counts if its score is at least that of the last exact row of its query: ties may
    be broken either way.
    """
    least = exact.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("wanted"))
    met = least.join(found, "query_id", "left").groupBy("query_id").agg(
        F.first("wanted").alias("wanted"), F.count(F.when(F.col("score") >= F.col("least"), 1)).alias("met"))
    return met.agg(
        F.count(F.lit(1)).alias("n_queries"),
        (F.sum(F.least("met", "wanted")) / F.sum("wanted")).alias("recall"))
