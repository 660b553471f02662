"""Plan-shape helpers shared by the operators: top-k, size checks, skew-safe joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is broadcast only if its rows were counted and are at most this many.
BROADCAST_ROWS = 50_000
# How often the small side is repeated at least when a join has to be shuffled.
LEAST_SALTS = 32


def rows_at_most(frame: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if the frame has at most ``rows`` rows; reads no more than ``rows + 1`` of them."""
    return frame.limit(rows + 1).count() <= rows


def top_k(frame: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank="rank"):
    """The first ``k`` rows of each group with their 1-based rank.

    Spark cuts every partition to k rows per group before the shuffle, so a group that holds a
    large part of the table sends k rows per partition, not all of them.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return frame.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    small_is_bounded: bool,
    how: str = "inner",
    spread_by: str = "id",
    salts: int | None = None,
) -> DataFrame:
    """Equi-join of a big side, whose keys may be skewed, with a smaller side.

    A counted, bounded small side is broadcast: the big side is not shuffled at all.  Otherwise
    both sides are shuffled on the key and a salt, so that even a key owning a third of the
    big side is spread over ``salts`` tasks - by default as many as a shuffle has partitions, so
    that it grows with the cluster's settings.  The result is the same either way.
    """
    on = list(on)
    if small_is_bounded:
        return big.join(F.broadcast(small), on, how)
    if salts is None:
        partitions = big.sparkSession.conf.get("spark.sql.shuffle.partitions")
        salts = max(LEAST_SALTS, int(partitions))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The engine may guess the big side from the files it comes from and broadcast it; it is never to.
    return salted.hint("merge").join(copies, [*on, "_salt"], how).drop("_salt")


def dealt_by(frame: DataFrame, *keys: str) -> DataFrame:
    """The frame over a shuffle's partitions by ``keys``: aggregations and joins with broadcast tables on these
    and further keys then need no shuffle of what they make of a row."""
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return frame.repartition(partitions, *keys)


def scope_of(frame: DataFrame, key: str) -> Column:
    """The frame's ``scope`` column, or '' for all rows.

    The '' is computed from ``key``, not a literal: equal literals on both sides of a join
    would be folded away and leave a join without a key.
    """
    if "scope" in frame.columns:
        return F.col("scope").cast("string").alias("scope")
    return F.substring(F.col(key).cast("string"), 1, 0).alias("scope")


def late_join(ids: DataFrame, big: DataFrame, on: str, few: bool | None = None) -> DataFrame:
    """Fetch the rows of ``big`` named by ``ids``, which are counted unless ``few`` is given: few of them travel to
    ``big``, which is then not shuffled.  The engine guesses sizes from files and may take ``big`` for small; it is never broadcast."""
    if rows_at_most(ids) if few is None else few:
        return big.join(F.broadcast(ids), on)
    return big.hint("merge").join(ids, on)
