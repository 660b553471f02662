"""Packing by optimal length buckets.

Every document's tokens, with its end id, are cut into pieces of at most ``max_length``.  The global
histogram of piece lengths (at most ``max_length`` rows, so a bounded collect) goes through a
dynamic programme that chooses at most ``buckets`` upper bounds with the least padding in all.  Inside
a bucket, pieces form batches of ``budget // pad_to`` sequences, so that no batch is over the budget;
every batch but the last of a bucket is full.

Places inside a bucket come from two-level counting: pieces are dealt over shards by a hash of their
key, ranked inside (bucket, shard), and moved by the shard's offset; no task sorts a whole bucket.

Edge cases: null and empty texts are one piece of the end id; rows with a null doc_id are packed like
others; repeated rows are packed each; an empty table gives no rows; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.common import staged
from rankspark.llm.token_counts import token_counts

MAX_LENGTH, BUCKETS, BUDGET = 2048, 8, 65536


def best_bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` length buckets with the least padding; ties: smallest bounds first."""
    order = np.argsort(lengths)
    size, many = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(size)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum(many)])           # pieces up to each length
    tokens = np.concatenate([[0], np.cumsum(many * size)])  # their tokens
    # cost[j]: least padding of the first j lengths with as many buckets as steps so far
    cost = np.full(n + 1, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        fresh, cut = cost.copy(), np.arange(n + 1)
        for j in range(1, n + 1):
            whole = cost[:j] + size[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(whole))
            if whole[i] < fresh[j]:
                fresh[j], cut[j] = whole[i], i
        cost = fresh
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if cut[j] < j:
            bounds.append(int(size[j - 1]))
            j = int(cut[j])
    return bounds[::-1]


def length_histogram(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("length").agg(F.count(F.lit(1)).alias("many"))


def pieces_of(counts: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """doc_id, piece, length: a document's tokens and its end id in pieces, none of them empty."""
    whole = F.col("n_tokens") + 1
    n = F.ceil(whole / F.lit(max_length)).cast("int")
    return (counts.select("doc_id", whole.alias("whole"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
            .select("doc_id", "piece",
                    F.least(F.lit(max_length), F.col("whole") - F.col("piece") * max_length).cast("int").alias("length")))


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", max_length: int = MAX_LENGTH,
         buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, piece, length, pad_to, batch, slot: the place of every piece of every document."""
    if budget < max_length:
        raise ValueError("a batch must have room for one sequence of max_length")
    pieces = staged(pieces_of(token_counts(docs, tokenizer), max_length))
    histogram = sorted((r["length"], r["many"]) for r in length_histogram(pieces).collect())
    bounds = best_bounds([x for x, _ in histogram], [m for _, m in histogram], buckets)
    if not bounds:
        return pieces.selectExpr("doc_id", "piece", "length", "0 as pad_to", "0L as batch", "0 as slot").limit(0)
    return place(pieces, bounds, budget, sum(m for _, m in histogram))


def place(pieces: DataFrame, bounds: list[int], budget: int, total: int) -> DataFrame:
    """Batch and slot of each piece, for given bucket bounds.  The shards grow with the root of the rows."""
    pad = F.lit(bounds[-1])
    for bound in reversed(bounds[:-1]):
        pad = F.when(F.col("length") <= bound, F.lit(bound)).otherwise(pad)
    shards = max(1, math.isqrt(total))
    dealt = pieces.withColumn("pad_to", pad).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    inside = Window.partitionBy("pad_to", "shard").orderBy("doc_id", "piece", "length")
    ranked = dealt.withColumn("rank", F.row_number().over(inside) - 1)
    before = Window.partitionBy("pad_to").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("pad_to", "shard").agg(F.count(F.lit(1)).alias("many"))
               .withColumn("offset", F.coalesce(F.sum("many").over(before), F.lit(0)))
               .select("pad_to", "shard", "offset"))
    room = F.floor(F.lit(budget) / F.col("pad_to")).cast("long")
    at = F.col("rank") + F.col("offset")
    return ranked.join(offsets, ["pad_to", "shard"]).select(
        "doc_id", "piece", "length", "pad_to", F.floor(at / room).alias("batch"), (at % room).cast("int").alias("slot"))
