"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours and pairs one word apart, hashed into ``2**BITS`` places; a
text has each of them once.  Training goes over a bounded, documented sample of labelled rows
(``SAMPLE``): shards of at most about ``SHARD`` rows are learnt in parallel tasks, each with its own
per-coordinate rates, and their weights are averaged.  L1 leaves few weights that are not zero; only
those (at most ``2**BITS``) reach the scoring tasks.

Edge cases: a null or empty text is scored by the intercept alone; a row with a null doc_id is scored
and its ``held_out`` is null; repeated rows give repeated results; labels other than 0 and 1 are not
used; without usable labels every score is 0; an empty table gives no rows; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import each_text, sliced, texts_of
from rankspark.llm.sampling import crc_remainder, training_rows, usable_labels

BITS = 20
SAMPLE, SHARD = 20_000, 2_500
EPOCHS, ALPHA, BETA, L1, L2 = 5, 1.0, 1.0, 14.0, 0.05
#: ASCII letters in lower case, bytes of other alphabets as they are, anything else a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_NEXT, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str) -> np.ndarray:
    """Sorted places of the distinct features of a text; place 0 is the intercept."""
    words = text.encode().translate(_WORD_BYTES).split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    grams = [h, h[:-1] * _NEXT + h[1:], h[:-2] * _SKIP + h[2:] * _NEXT]
    mixed = np.concatenate(grams) * _SKIP
    return np.unique(np.concatenate([[0], 1 + (mixed >> np.uint64(65 - BITS)).astype(np.int64)]))


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not zero, after FTRL-proximal passes over the rows in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    positive = max(1, sum(y for _, y in rows))
    weight = {1: min(8.0, max(1.0, (len(rows) - positive) / positive)) ** 0.5, 0: 1.0}
    for _ in range(epochs):
        for at, y in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * weight[y]
            now = n[at]
            z[at] += g - (np.sqrt(now + g * g) - np.sqrt(now)) / ALPHA * w
            n[at] = now + g * g
    at = np.flatnonzero(np.abs(z) > L1)
    return at, weights(at)


def train(texts: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray] | None:
    """Averaged sparse weights, or None without usable labels."""
    rows = training_rows(texts, labels, "toxic", crc_remainder(5) != 0, sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [features(t).astype("<i4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "label": batch.column("label"), "places": pa.array(found, pa.binary())})

    shards = max(1, round(sample / SHARD))
    made = rows.select("doc_id", "label", "text").mapInArrow(extract, "doc_id long, label int, places binary")
    # few rows make one shard: a shard is worth averaging only when it has enough to learn from
    many = usable_labels(labels, "toxic", crc_remainder(5) != 0).count()
    shards = max(1, min(shards, many // SHARD))
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(order=[xxhash.xxh3_64_intdigest(str(i)) for i in frame["doc_id"]]).sort_values(
            ["order", "doc_id", "label", "places"])
        at, w = ftrl([(np.frombuffer(p, "<i4"), int(y)) for p, y in zip(frame["places"], frame["label"])])
        return pd.DataFrame({"places": [at.astype("<i4").tobytes()], "weights": [w.astype("<f8").tobytes()]})

    parts = dealt.groupBy("shard").applyInPandas(learn, "places binary, weights binary").collect()
    if not parts:
        return None
    total = np.zeros(1 << BITS)
    for p in sorted(parts, key=lambda r: (len(r["places"]), bytes(r["places"]))):
        total[np.frombuffer(p["places"], "<i4")] += np.frombuffer(p["weights"], "<f8")
    at = np.flatnonzero(total)
    return at, total[at] / len(parts)


class _Scorer:
    """Scores of texts by a sparse model, spread out once for a task."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray] | None):
        self.dense = None if model is None else np.zeros(1 << BITS)
        if model is not None:
            self.dense[model[0]] = model[1]

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.dense is None:
            return np.zeros(len(texts))
        sums = np.array([self.dense[features(t)].sum() for t in texts], float)
        return 1 / (1 + np.exp(-np.clip(sums, -700, 700)))


def score_texts(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for keys, texts in each_text(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(keys, pa.int64()), "score": pa.array(scorer(texts))})

    scored = texts_of(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", (crc_remainder(5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score_texts(docs, train(texts_of(docs), labels, sample))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(train(texts_of(docs), labels, sample))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in sliced(batches):
            yield batch.filter(pa.array(scorer([t or "" for t in batch.column("text").to_pylist()]) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
