"""Labelled training rows: the one place where the operators take a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crc_remainder(parts: int):
    """crc32 of the doc_id as text, modulo ``parts``; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


def usable_labels(labels: DataFrame, label: str, allowed) -> DataFrame:
    """doc_id, label of the rows that may be learnt from: label 0 or 1, with a doc_id, and ``allowed``."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return rows.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)


def training_rows(texts: DataFrame, labels: DataFrame, label: str, allowed, bound: int) -> DataFrame:
    """doc_id, text, label of at most about ``bound`` labelled rows, those first by a hash of doc_id.

    Only labels 0 and 1 of rows for which ``allowed`` holds are looked at.  The ids of the sample are
    at most about ``bound`` in number, so the texts are found by a broadcast join.
    """
    usable = usable_labels(labels, label, allowed)
    many = usable.count()
    share = min(1.0, bound / many) if many else 1.0
    hashed = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30))
    sample = usable.filter(hashed < int(share * (1 << 30))) if share < 1 else usable
    return texts.join(F.broadcast(sample), "doc_id")
