"""A training corpus from documents: toxic texts, near-duplicates and test items go, secrets are
blacked out, and what is left is packed into length buckets.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``docs``.  SQL cannot express a trained score, tiling,
nested decoding or the optimal buckets, so there is none; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankspark.llm import decontaminate, minhash, packing, secrets, toxicity
from rankspark.llm.common import keep_only, read_table, staged

#: Near-duplicates in the pipeline: shingles of five words, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates; documents without words all stay."""
    return keep_only(docs, minhash.near_duplicates(docs, WORDS, PERCENT).filter("kept"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets blacked out."""
    return secrets.redacted(docs)


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_lengths),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus."""
    docs = read_table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = staged(docs)
    return docs


ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
