"""Structured Streaming jobs: continuous ingestion and search-log windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dictionary import SkillDictionary
from ..operators.embedding import Embedder
from ..operators.shape import rows_at_most
from ..plans.ingest import accepted, parse_profiles, profile_texts, rejects
from ..session import written
from ..sources.keyed import KeyedTable

HASHES = "content_hash string, batch bigint, id string"
# Row numbers (longs) that may be sent to every task.
SENT_NUMBERS = 1_000_000
STORED = {"compression": "zstd"}


def ingest_stream(
    texts: DataFrame,
    path: str,
    checkpoint: str,
    dictionary: SkillDictionary,
    embedder: Embedder,
    model: str = "hashed",
) -> StreamingQuery:
    """Parse arriving texts (id, text) and append profiles, vectors and rejects.

    A batch writes into folders named by its number, so a batch that is repeated after a
    failure replaces its own output.  Of the texts with one content, the first batch that has it
    keeps the smallest id; their hashes are in a table dealt by the hash, of which a batch reads
    and rewrites only the folders of its own.
    """
    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        parsed_path = f"{path}/parsed/batch={number}"
        # the two texts repeat the resume: they are made again where profiles are written
        columns = parse_profiles(batch, dictionary).columns
        staged = parse_profiles(batch, dictionary).drop("text", "embedding_text").withColumn("_row", F.monotonically_increasing_id())
        staged.write.mode("overwrite").options(**STORED).parquet(parsed_path)
        parsed = session.read.parquet(parsed_path)
        hashes = KeyedTable(session, f"{path}/hashes", HASHES, "content_hash")
        good = accepted(parsed)
        # a batch that is repeated finds its own hashes: only those of others are known
        known = hashes.lookup(good).where(F.col("batch") != number).select("content_hash")
        first = written(first_of_content(good.select("content_hash", "id", "_row")).join(known, "content_hash", "left_anti"))
        profiles_path = f"{path}/profiles/batch={number}"
        chosen = rows_of(good, first).withColumns(profile_texts()).select(*[c for c in columns if c != "reject_reason"])
        chosen.write.mode("overwrite").options(**STORED).parquet(profiles_path)
        fresh = session.read.parquet(profiles_path)
        hashes.upsert(first.select("content_hash", F.lit(number).cast("bigint").alias("batch"), F.col("id").cast("string").alias("id")))
        vectors = embedder(fresh.select("id", F.col("embedding_text").alias("text")))
        vectors.withColumn("model", F.lit(model)).write.mode("overwrite").options(**STORED).parquet(
            f"{path}/vectors/batch={number}"
        )
        rejects(parsed).write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")

    return (
        texts.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_of_content(rows: DataFrame) -> DataFrame:
    """content_hash, id, _row: of the rows with one content hash the one with the smallest id, by a combining aggregate."""
    picked = rows.groupBy("content_hash").agg(F.min(F.struct("id", "_row")).alias("first"))
    return picked.select("content_hash", "first.*")


def rows_of(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows whose ``_row`` is among the chosen.  Mostly few are not: these are sent, and no row is shuffled."""
    others = written(rows.select("_row").join(chosen.select("_row"), "_row", "left_anti"))
    if rows_at_most(others, SENT_NUMBERS):
        return rows.join(F.broadcast(others), "_row", "left_anti")
    return rows.hint("merge").join(chosen.select("_row"), "_row", "left_semi")


def event_windows(
    events: DataFrame, width: str = "1 hour", late: str = "2 hours", when: str = "ts",
    by: tuple[str, ...] = ("event_type",),
) -> DataFrame:
    """Counts per time window and key; rows later than ``late`` are dropped by the watermark."""
    return (
        events.withColumn(when, F.col(when).cast("timestamp"))
        .withWatermark(when, late)
        .groupBy(F.window(when, width).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("sum_value"))
        .select(F.col("w.start").alias("window_start"), *by, "n_events", "sum_value")
    )


def newest_windows(batches: DataFrame, by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The last written row of each window, from the batches of a stream in update mode."""
    last = F.max_by(F.struct("n_events", "sum_value"), "batch").alias("last")
    return batches.groupBy("window_start", *by).agg(last).select("window_start", *by, "last.*")
