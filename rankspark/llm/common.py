"""Parts that several operators share: input columns, staging, worker-side text access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.session import written


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (a null text is an empty one): other columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def staged(frame: DataFrame) -> DataFrame:
    """Write to the shared scratch folder and read back: lineage ends at files all executors reach."""
    return written(frame)


#: Bytes of text that a worker turns into Python objects at a time; one longer text stands alone.
SLICE_BYTES = 4 << 20


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut by the bytes of their texts: what an operator holds for one of them stays bounded."""
    for batch in batches:
        at, sizes = 0, pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        while at < len(ends):
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of slices of every Arrow batch."""
    for part in sliced(batches):
        yield part.column("doc_id").to_pylist(), part.column("text").to_pylist()


def keep_only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, with their own columns; rows without a doc_id stay.

    A doc_id that occurs more than once is one document: its rows share one fate.
    """
    keys = ids.select(F.col("doc_id").alias("_kept_id")).distinct()
    found = docs.join(keys, docs["doc_id"] == keys["_kept_id"], "left_semi")
    return found.unionByName(docs.filter(F.col("doc_id").isNull()))
