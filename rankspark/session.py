"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 384-dimension vectors: keep Arrow batches small enough for a Python worker
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app: str = "rankspark", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return os.path.join(base, uuid.uuid4().hex)


def written(frame: DataFrame) -> DataFrame:
    """Write a frame to the scratch folder and read it back: later uses do not recompute it."""
    path = scratch_dir(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)
