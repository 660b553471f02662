"""Readers, writers and maintenance of the tables around a search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOGGED_RESULTS = 20


def stable_id(*keys: str) -> Column:
    """A 60-bit id from the key values: the same on every run, with no global counter."""
    joined = F.concat_ws("\u001f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def get_or_create(
    dim: DataFrame, incoming: DataFrame, keys: Sequence[str], id_col: str, order: str | None = None
) -> DataFrame:
    """``dim`` plus a row for every new key; other attributes come from the first row by ``order``.

    Both sides are compared on coalesced keys, so a missing part of a key is a value like any
    other.  Attributes are picked by a combining aggregate, not by gathering a key's rows.
    """
    filled = incoming.withColumns({k: F.coalesce(F.col(k), F.lit("Unknown")) for k in keys})
    rest = [c for c in dim.columns if c not in (*keys, id_col)]
    if rest and order:
        picked = F.min_by(F.struct(*rest), order).alias("_first")
    else:
        picked = F.first(F.struct(*rest) if rest else F.lit(1)).alias("_first")
    fresh = filled.groupBy(*keys).agg(picked).join(dim.select(*keys), list(keys), "left_anti")
    added = fresh.withColumn(id_col, stable_id(*keys))
    columns = [F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in dim.columns]
    return dim.unionByName(added.select(*columns))


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows), counted on the executors - from file footers where possible."""
    counted = [
        frame.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows"
        )
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def log_frames(
    results: DataFrame, queries: DataFrame, strategy: str, reranked: bool, when: Column
) -> tuple[DataFrame, DataFrame]:
    """The two log tables of a search: one row per query, and its first results."""
    counts = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("result_count"))
    head = queries.join(counts, "query_id", "left").select(
        "query_id", "raw_query", F.lit(strategy).alias("strategy"), F.lit(reranked).alias("rerank"),
        F.coalesce("result_count", F.lit(0)).alias("result_count"), when.alias("created_at"),
    )
    lines = results.where(F.col("rank") <= LOGGED_RESULTS).select(
        "query_id", "id", "rank", "score", "components", when.alias("created_at")
    )
    return head, lines


def append_log(frames: tuple[DataFrame, DataFrame], path: str) -> None:
    """Append both log tables, partitioned by day."""
    for frame, name in zip(frames, ("queries", "results"), strict=True):
        (
            frame.withColumn("day", F.to_date("created_at"))
            .write.mode("append").partitionBy("day").parquet(f"{path}/{name}")
        )


def recent(log: DataFrame, n: int = 20, when: str = "created_at") -> DataFrame:
    """Newest ``n`` rows: every task keeps n rows, nothing is sorted as a whole."""
    return log.orderBy(F.desc(when)).limit(n)


def snapshot(log_queries: DataFrame, log_results: DataFrame) -> DataFrame:
    """Logged queries with their ranked results."""
    return log_queries.join(log_results, "query_id")


def saved_run_stats(saved: DataFrame, runs: DataFrame, when: str = "created_at") -> DataFrame:
    """Saved searches with run counter and last run, derived from the log; never run is 0."""
    stats = runs.groupBy("saved_id").agg(
        F.count(F.lit(1)).alias("run_count"), F.max(when).alias("last_run_at")
    )
    return saved.join(stats, "saved_id", "left").fillna(0, ["run_count"])


def delete_by_id(table: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """The table without the named rows, to be written over it."""
    return table.join(gone.select(key), key, "left_anti")


def latest(runs: DataFrame, when: str = "created_at") -> DataFrame:
    """The newest run as one row: a combining aggregate instead of a sort."""
    picked = F.max_by(F.struct(*runs.columns), when).alias("run")
    return runs.agg(picked).select("run.*")


def list_page(
    profiles: DataFrame, text: str | None = None, skill: str | None = None,
    mentions: DataFrame | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page ordered by id, with the number of all matching rows.

    The total is a scalar subquery and the page a top-n, so no window over all rows is needed.
    """
    out = profiles
    if text:
        pattern = "%" + text.replace("\\", r"\\").replace("%", r"\%").replace("_", r"\_") + "%"
        out = out.where(F.col("full_name").ilike(pattern) | F.col("headline").ilike(pattern))
    if skill:
        having = mentions.where(F.contains(F.lower("raw"), F.lit(skill.lower()))).select(
            F.col("candidate_id").alias("id")
        )
        out = out.join(having, "id", "left_semi")
    total = out.agg(F.count(F.lit(1))).scalar()
    return out.orderBy("id").offset(offset).limit(limit).withColumn("total", total)


def profile_detail(
    profiles: DataFrame, mentions: DataFrame, experiences: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """Profiles with their children gathered: skills in order, experiences by sort_order.

    ``ids`` restricts every side before children are gathered.
    """
    if ids is not None:
        profiles = profiles.join(ids, "id", "left_semi")
        keys = ids.withColumnRenamed("id", "candidate_id")
        mentions = mentions.join(keys, "candidate_id", "left_semi")
        experiences = experiences.join(keys, "candidate_id", "left_semi")
    label = F.coalesce("canonical", F.lower("raw"))
    skills = mentions.groupBy(F.col("candidate_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("sort_order", label.alias("skill")))).alias("_s")
    )
    columns = [c for c in experiences.columns if c not in ("candidate_id", "sort_order")]
    roles = experiences.groupBy(F.col("candidate_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("sort_order", *columns))).alias("experiences")
    )
    return (
        profiles.join(skills, "id", "left").join(roles, "id", "left")
        .withColumn("skills", F.col("_s.skill"))
        .drop("_s")
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: id from the file name, and the whole text."""
    files = spark.read.text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return files.select(name.alias("file"), F.col("value").alias("text")).withColumn(
        "id", stable_id("file")
    )


def reload(tables: Mapping[str, DataFrame], path: str) -> None:
    """Replace every table."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
