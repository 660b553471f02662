"""Stored searches, job descriptions and benchmark runs.

A saved search is created, re-run and deleted.  ``rerun`` keeps its nearest vectors: what was added or
changed since its last run is searched, and merged with the hits that it has; only searches that
lost a hit (its row is gone or changed) look at the whole pool again, for a row behind the last hit may
now belong to it.  The answer is that of a full run.  Searches by words depend on the whole pool's
statistics and are re-run in full by ``jobs.run_saved``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import vector
from ..operators.shape import rows_at_most, top_k
from ..session import written
from ..sources.keyed import KeyedTable
from ..sources.tables import stable_id
from .jobs import job_queries
from .search import Engine

HITS = "array<struct<rank:int,id:bigint,score:double>>"


@dataclass(frozen=True)
class SavedSearches:
    spark: SparkSession
    path: str
    engine: Engine
    depth: int = fixed.RETRIEVER_DEPTH
    partitions: int = 64

    @property
    def searches(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/searches", "saved_id bigint, name string, raw string", "saved_id", self.partitions)

    @property
    def state(self) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/state", f"saved_id bigint, seen bigint, hits {HITS}", "saved_id", self.partitions)

    def create(self, rows: DataFrame) -> None:
        """Save searches (saved_id, name, raw); one that is saved again starts anew."""
        rows = written(rows.select("saved_id", "name", "raw"))
        self.state.delete(rows)
        self.searches.upsert(rows)

    def delete(self, ids: DataFrame) -> None:
        """Remove searches with what they found; their runs stay in the log."""
        self.state.delete(ids)
        self.searches.delete(ids)

    def runs(self) -> DataFrame:
        """The log: saved_id, seen, whole, n_results, ran_at."""
        return self.spark.read.schema("saved_id bigint, seen bigint, whole boolean, n_results int, ran_at timestamp").parquet(f"{self.path}/runs")

    def rerun(self, vectors: DataFrame, when: Column | None = None) -> DataFrame:
        """Run every saved search over ``vectors`` (id, embedding, version): saved_id, rank, id, score.

        ``version`` grows with every change of the pool; a row that is changed gets the newest one, a row
        that is gone is missing.
        """
        newest = vectors.agg(F.coalesce(F.max("version"), F.lit(0)).cast("bigint")).first()[0]
        saved = self.searches.rows()
        state = written(self.state.rows().join(saved.select("saved_id"), "saved_id"))
        held = state.select("saved_id", "seen", F.explode("hits").alias("h")).select("saved_id", "seen", "h.id", "h.score")
        current = vectors.select("id", "version").join(held.select("id").distinct(), "id", "left_semi")
        kept = held.join(current, (held["id"] == current["id"]) & (current["version"] <= held["seen"]), "left_semi")
        lost = written(held.join(kept.select("saved_id", "id"), ["saved_id", "id"], "left_anti").select("saved_id").distinct())
        asked = written(self.engine.embed(saved.select(F.col("saved_id").alias("id"), F.col("raw").alias("text"))).select(
            F.col("id").alias("query_id"), "embedding"))
        partial = state.join(lost, "saved_id", "left_anti").select(F.col("saved_id").alias("query_id"), "seen")
        whole = asked.join(partial, "query_id", "left_anti")
        found = vector.vector_topk(whole, vectors.select("id", "embedding"), self.depth).select("query_id", "id", "score")
        # searches that have seen the same version share what was added since; a pool has few versions
        seen = [r["seen"] for r in partial.select("seen").distinct().collect()]
        for number in seen:
            added = vectors.where(F.col("version") > number).select("id", "embedding")
            own = asked.join(partial.where(F.col("seen") == number).select("query_id"), "query_id", "left_semi")
            if not rows_at_most(added, 0):
                found = found.unionByName(vector.vector_topk(own, added, self.depth).select("query_id", "id", "score"))
        earlier = kept.join(lost, "saved_id", "left_anti").select(F.col("saved_id").alias("query_id"), "id", "score")
        ranked = written(top_k(found.unionByName(earlier), ["query_id"], [F.desc("score"), F.asc("id")], self.depth))
        lists = ranked.groupBy(F.col("query_id").alias("saved_id")).agg(
            F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("hits"))  # at most ``depth``
        none = F.array().cast(HITS)
        done = saved.select("saved_id").join(lists, "saved_id", "left").select(
            "saved_id", F.lit(newest).cast("bigint").alias("seen"), F.coalesce("hits", none).cast(HITS).alias("hits"))
        done = written(done)
        self.state.upsert(done)
        log = done.join(whole.select(F.col("query_id").alias("saved_id"), F.lit(True).alias("w")), "saved_id", "left")
        log.select("saved_id", "seen", F.coalesce("w", F.lit(False)).alias("whole"), F.size("hits").alias("n_results"),
                   (when if when is not None else F.current_timestamp()).alias("ran_at")).write.mode("append").parquet(f"{self.path}/runs")
        return ranked.select(F.col("query_id").alias("saved_id"), "rank", "id", "score")


def store_jobs(jobs: DataFrame, engine: Engine, path: str) -> DataFrame:
    """Append pasted job descriptions (jd_text [, title]) with what was parsed; they get an id from their text."""
    title = F.col("title") if "title" in jobs.columns else F.lit(None).cast("string")
    named = jobs.select("jd_text", title.alias("title")).withColumn("job_id", stable_id("title", "jd_text")).dropDuplicates(["job_id"])
    named = written(named)
    parsed = job_queries(named, engine).withColumnRenamed("query_id", "job_id")
    rows = written(named.join(parsed, "job_id").withColumn("created_at", F.current_timestamp()))
    rows.write.mode("append").parquet(path)
    return rows


def store_run(measures: DataFrame, path: str, when: Column | None = None) -> None:
    """Append a benchmark run: one row that holds the measures of each strategy, as ``latest`` reads it."""
    columns = [c for c in measures.columns if c != "strategy"]
    entry = F.struct(F.col("strategy"), *[F.col(c) for c in columns])
    run = measures.agg(F.array_sort(F.collect_list(entry)).alias("measures"))  # a row for each strategy
    run.select((when if when is not None else F.current_timestamp()).alias("created_at"), "measures").write.mode("append").parquet(path)
