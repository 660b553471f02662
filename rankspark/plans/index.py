"""A stored index: postings, term statistics and vectors, written once and reused.

Without an index every search tokenises the pool again.  With one, a search reads only the
postings buckets of its own terms: the table is partitioned by a hash of the term, and the
bucket list of the queries prunes it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import lexical
from ..operators.shape import rows_at_most

# Postings aimed at in a file, and the most term buckets (folders) of an index.
FILE_POSTINGS, MOST_BUCKETS = 2_000_000, 4096


def _bucket(term: str, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class LexicalIndex:
    postings: DataFrame      # bucket, term, id, tf, dl
    frequencies: DataFrame   # term, df
    totals: DataFrame        # n_docs, avg_dl, buckets (one row)

    @classmethod
    def write(cls, pool: DataFrame, path: str, file_postings: int = FILE_POSTINGS) -> None:
        """Tokenise the pool.  Buckets follow the number of tokens; a bucket is dealt over so many
        tasks that even a term of every document makes files of about ``file_postings`` rows."""
        spark = pool.sparkSession
        docs = lexical.tokenized(pool)
        docs.select("id", F.size("tokens").alias("dl")).write.mode("overwrite").parquet(
            f"{path}/lengths"
        )
        sizes = spark.read.parquet(f"{path}/lengths").agg(
            F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"), F.sum("dl").alias("tokens")
        ).first()
        buckets = min(MOST_BUCKETS, math.ceil((sizes["tokens"] or 0) / file_postings) or 1)
        files = math.ceil(sizes["n_docs"] / file_postings) or 1
        rows = lexical.postings(docs).withColumn("bucket", _bucket("term", buckets))
        split = F.pmod(F.xxhash64("id"), F.lit(files))
        (
            rows.repartition("bucket", split)
            .sortWithinPartitions("bucket", "term")
            .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        )
        spark.read.parquet(f"{path}/postings").groupBy("term").agg(
            F.count(F.lit(1)).alias("df")
        ).write.mode("overwrite").parquet(f"{path}/frequencies")
        totals = [(sizes["n_docs"], sizes["avg_dl"], buckets)]
        spark.createDataFrame(totals, "n_docs long, avg_dl double, buckets int").write.mode(
            "overwrite").parquet(f"{path}/totals")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LexicalIndex:
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "frequencies", "totals")])

    def bm25(self, queries: DataFrame, limit: int = fixed.RETRIEVER_DEPTH) -> DataFrame:
        """BM25 hits from the stored tables (unrestricted queries)."""
        bounded = rows_at_most(queries)
        asked = lexical.query_term_rows(queries).select("scope", "term").distinct()
        many = self.totals.first()["buckets"]
        wanted = asked.select(_bucket("term", many).alias("bucket")).distinct().collect()  # <= MOST_BUCKETS
        used = self.postings.where(F.col("bucket").isin([r["bucket"] for r in wanted]))  # prunes folders
        n, mean = (self.totals.select(c).scalar() for c in ("n_docs", "avg_dl"))
        known = asked.join(self.frequencies, "term").withColumns({"n_docs": n, "avg_dl": mean})
        return lexical.bm25(queries, used, limit, statistics=known, bounded=bounded)
