"""A table that is changed in place: one row for each key, dealt over folders by a hash of the key.

A change rewrites only the folders that hold one of its keys; a look-up reads only those of the
keys that it asks for.  What replaces a folder is first written beside the table, so a job that
dies before the last step leaves the old rows, and repeating a change gives the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

PARTITIONS = 64


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    schema: str              # columns as DDL, the key among them
    key: str = "id"
    partitions: int = PARTITIONS

    def _part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.partitions)).cast("int")

    def _stored(self) -> DataFrame:
        location = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        full = f"{self.schema}, part int"
        if not location.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(location):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._stored().drop("part")

    def _folders(self, keys: DataFrame):
        """The condition that prunes to the folders of the keys: at most ``partitions`` numbers."""
        used = keys.select(self._part().alias("part")).distinct().collect()
        return F.col("part").isin([r["part"] for r in used])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the given keys."""
        wanted = keys.select(F.col(self.key)).where(F.col(self.key).isNotNull()).distinct()
        return self._stored().where(self._folders(wanted)).join(wanted, self.key, "left_semi").drop("part")

    def _replace(self, touched: DataFrame, rows: DataFrame) -> None:
        """Write the new content of the folders of ``touched``; a folder left without rows keeps a marker."""
        columns = [*self.read().columns, "part"]
        held = written(rows.select(*columns))
        # A folder is replaced only if something is written to it: keys of none mark it.
        empty = touched.select(self._part().alias("part")).distinct().join(held.select("part").distinct(), "part", "left_anti")
        markers = empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.read().schema], "part")
        held.unionByName(markers).repartition("part").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.path}/rows")

    def upsert(self, rows: DataFrame, prefer: str | None = None) -> None:
        """Insert or replace.  Of several rows with one key the one with the smallest ``prefer`` (else the
        largest row) stays; rows without a key are left out."""
        columns = self.read().columns
        given = rows.select(*columns).where(F.col(self.key).isNotNull())
        row = F.struct(*[F.col(c) for c in columns])
        picked = F.min(F.struct(F.col(prefer).alias("_by"), row.alias("row"))) if prefer else F.max(F.struct(row.alias("row")))
        fresh = written(given.groupBy(F.col(self.key).alias("_key")).agg(picked.alias("_p")).select("_p.row.*"))
        kept = self._stored().where(self._folders(fresh) & F.col(self.key).isNotNull()).join(
            fresh.select(self.key), self.key, "left_anti")
        self._replace(fresh, kept.unionByName(fresh.withColumn("part", self._part())))

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows of the given keys."""
        gone = written(self.lookup(keys).select(self.key))
        kept = self._stored().where(self._folders(gone) & F.col(self.key).isNotNull()).join(gone, self.key, "left_anti")
        self._replace(gone, kept)

    def rows(self) -> DataFrame:
        """All rows, without the markers of folders that ran empty."""
        return self.read().where(F.col(self.key).isNotNull())
