"""Keyed tables on Parquet: each write makes a new version, and readers follow a pointer to the latest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    """A folder of tables; no row-level changes, so that every reader sees one whole version."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False):
        self.spark, self.path, self.read_only = spark, path.rstrip("/"), read_only

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[str]:
        """Names of the finished versions of a table, oldest first."""
        p, fs = self._fs(f"{self.path}/{table}")
        if not fs.exists(p):
            return []
        done = [x.getPath() for x in fs.listStatus(p)]
        return sorted(x.getName() for x in done if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS")))

    def read(self, table: str) -> DataFrame | None:
        """The latest version, or None before the first write."""
        names = self.versions(table)
        return self.spark.read.parquet(f"{self.path}/{table}/{names[-1]}") if names else None

    def _write(self, table: str, df: DataFrame) -> None:
        if self.read_only:
            raise PermissionError("the store is read-only")
        n = len(self.versions(table))
        df.write.parquet(f"{self.path}/{table}/{n:08d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, table: str, rows: DataFrame, key: list[str], keep: tuple[str, ...] = ()) -> int:
        """Replace rows of equal key, add the others, and return how many were added.

        keep: columns whose stored value stays when a row is replaced.  rows must
        have one row per key; rows with a null in the key are refused.
        """
        bad = F.lit(False)
        for k in key:
            bad = bad | F.col(k).isNull()
        if rows.where(bad).limit(1).count() or rows.groupBy(*key).count().where("count > 1").limit(1).count():
            raise ValueError("rows need one row per key, without nulls in it")
        old = self.read(table)
        if old is None:
            self._write(table, rows)
            return rows.count()
        kept = old.select(*key, *[F.col(c).alias(f"_{c}") for c in keep], F.lit(True).alias("_old"))
        joined = rows.join(kept, key, "left")
        merged = joined.select(*[F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in keep else F.col(c) for c in rows.columns])
        added = joined.where("_old IS NULL").count()
        self._write(table, old.join(rows.select(*key), key, "left_anti").unionByName(merged, allowMissingColumns=True))
        return added

    def replace_partition(self, table: str, rows: DataFrame, key: str, value) -> None:
        """All rows whose `key` equals value are replaced by rows, in one version."""
        old = self.read(table)
        rest = old.where(~F.col(key).eqNullSafe(F.lit(value))) if old is not None else None
        self._write(table, rows if rest is None else rest.unionByName(rows, allowMissingColumns=True))

    def prune(self, table: str, versions: int = 2) -> None:
        """Delete all but the latest versions."""
        for name in self.versions(table)[:-versions]:
            p, fs = self._fs(f"{self.path}/{table}/{name}")
            fs.delete(p, True)
