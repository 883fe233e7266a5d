"""Versioned tables on plain parquet: one folder per version and a manifest row that commits it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwatch.sources.paths import exists

CURRENT = "is_current"
MANIFEST = "version bigint, committed_at timestamp, note string"


@dataclass(frozen=True)
class SnapshotTable:
    """A table whose every publish is a new folder below ``root``. One writer at a time."""

    spark: SparkSession
    root: str

    def publish(
        self, df: DataFrame, committed_at: datetime, note: str = "", partition_by: Sequence[str] = ()
    ) -> int:
        """Write the next version, then its manifest row. Readers see it only after the second."""
        latest = self.history().agg(F.max("version")).first()[0]
        version = 0 if latest is None else latest + 1
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(self._data(version))
        row = self.spark.createDataFrame([(version, committed_at, note)], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return version

    def history(self) -> DataFrame:
        """The manifest: version, committed_at, note."""
        if not exists(self.spark, f"{self.root}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest")

    def find(self, version: int | None = None, timestamp: datetime | None = None) -> int:
        """The number of a version, or of the last one committed up to a moment; the newest by default."""
        wanted = F.lit(True)
        if version is not None:
            wanted = wanted & (F.col("version") == version)
        if timestamp is not None:
            wanted = wanted & (F.col("committed_at") <= F.lit(timestamp))
        newest, found = self.history().agg(F.max("version"), F.max(F.when(wanted, F.col("version")))).first()
        if found is None:
            raise ValueError(f"no such version of {self.root}")
        if found != newest and not exists(self.spark, self._own(found)):
            raise ValueError(f"version {found} of {self.root} has been removed")
        return found

    def read(self, version: int | None = None, timestamp: datetime | None = None) -> DataFrame:
        """A version as :meth:`find` finds it."""
        return self.spark.read.parquet(self._data(self.find(version, timestamp)))

    def read_if_any(self) -> DataFrame | None:
        """The newest version, or None before the first publish."""
        return self.read() if self.history().take(1) else None

    def read_versions(self, versions: Sequence[int]) -> DataFrame:
        """Several versions in one scan, with their number in ``version``; others are not opened."""
        everything = self.spark.read.option("basePath", f"{self.root}/data").parquet(
            *[self._data(version) for version in versions]
        )
        return everything.withColumn("version", F.col("version").cast("bigint"))

    def audit(self, versions: Sequence[int], column: str) -> DataFrame:
        """NULLs in ``column`` per version, in the order of versions."""
        return (
            self.read_versions(versions)
            .groupBy("version")
            .agg(F.count_if(F.col(column).isNull()).alias(f"null_{column}_rows"))
            .orderBy("version")
        )

    def expired(self, now: datetime, retention: timedelta = timedelta(hours=168)) -> DataFrame:
        """Versions that nobody could still want: replaced longer ago than ``retention``.

        A version is replaced when the next one is committed, so every moment within the retention
        stays readable. This is the dry run of :meth:`remove_expired`; the newest version is never in it.
        """
        # The manifest has one row per publish.
        replaced_at = F.lead("committed_at").over(Window.orderBy("version"))
        manifest = self.history().withColumn("replaced_at", replaced_at)
        return manifest.filter(F.col("replaced_at") < F.lit(now - retention))

    def remove_expired(self, now: datetime, retention: timedelta = timedelta(hours=168)) -> list[int]:
        """Delete the data of expired versions; their manifest rows stay as history."""
        versions = sorted(row.version for row in self.expired(now, retention).select("version").collect())
        jvm = self.spark._jvm
        for version in versions:
            path = jvm.org.apache.hadoop.fs.Path(self._own(version))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return versions

    def _data(self, version: int) -> str:
        return f"{self.root}/data/version={version}"

    def _own(self, version: int) -> str:
        """The folder that only this version needs."""
        return self._data(version)


@dataclass(frozen=True)
class DimensionTable(SnapshotTable):
    """A dimension with history. A version holds its current rows and the rows it closed.

    A closed row is written once, with the version that closed it, and read by all later ones; only
    current rows are written anew. Retention removes current rows of old versions and no closed ones.
    """

    def publish(
        self, df: DataFrame, committed_at: datetime, note: str = "", partition_by: Sequence[str] = (CURRENT,)
    ) -> int:
        """Write the result of a merge with :meth:`current` as its target: current and newly closed rows."""
        return super().publish(df, committed_at, note, partition_by)

    def read(self, version: int | None = None, timestamp: datetime | None = None) -> DataFrame:
        """Current rows of a version and the rows closed up to it, in one scan."""
        found = self.find(version, timestamp)
        stored = self.spark.read.option("basePath", f"{self.root}/data").parquet(f"{self.root}/data")
        # Partition values come back as text; a row without one counts as closed.
        current = F.coalesce(F.col(CURRENT).cast("string") == "true", F.lit(False))
        mine = F.when(current, F.col("version") == found).otherwise(F.col("version") <= found)
        return stored.filter(mine).withColumn(CURRENT, current).drop("version")

    def current(self) -> DataFrame | None:
        """The newest version's current rows, or None before the first publish."""
        return self.read().filter(CURRENT) if self.history().take(1) else None

    def _own(self, version: int) -> str:
        return f"{self._data(version)}/{CURRENT}=true"
