"""A versioned fact table whose versions share the months that did not change."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.session import remove_folder
from cardwatch.sources.snapshots import SnapshotTable

YEAR, MONTH = "txn_year", "txn_month"
#: Year and month, or None for rows without a date.
Month = tuple[int, int] | None


def months_of(df: DataFrame) -> list[Month]:
    """The months that rows with ``txn_year`` and ``txn_month`` are in."""
    found = df.select(YEAR, MONTH).distinct().collect()
    return sorted(((r[0], r[1]) if r[0] is not None else None for r in found), key=lambda m: m or (0, 0))


def in_months(months: Iterable[Month]) -> Column:
    """Whether a row is in one of the months."""
    months = list(months)
    named = [year * 100 + month for year, month in filter(None, months)]
    number = F.col(YEAR) * 100 + F.col(MONTH)
    return F.when(number.isNull(), F.lit(None in months)).otherwise(number.isin(named))


@dataclass(frozen=True)
class MonthTable(SnapshotTable):
    """A version holds the months it was published with; a reader takes each month from the newest version
    that has it. The manifest's note lists them, so that nothing is looked for in the folders."""

    def publish_months(self, df: DataFrame, months: Iterable[Month], committed_at: datetime, mark: str = "") -> int:
        """The next version: ``df`` in place of these months. ``mark`` is kept with it, for the caller."""
        names = " ".join(_name(month) for month in months)
        return self.publish(df, committed_at, f"{mark}|{names}", partition_by=(YEAR, MONTH))

    def mark(self) -> str | None:
        """The newest version's mark; None before the first."""
        newest = self.history().agg(F.max_by("note", "version")).first()[0]
        return None if newest is None else newest.split("|")[0]

    def months(self, version: int | None = None) -> dict[str, int]:
        """The months of a version and the version that holds each. The manifest has a row per publish."""
        versions = self.history()
        if version is not None:
            versions = versions.filter(F.col("version") <= version)
        held: dict[str, int] = {}
        for row in versions.orderBy("version").collect():
            held |= dict.fromkeys(row.note.split("|")[1].split(), row.version)
        return held

    def read(self, version: int | None = None, timestamp: datetime | None = None) -> DataFrame:
        held = self.months(self.find(version, timestamp))
        paths = [f"{self._data(number)}/{name}" for name, number in held.items()]
        # The newest version tells the columns; the types of year and month cannot be told where all are NULL.
        stored = self.spark.read.parquet(self._data(max(held.values()))).schema
        fields = [field for field in stored.fields if field.name not in (YEAR, MONTH)]
        numbers = [T.StructField(name, T.IntegerType()) for name in (YEAR, MONTH)]
        reader = self.spark.read.schema(T.StructType(fields + numbers)).option("basePath", f"{self.root}/data")
        return reader.parquet(*paths).select(*[field.name for field in fields], YEAR, MONTH)

    def remove_expired(self, now: datetime, **retention) -> list[int]:
        """Delete the months of expired versions that every version still kept has from a later one."""
        expired = {row.version for row in self.expired(now, **retention).select("version").collect()}
        kept = [row.version for row in self.history().select("version").collect() if row.version not in expired]
        needed = {(number, name) for name, number in self.months(min(kept, default=None)).items()}
        for version in sorted(expired):
            own = {name for row in self.history().filter(F.col("version") == version).collect() for name in row.note.split("|")[1].split()}
            for name in own:
                if (version, name) not in needed:
                    remove_folder(self.spark, f"{self._data(version)}/{name}")
        return sorted(expired)

    def _own(self, version: int) -> str:
        return f"{self.root}/manifest"


def _name(month: Month) -> str:
    """The folder of a month as Spark's writer names it."""
    nothing = "__HIVE_DEFAULT_PARTITION__"
    year, number = month or (nothing, nothing)
    return f"{YEAR}={year}/{MONTH}={number}"
