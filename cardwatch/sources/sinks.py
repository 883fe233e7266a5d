"""Layouts for written tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_month(df: DataFrame, ts_col: str = "date") -> DataFrame:
    return df.withColumns({"txn_year": F.year(ts_col), "txn_month": F.month(ts_col)})


def write_by_month(df: DataFrame, path: str, ts_col: str = "date") -> None:
    """Write partitioned by year and month of ``ts_col``.

    The shuffle is by range of the timestamp: a busy month is cut into several files instead of
    going through one task, and a task touches few months.
    """
    (
        with_month(df, ts_col)
        .repartitionByRange(ts_col)
        .write.mode("overwrite")
        .partitionBy("txn_year", "txn_month")
        .parquet(path)
    )


def write_clustered(
    df: DataFrame, path: str, cols: Sequence[str] = ("client_id", "card_id"), files: int | None = None
) -> None:
    """Write sorted by ``cols`` so that row-group statistics let readers skip most of the table."""
    ranged = df.repartitionByRange(files, *cols) if files else df.repartitionByRange(*cols)
    ranged.sortWithinPartitions(*cols).write.mode("overwrite").parquet(path)


def write_interleaved(
    df: DataFrame, path: str, cols: Sequence[str] = ("client_id", "card_id"), files: int | None = None, bits: int = 8
) -> None:
    """Write along a space-filling curve over ``cols``, so that a filter on any of them skips files.

    Sorting by several columns clusters by the first alone. Here each column is cut into ``2 ** bits`` ranges
    of about equal counts (one job), and the bits of the range numbers are interleaved to a place on the
    Z-curve; files are ranges of places. A place that holds very many rows is cut on by the columns
    themselves.
    """
    placed = df.withColumn("_place", curve_place(df, cols, bits))
    order = ["_place", *cols]
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).drop("_place").write.mode("overwrite").parquet(path)


def curve_place(df: DataFrame, cols: Sequence[str], bits: int = 8) -> Column:
    """A row's place on the Z-curve over ``cols``; runs one job for the borders of their ranges."""
    if bits * len(cols) > 62:
        raise ValueError("a place has at most 62 bits")
    shares = [k / 2**bits for k in range(1, 2**bits)]
    measures = [_ordinal(df, name) for name in cols]
    borders = df.select(
        *[F.percentile_approx(m, shares, 100_000).alias(f"_{k}") for k, m in enumerate(measures)]
    ).first()
    place = F.lit(0).cast("long")
    for k, measure in enumerate(measures):
        # An empty column has no borders.
        number = _range_number(measure, borders[k] or [], bits)
        for bit in range(bits):
            one = F.shiftright(number, bit).bitwiseAND(1).cast("long")
            place = place.bitwiseOR(F.shiftleft(one, bit * len(cols) + len(cols) - 1 - k))
    return place


def _ordinal(df: DataFrame, name: str) -> Column:
    """A number in the order of the column's values; of texts, their first seven bytes."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType | T.BinaryType):
        start = F.rpad(F.hex(F.substring(value.cast("binary"), 1, 7)), 14, "0")
        return F.conv(start, 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return value.cast("double")


def _range_number(value: Column, borders: Sequence[float], bits: int) -> Column:
    """How many borders are below the value, by halving; NULL comes first."""
    if not borders:
        return F.lit(0)
    known = F.array(*[F.lit(border) for border in borders])
    steps = F.array(*[F.lit(2**bit) for bit in reversed(range(bits))])
    moved = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.element_at(known, at + step) < value, at + step).otherwise(at),
    )
    return F.when(value.isNull(), 0).otherwise(moved)


def with_column_comments(df: DataFrame, comments: Mapping[str, str]) -> DataFrame:
    """Attach column comments; they are kept by parquet and shown by ``DESCRIBE`` on saved tables."""
    for name, comment in comments.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "comment": comment})
    return df
