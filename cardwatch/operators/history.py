"""A key's past, laid out so that no task has to hold a busy key.

A plain ``Window.partitionBy(key)`` puts everything a key ever did into one task, and a moving
RANGE frame is summed anew for every row. With a key that holds a third of all rows neither works. So
all keys take the same way, whatever their volume, and no job runs to find out which keys are busy.

*Slices.* The time line is cut into slices as long as the trailing window. Every row is put into its own
slice as an arrival and into the next one, moved by the window length, as a departure. The trailing total
at second ``t`` is then

    arrivals of the slice up to ``t``  +  departures of the slice at or after ``t``

Both are running sums (linear, no subtraction, so doubles do not cancel).

*Short windows* (:func:`short_history`): rows are dealt by key and block, a block being the slices of
about a day; departures are a key and a second. One shuffle, no join, the source is read once. Where the
row before is asked for, the first row of each block, which has none there, goes with the key's other
first rows, each of which brings its block's last point: at most one row for each day of the table. That
is a second shuffle.

*Long windows* (:class:`Timeline`, :func:`trailing_history`): a slice would hold too much of a busy key, so
rows are first combined to one per key and second, before any shuffle; a window group then has at most two
rows per second of the window. The totals come back to the rows by a left join on key and second. The side
of the totals has one row for each, so the adaptive skew join can split a second that holds very many
rows, such as a day of a busy customer where times are dates only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.functions.cleaning import epoch_seconds

KEY, SECOND, SLICE, BLOCK = "_key", "_sec", "_slice", "_block"
# The same as SECOND, but NULL for rows without a time.
WHEN = "_when"

# Stands for "no timestamp": outside the range of Spark timestamps, far from overflow.
NO_TIME = -(2**62)
DAY = 86_400


def _keyed(key: str, moment: str) -> dict[str, Column]:
    """Key and second without NULLs, so that plain equality joins them. NULL is a key."""
    when = epoch_seconds(moment)
    return {
        KEY: F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null")),
        WHEN: when,
        SECOND: F.coalesce(when, F.lit(NO_TIME)),
    }


def short_history(
    df: DataFrame,
    key: str,
    moment: str,
    width: int,
    order: Sequence[str] = (),
    point: Column | None = None,
    skip: Column | None = None,
    count: bool = True,
) -> DataFrame:
    """``df`` with ``_when``, its whole seconds, and, as asked for, what came before each row.

    ``_count``: the key's rows of the seconds ``[t - width, t]``. ``_prev``, if a ``point`` is given: a struct
    (``at``, ``was``) of the key's row before in the order of second and ``order``, however long ago; with
    ``skip``, of the last one before that is not to be skipped. Rows without a time are each other's only
    history.
    """
    carried = [F.struct(*df.columns).alias("row")]
    if point is not None:
        here = F.struct(epoch_seconds(moment).alias("at"), point.alias("was"))
        carried.append((here if skip is None else F.when(~skip, here)).alias("point"))
    laid = df.select(*[value.alias(name) for name, value in _keyed(key, moment).items()], F.struct(*carried).alias("_own"))
    if count:
        # A departure brings nothing but its key and second.
        nothing = F.lit(None).cast(laid.schema["_own"].dataType)
        arrival = F.struct(F.lit(0).alias("shift"), F.col("_own").alias("own"))
        departure = F.struct(F.lit(width).alias("shift"), nothing.alias("own"))
        laid = laid.select(KEY, WHEN, SECOND, F.inline(F.array(arrival, departure))).select(
            KEY, WHEN, (F.col(SECOND) + F.col("shift")).alias(SECOND), F.col("own").alias("_own")
        )
    laid = laid.withColumns({SLICE: slice_start(width), BLOCK: slice_start(-(-DAY // width) * width)})
    if point is not None:
        laid = _within_blocks(laid, order)
    if count:
        group = Window.partitionBy(KEY, BLOCK, SLICE)
        upto = group.orderBy(SECOND).rangeBetween(Window.unboundedPreceding, 0)
        onward = group.orderBy(F.col(SECOND).desc()).rangeBetween(Window.unboundedPreceding, 0)
        arrived, departing = F.count(F.when(_arrives(), 1)).over(upto), F.count(F.when(~_arrives(), 1)).over(onward)
        laid = laid.withColumn("_count", arrived + departing).filter(_arrives())
    if point is not None:
        laid = _over_blocks(laid, skip is not None)
    found = (["_count"] if count else []) + (["_prev"] if point is not None else [])
    return laid.select("_own.row.*", WHEN, *found)


def _arrives() -> Column:
    return F.col("_own").isNotNull()


def _within_blocks(laid: DataFrame, order: Sequence[str]) -> DataFrame:
    """``_prev`` as far as the block tells, ``_first`` for its first row, and the block's last point, ``_last``."""
    ordered = Window.partitionBy(KEY, BLOCK).orderBy(SLICE, SECOND, *[f"_own.row.{name}" for name in order])
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.col("_own.point")
    return laid.withColumns(
        {
            "_prev": F.last(point, ignorenulls=True).over(earlier),
            "_first": _arrives() & (F.count(F.when(_arrives(), 1)).over(earlier) == 0),
            "_last": F.last(point, ignorenulls=True).over(whole),
        }
    )


def _over_blocks(rows: DataFrame, skips: bool) -> DataFrame:
    """``_prev`` of each block's first row from the blocks before; with ``skips``, handed on to its others."""
    # First rows form a group for each key; other rows stay with their block, where nothing is asked for.
    rows = rows.withColumn("_stays", F.when(~F.col("_first"), F.col(BLOCK)))
    earlier = Window.partitionBy(KEY, "_stays").orderBy(SECOND).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.when(F.col("_first"), F.last(F.when(F.col("_first"), F.col("_last")), ignorenulls=True).over(earlier))
    rows = rows.withColumn("_carried", carried)
    if skips:
        block = Window.partitionBy(KEY, BLOCK)
        rows = rows.withColumn("_carried", F.first("_carried", ignorenulls=True).over(block))
    return rows.withColumn("_prev", F.coalesce("_prev", "_carried"))


class Timeline:
    """The rows of ``df`` with the columns by which windows and joins follow a key's past."""

    def __init__(self, df: DataFrame, key: str, moment: str, width: int):
        self.width = width
        self._key, self._moment = key, moment
        self.rows = self.follow(df)

    def follow(self, df: DataFrame) -> DataFrame:
        return df.withColumns(_keyed(self._key, self._moment))

    def ticks(self, *totals: Column) -> DataFrame:
        """One row per key and second."""
        return self.rows.groupBy(KEY, SECOND).agg(*totals)

    @staticmethod
    def recall(rows: DataFrame, history: DataFrame) -> DataFrame:
        """Give the rows what is known of their second."""
        return rows.join(history, [KEY, SECOND], "left")


def slice_start(width: int) -> Column:
    return F.col(SECOND) - F.pmod(F.col(SECOND), F.lit(width))


def trailing_history(ticks: DataFrame, width: int, totals: Sequence[str]) -> DataFrame:
    """Per tick, the totals over the seconds ``[t - width, t - 1]``.

    ``ticks`` has one row per (``_key``, ``_sec``). The named totals are replaced by their trailing
    sums (NULL where the frame is empty).
    """
    placed = (
        ticks.select(KEY, SECOND, *totals, F.explode(F.array(F.lit(0), F.lit(width))).alias("_shift"))
        .withColumn(SECOND, F.col(SECOND) + F.col("_shift"))
        .withColumn(SLICE, slice_start(width))
    )
    arrives = F.col("_shift") == 0
    group = Window.partitionBy(KEY, SLICE)
    before = group.orderBy(SECOND).rangeBetween(Window.unboundedPreceding, -1)
    onward = group.orderBy(F.col(SECOND).desc()).rangeBetween(Window.unboundedPreceding, 0)

    added = {}
    for name in totals:
        added[f"_in_{name}"] = F.sum(F.when(arrives, F.col(name))).over(before)
        added[f"_out_{name}"] = F.sum(F.when(~arrives, F.col(name))).over(onward)
    windowed = placed.withColumns(added).filter(arrives)
    return windowed.select(KEY, SECOND, *[_both(name).alias(name) for name in totals])


def _both(name: str) -> Column:
    """Arrivals plus departures; NULL only if neither has a row."""
    # Rows without a time are each other's only history, as in a RANGE frame.
    arrived = F.when(F.col(SECOND) == NO_TIME, F.col(name)).otherwise(F.col(f"_in_{name}"))
    departing = F.col(f"_out_{name}")
    return F.coalesce(arrived + departing, arrived, departing)
