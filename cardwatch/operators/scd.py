"""Slowly changing dimensions as pure functions from one snapshot to the next.

Nothing is updated in place: a merge takes the previous snapshot and the new source and returns the
next snapshot, which the caller writes to a new place. Keys are unique on both sides, so the one
join per merge has no hot key; NULL or repeated keys in the source, and two current target rows of a
key, raise while the merge runs. Target rows whose ``is_current`` is NULL count as closed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID_FROM, VALID_TO, CURRENT = "effective_start", "effective_end", "is_current"


def changed_rows(
    source: DataFrame, current: DataFrame, keys: Sequence[str], tracked: Sequence[str]
) -> DataFrame:
    """Source rows that differ from the current row of their key in a tracked column.

    NULL counts as a value of its own. Keys that are not in ``current`` are no change.
    """
    old = current.select(*keys, F.struct(*tracked).alias("_old"))
    return (
        source.join(old, list(keys))
        .filter(_differs(tracked, lambda name: F.col(f"_old.{name}"), F.col))
        .select(*source.columns)
    )


def scd1_upsert(target: DataFrame | None, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows win; target rows without a source row stay. No history."""
    fresh = require_unique_keys(source, keys)
    if target is None:
        return fresh
    kept = target.join(source.select(*keys), list(keys), "left_anti")
    return kept.unionByName(fresh)


def scd2_merge(
    target: DataFrame | None,
    source: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    effective_ts: datetime | Column | None = None,
    scd1_cols: Sequence[str] = (),
) -> DataFrame:
    """A tracked change closes the current row and opens a new one.

    Columns outside ``tracked`` are not refreshed on rows that stay, but for ``scd1_cols``: those take the
    source's values in place on the current row. A row that is closed keeps what it had. ``effective_ts`` is
    one moment for the whole run, the clock by default.
    """
    return _next_snapshot(target, source, keys, tracked, None, effective_ts, scd1_cols)


def scd2_scd3_merge(
    target: DataFrame | None,
    source: DataFrame,
    keys: Sequence[str],
    scd2_cols: Sequence[str],
    scd3_col: str,
    effective_ts: datetime | Column | None = None,
    scd1_cols: Sequence[str] = (),
) -> DataFrame:
    """As :func:`scd2_merge` for ``scd2_cols``; a change of ``scd3_col`` alone is made in place.

    ``previous_<scd3_col>`` keeps the one value before. A new version takes the closed row's value
    there, changed or not.
    """
    return _next_snapshot(target, source, keys, scd2_cols, scd3_col, effective_ts, scd1_cols)


def require_unique_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``source`` itself, failing at run time on a NULL or repeated key."""
    return _one_per_key(source, keys, "several source rows for one merge key", null_key="NULL merge key")


def _one_per_key(rows: DataFrame, keys: Sequence[str], message: str, null_key: str | None = None) -> DataFrame:
    """The rows, failing at run time where a key has several.

    Rows are combined per key before the shuffle, so a key repeated millions of times is a few rows by
    the time its copies meet; the first of them stands for all until the failure is raised.
    """
    name = ", ".join(keys)
    any_null = reduce(or_, [F.col(key).isNull() for key in keys])
    told = F.raise_error(F.lit(f"{null_key}: {name}"))
    checked = rows.filter(F.when(any_null, told).otherwise(F.lit(True))) if null_key else rows
    others = [column for column in rows.columns if column not in keys]
    whole = F.struct(*others) if others else F.lit(True)
    counted = checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), F.first(whole).alias("_row"))
    repeated = F.raise_error(F.lit(f"{message}: {name}"))
    single = counted.filter(F.when(F.col("_copies") > 1, repeated).otherwise(F.lit(True)))
    return single.select(*[F.col(column) if column in keys else F.col(f"_row.{column}") for column in rows.columns])


def _differs(tracked, old, new) -> Column:
    return reduce(or_, [~old(name).eqNullSafe(new(name)) for name in tracked])


def _moment(effective_ts: datetime | Column | None) -> Column:
    if effective_ts is None:
        return F.current_timestamp()
    return effective_ts if isinstance(effective_ts, Column) else F.lit(effective_ts)


def _next_snapshot(
    target: DataFrame | None,
    source: DataFrame,
    keys: Sequence[str],
    tracked: Sequence[str],
    scd3_col: str | None,
    effective_ts: datetime | Column | None,
    scd1_cols: Sequence[str] = (),
) -> DataFrame:
    clash = sorted(set(scd1_cols) & {*keys, *tracked, scd3_col})
    if clash:
        raise ValueError(f"columns with two kinds of history: {clash}")
    moment = _moment(effective_ts).cast("timestamp")
    previous = f"previous_{scd3_col}" if scd3_col else None
    fresh = require_unique_keys(source, keys)

    if target is None:
        opened = {previous: F.lit(None).cast(source.schema[scd3_col].dataType)} if scd3_col else {}
        opened |= {
            VALID_FROM: moment,
            VALID_TO: F.lit(None).cast("timestamp"),
            CURRENT: F.lit(True),
        }
        return fresh.withColumns(opened)

    unknown = sorted(set(source.columns) - set(target.columns))
    if unknown:
        raise ValueError(f"source columns the target does not have: {unknown}")
    types = {field.name: field.dataType for field in target.schema.fields}

    def version(values: dict[str, Column]) -> Column:
        """A whole target row; columns not given are NULL."""
        return F.struct(
            *[values.get(name, F.lit(None)).cast(types[name]).alias(name) for name in target.columns]
        )

    old = {name: F.col(f"_old.{name}") for name in target.columns}
    new = {name: F.col(f"_new.{name}") for name in source.columns}
    opened = new | {VALID_FROM: moment, VALID_TO: F.lit(None), CURRENT: F.lit(True)}
    closed = version(old | {VALID_TO: moment, CURRENT: F.lit(False)})
    first = version(opened)
    refreshed = old | {name: new[name] for name in scd1_cols}
    successor = version(opened | ({previous: old[scd3_col]} if scd3_col else {}))

    cases = (
        F.when(F.col("_new").isNull(), F.array(version(old)))
        .when(F.col("_old").isNull(), F.array(first))
        .when(_differs(tracked, old.get, new.get), F.array(closed, successor))
    )
    if scd3_col:
        in_place = version(refreshed | {previous: old[scd3_col], scd3_col: new[scd3_col]})
        cases = cases.when(_differs([scd3_col], old.get, new.get), F.array(in_place))

    is_current = F.coalesce(F.col(CURRENT), F.lit(False))
    open_rows = _one_per_key(target.filter(is_current), keys, "several current target rows for one merge key")
    current = open_rows.select(*keys, F.struct(*target.columns).alias("_old"))
    arriving = fresh.select(*keys, F.struct(*source.columns).alias("_new"))
    emitted = current.join(arriving, list(keys), "full_outer").select(
        F.inline(cases.otherwise(F.array(version(refreshed))))
    )
    return target.filter(~is_current).unionByName(emitted)
