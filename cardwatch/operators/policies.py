"""The access matrix as a table, and the same masks as SQL functions.

A policy table has the columns (group_name, table_name, column_name, rule). A row with a column names the
mask of that column for a group; a row without one (NULL) says which rows of the table the group sees:
``all``, or ``assigned`` for those of the regions assigned to the viewer. ``*`` stands for everybody, and
counts only where none of the viewer's groups has a row of its own. Where several groups of a viewer
differ, the one that shows more counts. A table without a row for the viewer is not theirs to read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cardwatch.functions.cleaning import decade, mask_pan
from cardwatch.operators.access import Viewer, visible_rows

EVERYBODY = "*"
POLICY = "group_name string, table_name string, column_name string, rule string"

# From what shows most to what shows least.
ROW_RULES = ("all", "assigned")
MASKS: dict[str, Callable[[Column], Column]] = {
    "plain": lambda value: value,
    "decade": decade,
    "last4": mask_pan,
    "digest": lambda value: F.sha2(value.cast("string"), 256),
    "hidden": lambda value: F.lit(None),
}
# Masks whose result is a text, whatever the column was: then it is one for every viewer.
TEXTS = frozenset({"last4", "digest"})


def policy_view(
    df: DataFrame,
    table_name: str,
    viewer: Viewer,
    policy: DataFrame,
    assignments: DataFrame | None = None,
    region_col: str = "region",
) -> DataFrame:
    """``df`` as the policy lets the viewer see it; raises ``PermissionError`` if not at all.

    The policy's rows for this one table are read while the view is built: as many as it has columns, times
    groups. Rows are filtered first, so a mask never hides what the filter needs.
    """
    rows = policy.filter(F.col("table_name") == table_name).select("group_name", "column_name", "rule").collect()
    _check(rows, table_name, df.columns)
    seen = _rule(rows, None, viewer, ROW_RULES)
    if seen is None:
        raise PermissionError(f"{viewer.email} has no access to {table_name}")
    if seen == "assigned":
        if assignments is None:
            raise ValueError(f"{table_name} is seen by region; give the assignments")
        # Who reads by assignment does so whatever other groups they are in.
        df = visible_rows(df, Viewer(viewer.email), assignments, region_col)
    masked = {}
    for name in sorted({row.column_name for row in rows} - {None}):
        rule = _rule(rows, name, viewer, tuple(MASKS)) or "hidden"
        text = any(row.column_name == name and row.rule in TEXTS for row in rows)
        masked[name] = MASKS[rule](F.col(name)).cast("string" if text else df.schema[name].dataType)
    return df.withColumns(masked)


def _rule(rows: Iterable[Row], column: str | None, viewer: Viewer, order: tuple[str, ...]) -> str | None:
    own = [row.rule for row in rows if row.column_name == column and row.group_name in viewer.groups]
    common = [row.rule for row in rows if row.column_name == column and row.group_name == EVERYBODY]
    return min(own or common, key=order.index, default=None)


def _check(rows: Iterable[Row], table_name: str, columns: list[str]) -> None:
    for row in rows:
        known = ROW_RULES if row.column_name is None else MASKS
        if row.rule not in known:
            raise ValueError(f"unknown rule {row.rule!r} for {table_name}.{row.column_name}")
        if row.column_name is not None and row.column_name not in columns:
            raise ValueError(f"the policy names {table_name}.{row.column_name}, which is not there")


# --- the masks in SQL --------------------------------------------------------------------------

#: Session functions for views written in SQL; Catalyst puts their bodies in the place of the calls. The
#: viewer's groups are an argument, since plain sessions know of none.
SQL_FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION mask_birth_year(birth_year INT, groups ARRAY<STRING>) RETURNS INT
       RETURN CASE WHEN array_contains(groups, 'fraud_risk_analysts') THEN (birth_year DIV 10) * 10
                   ELSE birth_year END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION mask_card_number(card_number STRING, groups ARRAY<STRING>) RETURNS STRING
       RETURN CASE WHEN array_contains(groups, 'compliance_auditors') THEN card_number
                   ELSE concat('****-****-****-', right(card_number, 4)) END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION sees_all_regions(groups ARRAY<STRING>) RETURNS BOOLEAN
       RETURN arrays_overlap(groups, array('compliance_auditors', 'fraud_risk_analysts'))""",
)


def register_sql_functions(spark: SparkSession) -> None:
    """``mask_birth_year``, ``mask_card_number`` and ``sees_all_regions`` for this session's SQL."""
    for statement in SQL_FUNCTIONS:
        spark.sql(statement)
