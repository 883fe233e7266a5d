"""Role-aware views: column masks and row filters as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.functions.cleaning import decade, mask_pan
from cardwatch.operators.ranking import global_ntile

# Group names the rules refer to.
ANALYSTS = "fraud_risk_analysts"
AUDITORS = "compliance_auditors"


@dataclass(frozen=True)
class Viewer:
    """Who is looking: an identity and the groups it belongs to."""

    email: str
    groups: frozenset[str] = frozenset()

    def belongs_to(self, *groups: str) -> bool:
        return not self.groups.isdisjoint(groups)


Mask = Callable[[Viewer, Column], Column]


def birth_year_mask(viewer: Viewer, value: Column) -> Column:
    """Analysts see the decade, everybody else the year."""
    return decade(value) if viewer.belongs_to(ANALYSTS) else value


def card_number_mask(viewer: Viewer, value: Column) -> Column:
    """Auditors see the number, everybody else its last four digits; a string for all."""
    return value.cast("string") if viewer.belongs_to(AUDITORS) else mask_pan(value)


def assign_regions(df: DataFrame, order_cols: tuple[str, ...] = ("longitude", "id"), buckets: int = 4) -> DataFrame:
    """Add ``region``: equal-sized buckets from west to east, ``Region_1`` and so on."""
    ranked = global_ntile(df, order_cols, buckets, "_bucket")
    return ranked.select(*df.columns, F.concat(F.lit("Region_"), F.col("_bucket").cast("string")).alias("region"))


def visible_rows(df: DataFrame, viewer: Viewer, assignments: DataFrame, region_col: str = "region") -> DataFrame:
    """Auditors and analysts see every row, others those of the regions assigned to them.

    ``assignments`` has the columns (rm_email, assigned_region).
    """
    if viewer.belongs_to(AUDITORS, ANALYSTS):
        return df
    mine = assignments.filter(F.col("rm_email") == viewer.email).select(
        F.col("assigned_region").alias(region_col)
    )
    return df.join(mine, region_col, "left_semi").select(*df.columns)


def secured_view(
    df: DataFrame,
    viewer: Viewer,
    masks: Mapping[str, Mask] | None = None,
    assignments: DataFrame | None = None,
    region_col: str = "region",
) -> DataFrame:
    """``df`` as the viewer may see it. Masks come last, so they never hide a value the filter needs."""
    seen = df if assignments is None else visible_rows(df, viewer, assignments, region_col)
    return seen.withColumns({name: mask(viewer, F.col(name)) for name, mask in (masks or {}).items()})
