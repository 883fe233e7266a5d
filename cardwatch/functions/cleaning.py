"""Column expressions that clean and recode raw values. All stay inside code generation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw channel label -> conformed channel.
CHANNEL_NAMES = {
    "Swipe Transaction": "swipe",
    "Chip Transaction": "chip",
    "Online Transaction": "online",
}

# Upper income bound (exclusive) -> tier.
INCOME_TIERS = ((30000, "low"), (80000, "medium"), (150000, "high"))


def as_column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def parse_currency(value: str | Column) -> Column:
    """``$59,696.00`` to a double; NULL where no finite number is left."""
    number = F.regexp_replace(as_column(value), "[$,]", "").try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def clean_zip(value: str | Column) -> Column:
    """``2134.0`` or ``501`` to a five-character code; NULL where it is no number.

    Of a longer number the first five digits are kept, as the contract of the raw files has it, so
    ``123456`` and ``123450`` become one code.
    """
    whole = as_column(value).try_cast("double").try_cast("bigint")
    return F.lpad(whole.cast("string"), 5, "0")


def income_tier(income: str | Column) -> Column:
    income = as_column(income)
    tier = F.when(income.isNull(), "unknown")
    for bound, name in INCOME_TIERS:
        tier = tier.when(income < bound, name)
    return tier.otherwise("very_high")


def recode(value: str | Column, names: Mapping[str, str]) -> Column:
    """Look the value up in a literal map; unknown values pass through."""
    value = as_column(value)
    table = F.create_map(*[F.lit(part) for pair in names.items() for part in pair])
    return F.coalesce(table[value], value)


def mask_pan(number: str | Column) -> Column:
    """All but the last four digits of a card number hidden."""
    return F.concat(F.lit("****-****-****-"), F.substring(as_column(number).cast("string"), -4, 4))


def decade(year: str | Column) -> Column:
    """1987 to 1980 (whole-number division towards zero)."""
    year = as_column(year)
    return year - year % 10


def epoch_seconds(moment: str | Column) -> Column:
    """Whole seconds since 1970, rounded down; takes timestamps with or without time zone."""
    return as_column(moment).cast("timestamp").cast("bigint")
