"""The four explainable risk rules over a whole table of transactions.

How a key's past is reached without holding a busy key in one task is told in
:mod:`cardwatch.operators.history`. No rule runs a job while it is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.functions.geo import haversine_km, known_degrees
from cardwatch.functions.scoring import with_risk_columns
from cardwatch.operators.history import WHEN, Timeline, short_history, trailing_history
from cardwatch.settings import DEFAULTS, RuleSettings

SECONDS_PER_HOUR = 3600.0


def apply_amount_rule(
    df: DataFrame, amount_col: str = "amount", settings: RuleSettings = DEFAULTS
) -> DataFrame:
    """Strictly above the threshold. Needs no history, so it serves streams too."""
    return df.withColumn("flag_amount_threshold", F.col(amount_col) > settings.amount_threshold)


def apply_velocity_rule(
    df: DataFrame, card_col: str = "card_id", ts_col: str = "date", settings: RuleSettings = DEFAULTS
) -> DataFrame:
    """Count a card's rows over the last window of whole seconds, both ends included."""
    rows = short_history(df, card_col, ts_col, settings.velocity_window_seconds)
    return rows.select(*df.columns, *_velocity_columns(settings))


def apply_geo_jump_rule(
    df: DataFrame,
    card_col: str = "card_id",
    ts_col: str = "date",
    lat_col: str = "merchant_latitude",
    lon_col: str = "merchant_longitude",
    tie_break: str = "id",
    settings: RuleSettings = DEFAULTS,
) -> DataFrame:
    """Speed since the card's previous row, in the order of time and ``tie_break``.

    The flag is NULL where the previous place is known but no speed can be told: the present place
    is unknown or no whole second has passed. ``settings`` may pass over rows without a place, or forget a
    place after some time; a row whose place before is forgotten has none. A card's rows of about a day
    are ordered in one task.
    """
    places = _Places(lat_col, lon_col, settings)
    order = _order(df, ts_col, tie_break)
    rows = short_history(
        df, card_col, ts_col, settings.velocity_window_seconds, order, places.place, places.skip, count=False
    )
    return rows.select(*df.columns, *places.columns())


def apply_card_rules(
    df: DataFrame,
    card_col: str = "card_id",
    ts_col: str = "date",
    lat_col: str = "merchant_latitude",
    lon_col: str = "merchant_longitude",
    tie_break: str = "id",
    settings: RuleSettings = DEFAULTS,
) -> DataFrame:
    """Velocity and geo-jump together, over one layout of the rows."""
    places = _Places(lat_col, lon_col, settings)
    order = _order(df, ts_col, tie_break)
    rows = short_history(df, card_col, ts_col, settings.velocity_window_seconds, order, places.place, places.skip)
    return rows.select(*df.columns, *_velocity_columns(settings), *places.columns())


def apply_spending_deviation_rule(
    df: DataFrame,
    customer_col: str = "client_id",
    ts_col: str = "date",
    amount_col: str = "amount",
    settings: RuleSettings = DEFAULTS,
) -> DataFrame:
    """Compare with the mean of the customer's trailing days, rows of the same second left out.

    The mean has the type that ``avg`` gives the amount, and for decimals its value.
    """
    return _deviation(df, df, customer_col, ts_col, amount_col, settings)


def score_all_rules(df: DataFrame, settings: RuleSettings = DEFAULTS) -> DataFrame:
    """All four rules and the verdict, for rows with the standard transaction columns and
    ``merchant_latitude``/``merchant_longitude``.

    The rows are shuffled by card, once more for the first rows of a day, and by customer; the customers'
    totals are taken from ``df`` itself in a narrow pass. Hand in a written table rather than a long chain
    of joins.
    """
    by_card = apply_card_rules(apply_amount_rule(df, settings=settings), settings=settings)
    judged = _deviation(by_card, df, "client_id", "date", "amount", settings)
    return with_risk_columns(judged, settings=settings)


def _deviation(
    df: DataFrame, source: DataFrame, customer_col: str, ts_col: str, amount_col: str, settings: RuleSettings
) -> DataFrame:
    """``df`` extended by the rule; histories are made of ``source``, which has the same rows."""
    customers = Timeline(source, customer_col, ts_col, settings.deviation_window_seconds)
    ticks = customers.ticks(F.sum(amount_col).alias("_spent"), F.count(amount_col).alias("_payments"))
    history = trailing_history(ticks, customers.width, ["_spent", "_payments"])
    # As wide as a plain sum, so that a decimal quotient keeps digits enough to be rounded once.
    total, kind = (source.select(f(amount_col)).schema[0].dataType for f in (F.sum, F.avg))
    mean = F.when(F.col("_payments") > 0, (F.col("_spent").cast(total) / F.col("_payments")).cast(kind))
    rows = customers.recall(customers.follow(df), history).withColumn("_mean", mean)
    above = F.col(amount_col) > F.col("_mean") * settings.deviation_multiplier
    return rows.select(
        *df.columns,
        F.col("_mean").alias("trailing_30d_avg_amount"),
        (F.col("_mean").isNotNull() & above).alias("flag_spending_deviation"),
    )


def _velocity_columns(settings: RuleSettings) -> list[Column]:
    count = F.col("_count")
    return [count.alias("txn_count_in_window"), (count >= settings.velocity_count).alias("flag_velocity")]


def _order(df: DataFrame, ts_col: str, tie_break: str) -> list[str]:
    return [name for name in (ts_col, tie_break) if name in df.columns]


class _Places:
    """Where a card was, row by row."""

    def __init__(self, lat_col: str, lon_col: str, settings: RuleSettings):
        self.settings = settings
        self.lat, self.lon = F.col(lat_col), F.col(lon_col)
        self.place = F.struct(self.lat.alias("lat"), self.lon.alias("lon"))
        self.skip = None
        if settings.geo_ignore_unknown_places:
            self.skip = known_degrees(lat_col).isNull() | known_degrees(lon_col).isNull()

    def columns(self) -> list[Column]:
        at, was = F.col("_prev.at"), F.col("_prev.was")
        elapsed = F.col(WHEN) - at
        hours = elapsed / SECONDS_PER_HOUR
        distance = haversine_km(was["lat"], was["lon"], self.lat, self.lon)
        placed = F.nanvl(was["lat"].cast("double"), F.lit(None)).isNotNull()
        if self.settings.geo_lookback_seconds is not None:
            # Where no time can be told, nothing is known to be too long ago.
            recent = F.coalesce(elapsed <= self.settings.geo_lookback_seconds, F.lit(True))
            placed, hours = placed & recent, F.when(recent, hours)
        speed = F.when(hours > 0, distance / hours)
        return [
            speed.alias("_implied_speed_kmh"),
            (placed & (speed > self.settings.max_speed_kmh)).alias("flag_geo_jump"),
        ]
