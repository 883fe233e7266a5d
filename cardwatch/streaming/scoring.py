"""The four rules on a stream of landing rows."""

from __future__ import annotations

from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.functions.geo import known_degrees
from cardwatch.functions.scoring import with_risk_columns
from cardwatch.operators.rules import apply_amount_rule
from cardwatch.plans.silver import fraud_risk_streaming
from cardwatch.settings import DEFAULTS, RuleSettings
from cardwatch.streaming.card_history import MICROS, CardHistory

LANDING_SCHEMA = (
    "id string, date timestamp, client_id string, card_id string, "
    "amount double, channel string, merchant_id string"
)
CARD = "card_key"
# What the state operator is handed: what its rules and the risk row need.
STATE_COLUMNS = [
    "id",
    "date",
    "client_id",
    "card_id",
    "merchant_latitude",
    "merchant_longitude",
    "flag_amount_threshold",
    "flag_spending_deviation",
]


def read_landing(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType = LANDING_SCHEMA,
    max_files_per_trigger: int | None = 256,
) -> DataFrame:
    """The landing folder as a stream. The limit bounds a micro-batch, and with it what one card can
    bring into one task. Flags do not depend on where it cuts if files land in the order of time."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def enrich_stream(
    stream: DataFrame, merchants: DataFrame, geo: DataFrame, spending: DataFrame
) -> DataFrame:
    """Left joins to static tables. Each is joined by itself, so Spark compares its real size with the
    broadcast threshold and not an estimate for the product of two."""
    zips = merchants.select(F.col("id").alias("merchant_id"), "merchant_zip")
    centroids = geo.select(
        F.col("zip").alias("merchant_zip"),
        known_degrees("latitude").alias("merchant_latitude"),
        known_degrees("longitude").alias("merchant_longitude"),
    )
    placed = stream.join(zips, "merchant_id", "left").join(centroids, "merchant_zip", "left").drop("merchant_zip")
    return placed.join(spending, "client_id", "left")


def delivered_once(stream: DataFrame, within: str, id_col: str = "id", ts_col: str = "date") -> DataFrame:
    """Each id once, although it may land again up to ``within`` (as ``"2 days"``) of event time later.

    Ids are kept in state until the watermark, the latest time seen less ``within``, has passed them by
    as much again. Rows that are behind the watermark on arrival are dropped as too late to tell, so choose
    ``within`` for the longest delay expected. Rows without a time cannot age: they pass unchecked.
    """
    moment = F.col(ts_col).cast("timestamp")
    timed = stream.filter(F.col(ts_col).isNotNull()).withColumn("_event_time", moment)
    once = timed.withWatermark("_event_time", within).dropDuplicatesWithinWatermark([id_col])
    return once.select(*stream.columns).unionByName(stream.filter(F.col(ts_col).isNull()))


def with_simple_flags(enriched: DataFrame, settings: RuleSettings = DEFAULTS) -> DataFrame:
    """The two rules that need no state: the amount, and the amount against the reference mean."""
    mean = F.col("avg_amount_30d")
    above = F.col("amount") > mean * settings.deviation_multiplier
    return apply_amount_rule(enriched, settings=settings).withColumn(
        "flag_spending_deviation", mean.isNotNull() & above
    )


def score_card_state(
    flagged: DataFrame, settings: RuleSettings = DEFAULTS, idle_seconds: int | None = None
) -> DataFrame:
    """Velocity and geo-jump from state kept per card; the other columns pass through.

    The flags equal those of the batch rules if rows arrive in order and a card's rows of one second
    share a micro-batch. A late row is judged by the history still kept. ``idle_seconds`` lets the
    state of cards expire that were idle so long on the clock; by default each card keeps its last
    place and at most one entry per second of the velocity window.
    """
    ttl_ms = None if idle_seconds is None else idle_seconds * 1000
    schema = flagged.schema
    carried = [name for name in schema.names if name != "date"]
    # The time goes through Python as a number, so that no time zone is applied on the way.
    rows = flagged.select(
        *carried,
        F.unix_micros(F.col("date").cast("timestamp")).alias(MICROS),
        F.coalesce(F.concat(F.lit("k"), F.col("card_id").cast("string")), F.lit("null")).alias(CARD),
    )
    output = T.StructType(
        [T.StructField(name, schema[name].dataType) for name in carried]
        + [T.StructField(MICROS, T.LongType())]
        + [T.StructField(name, T.BooleanType()) for name in ("flag_velocity", "flag_geo_jump")]
    )
    scored = rows.groupBy(CARD).transformWithState(
        statefulProcessor=CardHistory(settings, [*carried, MICROS], ttl_ms),
        outputStructType=output,
        outputMode="append",
        timeMode="none" if ttl_ms is None else "processingTime",
    )
    moment = F.timestamp_micros(MICROS).cast(schema["date"].dataType).alias("date")
    return scored.select(
        *[moment if name == "date" else F.col(name) for name in schema.names], "flag_velocity", "flag_geo_jump"
    )


def score_stream(
    stream: DataFrame,
    merchants: DataFrame,
    geo: DataFrame,
    spending: DataFrame,
    settings: RuleSettings = DEFAULTS,
    scored_at: datetime | Column | None = None,
    idle_seconds: int | None = None,
    once_within: str | None = None,
) -> DataFrame:
    """Landing rows to risk rows. With ``once_within``, rows landing again so long after count once, before
    any rule sees them (:func:`delivered_once`)."""
    if once_within is not None:
        stream = delivered_once(stream, once_within)
    flagged = with_simple_flags(enrich_stream(stream, merchants, geo, spending), settings).select(
        STATE_COLUMNS
    )
    scored = with_risk_columns(score_card_state(flagged, settings, idle_seconds), settings=settings)
    return fraud_risk_streaming(scored, scored_at)


def run_available(
    df: DataFrame,
    target: str,
    checkpoint: str,
    timeout_seconds: float | None = None,
    state_partitions: int | None = None,
) -> None:
    """Append what is there to a parquet table and return; exactly once per checkpoint.

    ``state_partitions`` sets the number of state stores. It is fixed by the first run of a
    checkpoint, so choose it for the number of cards to come. With ``timeout_seconds``, raises
    ``TimeoutError``, after stopping the query, if the run takes longer.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        # With a clock-based expiry every empty batch would ask for one more and the run never end.
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    if state_partitions:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    with _settings(df.sparkSession, wanted):
        query = (
            df.writeStream.format("parquet")
            .outputMode("append")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    if timeout_seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError(f"stream into {target} did not finish within {timeout_seconds} s")


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the start of a query, which keeps its own copy of them."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def unscored_flags(risk: DataFrame) -> DataFrame:
    """Flagged rows without a score: there should be none."""
    return risk.filter(F.col("fraud_flag") & F.col("risk_score").isNull())
