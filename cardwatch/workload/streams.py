"""Streaming queries over all transactions. They end by themselves and return what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.plans import silver
from cardwatch.session import fresh_folder
from cardwatch.streaming import (
    enrich_stream,
    read_landing,
    run_available,
    score_stream,
    unscored_flags,
    with_simple_flags,
)
from cardwatch.workload.bindings import (
    LOADED_AT,
    flags_sql,
    geo,
    merchants,
    raw_transactions,
    transactions,
    verdict_sql,
    with_tables,
)
from cardwatch.workload.registry import query

BY_LOOKUP = {
    # On the stream the place is the merchant's, so that online rows have one as well.
    "landed": """SELECT t.*, g.latitude AS merchant_latitude, g.longitude AS merchant_longitude, r.avg_amount_30d
                 FROM txn t LEFT JOIN merchants m ON m.id = t.merchant_id LEFT JOIN geo g ON g.zip = m.merchant_zip
                   LEFT JOIN reference r ON r.client_id = t.client_id""",
    "looked_up": flags_sql("landed", deviation="reference"),
}
TABLES = ("txn", "geo", "merchants", "reference")
PERIODS = (
    "date < '2024-01-11' or date is null",
    "date >= '2024-01-11' and date < '2024-01-21'",
    "date >= '2024-01-21'",
)


def landing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).select(
        "id", "date", "client_id", "card_id", "amount", "channel", "merchant_id"
    )


def statics(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The static sides, written once: each micro-batch reads them again."""
    root = fresh_folder(spark, "statics")
    reference = silver.spending_reference(transactions(spark, sf_dir)).drop("as_of_date")
    written = {
        "merchants": merchants(spark, sf_dir).select("id", "merchant_zip"),
        "geo": geo(spark, sf_dir),
        "spending": reference,
    }
    for name, df in written.items():
        df.write.parquet(f"{root}/{name}")
    return tuple(spark.read.parquet(f"{root}/{name}") for name in written)


@query(
    with_tables(
        """SELECT id, amount, merchant_latitude, merchant_longitude, flag_amount_threshold, flag_spending_deviation
           FROM looked_up""",
        *TABLES,
        **BY_LOOKUP,
    )
)
def stream_simple_flags(spark, sf_dir):
    root = fresh_folder(spark, "stream")
    rows = landing_rows(spark, sf_dir)
    rows.write.parquet(f"{root}/landing")
    stream = read_landing(spark, f"{root}/landing", rows.schema)
    flagged = with_simple_flags(enrich_stream(stream, *statics(spark, sf_dir))).select(
        *("id", "amount", "merchant_latitude", "merchant_longitude"),
        *("flag_amount_threshold", "flag_spending_deviation"),
    )
    run_available(flagged, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out")


def scored_in_three_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three periods land one after the other; each run resumes from the checkpoint of the last."""
    root = fresh_folder(spark, "stream")
    rows = landing_rows(spark, sf_dir)
    static_sides = statics(spark, sf_dir)
    for period in PERIODS:
        # Files cover disjoint times, so flags do not depend on how they are cut into micro-batches.
        rows.filter(period).repartitionByRange("date").sortWithinPartitions("date").write.mode("append").parquet(
            f"{root}/landing"
        )
        stream = read_landing(spark, f"{root}/landing", rows.schema)
        run_available(
            score_stream(stream, *static_sides, scored_at=LOADED_AT),
            f"{root}/out",
            f"{root}/checkpoint",
            state_partitions=spark.sparkContext.defaultParallelism,
        )
    return spark.read.parquet(f"{root}/out")


@query(
    with_tables(
        f"""SELECT id, id AS transaction_id, client_id, card_id, fraud_flag, risk_score, risk_reason
            FROM ({verdict_sql("looked_up")})""",
        *TABLES,
        **BY_LOOKUP,
    )
)
def stream_scored(spark, sf_dir):
    return scored_in_three_runs(spark, sf_dir).drop("scored_at")


@query(
    with_tables(
        f"""SELECT count(*) FILTER (fraud_flag) AS flagged, count(*) FILTER (fraud_flag AND risk_score IS NULL) AS unscored
            FROM ({verdict_sql("looked_up")})""",
        *TABLES,
        **BY_LOOKUP,
    )
)
def stream_check(spark, sf_dir):
    """The check after a run: flagged rows without a score."""
    risk = scored_in_three_runs(spark, sf_dir)
    unscored = unscored_flags(risk).select("id", F.lit(1).alias("unscored"))
    return (
        risk.filter("fraud_flag")
        .join(unscored, "id", "left")
        .agg(F.count(F.lit(1)).alias("flagged"), F.count("unscored").alias("unscored"))
    )


@query(
    with_tables(
        f"""SELECT id, id AS transaction_id, client_id, card_id, fraud_flag, risk_score, risk_reason
            FROM ({verdict_sql("looked_up")})""",
        *TABLES,
        **BY_LOOKUP,
    )
)
def stream_delivered_twice(spark, sf_dir):
    """A third of the rows land twice: at once, or again with the next run. Each counts once."""
    root = fresh_folder(spark, "stream")
    rows, static_sides = landing_rows(spark, sf_dir), statics(spark, sf_dir)
    again = F.col("id") % 3 == 0
    first, later = "date < '2024-01-16' or date is null", "date >= '2024-01-16'"
    deliveries = [
        rows.filter(first).unionByName(rows.filter(first).filter(again & (F.col("id") % 2 == 0) & F.col("date").isNotNull())),
        rows.filter(later).unionByName(rows.filter(again & F.col("date").isNotNull())),
    ]
    for delivered in deliveries:
        # One file each: the first row of an id in it counts, whichever copy that is.
        delivered.repartitionByRange("date").sortWithinPartitions("date").write.mode("append").parquet(f"{root}/landing")
        stream = read_landing(spark, f"{root}/landing", rows.schema, max_files_per_trigger=None)
        run_available(
            score_stream(stream, *static_sides, scored_at=LOADED_AT, once_within="40 days"),
            f"{root}/out",
            f"{root}/checkpoint",
            state_partitions=spark.sparkContext.defaultParallelism,
        )
    return spark.read.parquet(f"{root}/out").drop("scored_at")


@query(
    with_tables(
        "SELECT id, CAST(epoch_us(date) AS BIGINT) AS date_us, amount FROM txn",
        "txn",
    )
)
def stream_append(spark, sf_dir):
    """Landing rows through the exactly-once sink, in two runs over one checkpoint."""
    root = fresh_folder(spark, "stream")
    rows = raw_transactions(spark, sf_dir)
    for part in ("date < '2024-01-15'", "date >= '2024-01-15'"):
        rows.filter(part).write.mode("append").parquet(f"{root}/landing")
        cleaned = silver.transactions(read_landing(spark, f"{root}/landing", rows.schema))
        run_available(cleaned, f"{root}/out", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/out").select("id", F.unix_micros("date").alias("date_us"), "amount")
