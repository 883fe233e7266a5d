"""The rollups, over a batch leg and a streaming leg that together are the whole fact.

Online transactions arrive on the streaming leg, all others on the batch leg.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.functions import with_risk_columns
from cardwatch.operators.rules import apply_card_rules, score_all_rules
from cardwatch.plans import gold, silver
from cardwatch.session import fresh_folder
from cardwatch.streaming import with_simple_flags
from cardwatch.workload.bindings import (
    LOADED_AT,
    customer_snapshot,
    flags_sql,
    merchants,
    placed_transactions,
    verdict_sql,
    with_tables,
)
from cardwatch.workload.registry import query


def legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """From a written table, as the refresh does it: the rules read their rows more than once."""
    path = fresh_folder(spark, "placed")
    placed_transactions(spark, sf_dir).write.parquet(path)
    rows = spark.read.parquet(path)
    online = F.coalesce(F.col("channel") == "online", F.lit(False))
    return rows.filter(~online), rows.filter(online)


def scored_legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scored rows of both legs, with all that is known of their transactions."""
    batch, landing = legs(spark, sf_dir)
    reference = silver.spending_reference(batch).drop("as_of_date")
    flagged = apply_card_rules(with_simple_flags(landing.join(reference, "client_id", "left")))
    return score_all_rules(batch), with_risk_columns(flagged)


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, streaming = scored_legs(spark, sf_dir)
    return gold.unified_scored(silver.with_details(batch, LOADED_AT), silver.with_details(streaming, LOADED_AT))


def unified_from_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From risk tables without details; a tenth of the landing rows was delivered, and scored, twice."""
    batch, landing = legs(spark, sf_dir)
    scored, streaming = scored_legs(spark, sf_dir)
    again = F.col("id") % 10 == 0
    risk = silver.fraud_risk_streaming(streaming, LOADED_AT)
    return gold.unified_risk(
        silver.fraud_risk(scored, LOADED_AT),
        batch,
        risk.unionByName(risk.filter(again)),
        landing.unionByName(landing.filter(again)),
    )


UNIFIED = {
    "batch_flags": flags_sql("(SELECT * FROM placed WHERE channel IS DISTINCT FROM 'online')"),
    "leg_reference": "SELECT client_id, avg(amount) AS avg_amount_30d FROM txn WHERE channel IS DISTINCT FROM 'online' GROUP BY client_id",
    "stream_flags": flags_sql(
        "(SELECT p.*, r.avg_amount_30d FROM placed p LEFT JOIN leg_reference r USING (client_id) WHERE channel = 'online')",
        deviation="reference",
    ),
    "fraud": f"""
        SELECT id, client_id, card_id, date, amount, merchant_id, fraud_flag, risk_score, risk_reason,
          'batch' AS source FROM ({verdict_sql("batch_flags")})
        UNION ALL
        SELECT id, client_id, card_id, date, coalesce(amount, 0.0), merchant_id, fraud_flag, risk_score,
          risk_reason, 'streaming' FROM ({verdict_sql("stream_flags")})""",
}


def over_fraud(body: str, *names: str, **extra: str) -> str:
    return with_tables(body, "placed", *names, **UNIFIED, **extra)


DAILY = """
    SELECT CAST(date AS DATE) AS txn_date, source, count(*) AS total_transactions,
      count(*) FILTER (fraud_flag) AS flagged_transactions, avg(risk_score) AS avg_risk_score,
      sum(amount) AS total_amount, sum(CASE WHEN fraud_flag THEN amount ELSE 0 END) AS flagged_amount,
      count(*) FILTER (fraud_flag) / count(*) AS fraud_rate
    FROM fraud GROUP BY ALL"""
DAILY_COLUMNS = """strftime(txn_date, '%Y-%m-%d') AS txn_date, source, total_transactions, flagged_transactions,
    avg_risk_score, total_amount, flagged_amount, fraud_rate"""


def with_day_text(daily: DataFrame) -> DataFrame:
    return daily.withColumn("txn_date", F.date_format("txn_date", "yyyy-MM-dd"))


@query(
    over_fraud(
        """SELECT id, id AS transaction_id, client_id, card_id, CAST(epoch_us(date) AS BIGINT) AS date_us, amount,
             merchant_id, fraud_flag, risk_score, risk_reason, 'open' AS investigation_status, source FROM fraud"""
    )
)
def unified_risk(spark, sf_dir):
    return (
        unified_from_stored(spark, sf_dir)
        .withColumn("date_us", F.unix_micros("date"))
        .drop("date", "scored_at")
    )


@query(over_fraud(f"SELECT {DAILY_COLUMNS} FROM ({DAILY})"))
def daily_fraud_summary(spark, sf_dir):
    return with_day_text(gold.daily_fraud_summary(unified(spark, sf_dir)))


@query(over_fraud(f"SELECT {DAILY_COLUMNS} FROM ({DAILY}) ORDER BY txn_date DESC, source LIMIT 10"))
def latest_days(spark, sf_dir):
    return with_day_text(gold.latest_days(gold.daily_fraud_summary(unified(spark, sf_dir))))


@query(
    over_fraud(
        """SELECT client_id, count(*) AS total_transactions, sum(amount) AS total_spend,
             avg(amount) AS avg_transaction_amount, count(*) FILTER (fraud_flag) AS flagged_transaction_count,
             max(risk_score) AS max_risk_score, CAST(max(epoch_us(date)) AS BIGINT) AS last_transaction_us,
             string_agg(DISTINCT source, ',' ORDER BY source) AS source, income_tier, address
           FROM fraud JOIN customers c ON c.id = client_id GROUP BY client_id, income_tier, address""",
        "customers",
    )
)
def customer_risk_profile(spark, sf_dir):
    profile = gold.customer_risk_profile(unified(spark, sf_dir), customer_snapshot(spark, sf_dir))
    return profile.withColumns(
        {
            "source": F.array_join("source", ","),
            "last_transaction_us": F.unix_micros("last_transaction_date"),
        }
    ).drop("last_transaction_date")


@query(
    over_fraud(
        """SELECT mcc_description, source, count(*) AS transaction_count, sum(amount) AS total_amount,
             avg(amount) AS avg_amount
           FROM fraud JOIN merchants m ON m.id = merchant_id GROUP BY mcc_description, source""",
        "merchants",
    )
)
def merchant_category_spend(spark, sf_dir):
    return gold.merchant_category_spend(unified(spark, sf_dir), merchants(spark, sf_dir))


@query(
    over_fraud(
        """SELECT id AS transaction_id, client_id, card_id, CAST(epoch_us(date) AS BIGINT) AS date_us, amount,
             risk_score, risk_reason, 'open' AS investigation_status, source FROM fraud WHERE fraud_flag"""
    )
)
def investigation_queue(spark, sf_dir):
    queue = gold.investigation_queue(unified(spark, sf_dir))
    return queue.withColumn("date_us", F.unix_micros("date")).drop("date")
