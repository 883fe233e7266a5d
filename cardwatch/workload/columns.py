"""Cleaning expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardwatch.functions import (
    CHANNEL_NAMES,
    clean_zip,
    decade,
    haversine_km,
    income_tier,
    mask_pan,
    parse_currency,
    recode,
)
from cardwatch.workload.bindings import dollars, km_sql, raw_customers, raw_transactions, table, with_tables
from cardwatch.workload.registry import query


@query("""
    SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN amount WHEN 1 THEN -amount WHEN 2 THEN amount END
      AS amount
    FROM (SELECT event_id, round(value * 100) * 0.25 AS amount FROM events)""")
def parse_currency_query(spark, sf_dir):
    amount = F.round(F.col("value") * 100) * 0.25
    text = (
        F.when(F.col("event_id") % 5 == 0, dollars(amount))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit("$-"), amount.cast("string")))
        .when(F.col("event_id") % 5 == 2, amount.cast("string"))
        .when(F.col("event_id") % 5 == 3, F.concat(F.lit("$"), F.col("event_type")))
        .otherwise("")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), parse_currency(text).alias("amount")
    )


@query("""
    SELECT event_id AS id, CASE event_id % 5
        WHEN 0 THEN lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0')
        WHEN 1 THEN lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0')
        WHEN 2 THEN left(CAST(1000000 + event_id AS VARCHAR), 5) END AS zip
    FROM events""")
def clean_zip_query(spark, sf_dir):
    short = (F.col("event_id") % 100000).cast("string")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.concat(short, F.lit(".0")))
        .when(F.col("event_id") % 5 == 1, short)
        .when(F.col("event_id") % 5 == 2, (1000000 + F.col("event_id")).cast("string"))
        .when(F.col("event_id") % 5 == 3, F.concat(short, F.lit("-6789")))
        .otherwise("NaN")
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), clean_zip(text).alias("zip"))


@query(with_tables("SELECT id, yearly_income, income_tier FROM customers", "customers"))
def income_tier_query(spark, sf_dir):
    income = parse_currency("yearly_income")
    return raw_customers(spark, sf_dir).select(
        "id", income.alias("yearly_income"), income_tier(income).alias("income_tier")
    )


@query(with_tables("SELECT id, channel FROM txn", "txn"))
def channel_recode(spark, sf_dir):
    raw = raw_transactions(spark, sf_dir)
    return raw.select("id", recode("use_chip", CHANNEL_NAMES).alias("channel"))


@query("SELECT c_custkey AS id, '****-****-****-' || right(CAST(4000000000000000 + c_custkey AS VARCHAR), 4) AS masked FROM customer")
def mask_pan_query(spark, sf_dir):
    number = 4000000000000000 + F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), mask_pan(number).alias("masked")
    )


@query(with_tables("SELECT id, CAST(birth_year // 10 * 10 AS INTEGER) AS birth_decade FROM customers", "customers"))
def decade_mask(spark, sf_dir):
    return raw_customers(spark, sf_dir).select("id", decade("birth_year").alias("birth_decade"))


@query(
    "SELECT c_custkey AS id, round("
    + km_sql("-60 + 5 * c_nationkey", "-120 + 9 * c_nationkey", "40.7128", "-74.0060")
    + ", 4) AS km FROM customer"
)
def haversine(spark, sf_dir):
    km = haversine_km("latitude", "longitude", F.lit(40.7128), F.lit(-74.0060))
    return raw_customers(spark, sf_dir).select("id", F.round(km, 4).alias("km"))
