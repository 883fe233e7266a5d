"""The given tables read as the tables of this domain, once in Spark and once in SQL.

Raw tables have the rough values of real files (``$1,234.50``, ``501.0``); the SQL states directly
what they mean after cleaning. Amounts are multiples of 0.25, so that sums are exact in any order.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardwatch.operators.scd import scd2_merge, scd2_scd3_merge
from cardwatch.plans import silver

LOADED_AT = datetime(2024, 2, 1)
MERGED_AT = datetime(2024, 3, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dollars(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


# --- transactions ------------------------------------------------------------------------------


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As many merchants as there are suppliers, so that their dimension grows with the data.
    merchant = F.col("event_id") % table(spark, sf_dir, "supplier").count()
    kinds = {"purchase": "Chip Transaction", "view": "Swipe Transaction", "click": "Online Transaction"}
    use_chip = F.col("event_type")
    for kind, label in kinds.items():
        use_chip = F.when(F.col("event_type") == kind, label).otherwise(use_chip)
    amount = dollars(F.round(F.col("value") * 100) * 0.25)
    place = (501 + (merchant * 7) % 25 * 97).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("date"),
        F.col("user_id").alias("client_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 2).alias("card_id"),
        F.when(F.col("event_id") % 101 == 0, "n/a").otherwise(amount).alias("amount"),
        use_chip.alias("use_chip"),
        merchant.alias("merchant_id"),
        F.concat(F.lit("City_"), (F.col("event_id") % 3).cast("string")).alias("merchant_city"),
        F.concat(F.lit("S"), (merchant % 5).cast("string")).alias("merchant_state"),
        F.when(F.col("event_type") != "click", F.concat(place, F.lit(".0"))).alias("zip"),
        (5000 + merchant % 28).cast("string").alias("mcc"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.transactions(raw_transactions(spark, sf_dir))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids by nation; those of one region are missing."""
    key = F.col("n_nationkey")
    return (
        table(spark, sf_dir, "nation")
        .filter(F.col("n_regionkey") != 3)
        .select(
            F.lpad((501 + key * 97).cast("string"), 5, "0").alias("zip"),
            (-60 + 5 * key).cast("double").alias("latitude"),
            (-120 + 9 * key).cast("double").alias("longitude"),
        )
    )


def placed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.with_places(transactions(spark, sf_dir), geo(spark, sf_dir))


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a fact with dates only: many rows of a customer share a second."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_orderdate").alias("date"),
        (F.round(F.col("o_totalprice") * 100) * 0.25).alias("amount"),
    )


def busy_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of 30 days; a third of them are of one card and customer."""
    order, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    owner = F.when(order % 3 == 0, -1).otherwise(order).cast("long")
    number = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))
    second = (order * 7919 + line * 104729 + part * 31) % (30 * 86400)
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("_copy", number)
        .select(
            ((order * 8 + line) * 1000 + F.col("_copy")).alias("id"),
            owner.alias("card_id"),
            owner.alias("client_id"),
            F.timestamp_seconds(1_704_067_200 + second).alias("date"),
            (F.round("l_extendedprice") * 0.25).alias("amount"),
            (F.col("l_suppkey") % 50).cast("double").alias("merchant_latitude"),
            (part % 90).cast("double").alias("merchant_longitude"),
        )
    )


def busy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, of which a third are of one customer; times are dates only."""
    rows = order_transactions(spark, sf_dir)
    return rows.withColumn("client_id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("client_id")))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        (5000 + F.col("n_nationkey")).cast("string").alias("mcc"), F.col("n_name").alias("mcc_description")
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.merchants(raw_transactions(spark, sf_dir), categories(spark, sf_dir))


# --- customers and cards -----------------------------------------------------------------------


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, income = F.col("c_custkey"), F.round("c_acctbal") * 20
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        (20 + key % 60).cast("int").alias("current_age"),
        F.lit(65).alias("retirement_age"),
        (2004 - key % 60).cast("int").alias("birth_year"),
        (1 + key % 12).cast("int").alias("birth_month"),
        F.when(key % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.concat("c_name", F.lit(" Street")).alias("address"),
        (-60 + 5 * nation).cast("double").alias("latitude"),
        (-120 + 9 * nation).cast("double").alias("longitude"),
        dollars(income / 2).alias("per_capita_income"),
        F.when(key % 13 == 0, "unknown").otherwise(dollars(income)).alias("yearly_income"),
        dollars(income * 2).alias("total_debt"),
        (500 + key % 350).cast("int").alias("credit_score"),
        (1 + key % 5).cast("int").alias("num_credit_cards"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.customers(raw_customers(spark, sf_dir))


CUSTOMER_ATTRIBUTES = ["id", "address", "yearly_income", "income_tier", "birth_year", "longitude"]


def customer_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer dimension as loaded, plus one closed version for a third of the customers."""
    source = customers(spark, sf_dir).select(*CUSTOMER_ATTRIBUTES)
    loaded = scd2_scd3_merge(None, source, ["id"], ["income_tier"], "address", LOADED_AT)
    before = loaded.filter(F.col("id") % 3 == 0).withColumns(
        {
            "income_tier": F.lit("earlier"),
            "effective_start": F.lit(datetime(2023, 1, 1)).cast("timestamp"),
            "effective_end": F.lit(LOADED_AT).cast("timestamp"),
            "is_current": F.lit(False),
        }
    )
    return loaded.unionByName(before)


def customer_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next delivery: richer, moved, missing and new customers."""
    key = F.col("id")
    source = customers(spark, sf_dir).select(*CUSTOMER_ATTRIBUTES)
    changed = source.withColumns(
        {
            "income_tier": F.when(key % 7 == 0, F.lit("very_high")).otherwise(F.col("income_tier")),
            "address": F.when(key % 5 == 0, F.lit("12 New Road")).otherwise(F.col("address")),
            "birth_year": F.col("birth_year") + 1,
        }
    ).filter((F.col("yearly_income") > -10000) | F.col("yearly_income").isNull())
    added = source.filter(key % 10 == 0).withColumn("id", key + 1_000_000_000)
    return changed.unionByName(added)


def raw_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    held = table(spark, sf_dir, "events").select(
        (F.col("user_id") * 10 + F.col("event_id") % 2).alias("id"), F.col("user_id").alias("client_id")
    )
    return held.distinct().select(
        "id",
        "client_id",
        F.when(key % 3 == 0, "Visa").otherwise("Mastercard").alias("card_brand"),
        F.when(key % 4 == 0, "Credit").otherwise("Debit").alias("card_type"),
        (4000000000000000 + key).alias("card_number"),
        F.lit("12/2027").alias("expires"),
        F.when(key % 5 == 0, "NO").otherwise("YES").alias("has_chip"),
        dollars(1000 + key % 50 * 100).alias("credit_limit"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.cards(raw_cards(spark, sf_dir))


def card_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2_merge(None, cards(spark, sf_dir), ["id"], ["card_type", "has_chip", "credit_limit"], LOADED_AT)


def card_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Higher limits, unknown chips, and a new expiry date that is not tracked."""
    key = F.col("id")
    return cards(spark, sf_dir).withColumns(
        {
            "credit_limit": F.when(key % 20 == 0, F.col("credit_limit") + 500).otherwise(F.col("credit_limit")),
            "has_chip": F.when(key % 30 != 0, F.col("has_chip")),
            "expires": F.lit("12/2030"),
        }
    )


# --- the same in SQL ---------------------------------------------------------------------------

RAW_TXN = """
    SELECT event_id AS id, ts AS date, user_id AS client_id, user_id * 10 + event_id % 2 AS card_id,
      CASE WHEN event_id % 101 <> 0 THEN round(value * 100) * 0.25 END AS amount,
      CASE event_type WHEN 'purchase' THEN 'chip' WHEN 'view' THEN 'swipe' WHEN 'click' THEN 'online'
        ELSE event_type END AS channel,
      event_id % (SELECT count(*) FROM supplier) AS merchant_id,
      CASE WHEN event_type <> 'click'
        THEN lpad(CAST(501 + (event_id % (SELECT count(*) FROM supplier) * 7) % 25 * 97 AS VARCHAR), 5, '0') END AS zip,
      CAST(5000 + event_id % (SELECT count(*) FROM supplier) % 28 AS VARCHAR) AS mcc,
      'City_' || (event_id % 3) AS merchant_city,
      'S' || (event_id % (SELECT count(*) FROM supplier) % 5) AS merchant_state,
      CAST(floor(epoch(ts)) AS BIGINT) AS sec
    FROM events"""

GEO = """
    SELECT lpad(CAST(501 + n_nationkey * 97 AS VARCHAR), 5, '0') AS zip,
      CAST(-60 + 5 * n_nationkey AS DOUBLE) AS latitude, CAST(-120 + 9 * n_nationkey AS DOUBLE) AS longitude
    FROM nation WHERE n_regionkey <> 3"""

PLACED = """
    SELECT t.*, g.latitude AS merchant_latitude, g.longitude AS merchant_longitude
    FROM txn t LEFT JOIN geo g ON t.zip = g.zip"""

MERCHANTS = """
    SELECT m.merchant_id AS id, m.merchant_city, m.merchant_state, m.zip AS merchant_zip, m.mcc,
      n.n_name AS mcc_description
    FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY date DESC, id DESC) AS age
          FROM txn) m
    LEFT JOIN nation n ON m.mcc = CAST(5000 + n.n_nationkey AS VARCHAR)
    WHERE m.age = 1"""

CUSTOMERS = """
    SELECT *, CASE WHEN yearly_income IS NULL THEN 'unknown' WHEN yearly_income < 30000 THEN 'low'
        WHEN yearly_income < 80000 THEN 'medium' WHEN yearly_income < 150000 THEN 'high'
        ELSE 'very_high' END AS income_tier
    FROM (SELECT c_custkey AS id, c_name || ' Street' AS address,
            CASE WHEN c_custkey % 13 <> 0 THEN round(c_acctbal) * 20 END AS yearly_income,
            CAST(2004 - c_custkey % 60 AS INTEGER) AS birth_year,
            CAST(-120 + 9 * c_nationkey AS DOUBLE) AS longitude,
            CAST(-60 + 5 * c_nationkey AS DOUBLE) AS latitude
          FROM customer)"""

CARDS = """
    SELECT DISTINCT user_id * 10 + event_id % 2 AS id, user_id AS client_id,
      CASE WHEN (user_id * 10 + event_id % 2) % 3 = 0 THEN 'Visa' ELSE 'Mastercard' END AS card_brand,
      CASE WHEN (user_id * 10 + event_id % 2) % 4 = 0 THEN 'Credit' ELSE 'Debit' END AS card_type,
      4000000000000000 + user_id * 10 + event_id % 2 AS card_number,
      CASE WHEN (user_id * 10 + event_id % 2) % 5 = 0 THEN 'NO' ELSE 'YES' END AS has_chip,
      CAST(1000 + (user_id * 10 + event_id % 2) % 50 * 100 AS DOUBLE) AS credit_limit
    FROM events"""

REFERENCE = "SELECT client_id, avg(amount) AS avg_amount_30d FROM txn GROUP BY client_id"

BUSY = """
    SELECT (l_orderkey * 8 + l_linenumber) * 1000 + copy AS id, owner AS card_id, owner AS client_id, sec, sec AS date,
      round(l_extendedprice) * 0.25 AS amount, CAST(l_suppkey % 50 AS DOUBLE) AS merchant_latitude,
      CAST(l_partkey % 90 AS DOUBLE) AS merchant_longitude
    FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN -1 ELSE l_orderkey END AS owner,
            1704067200 + (l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % (30 * 86400) AS sec,
            row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS copy
          FROM lineitem)"""

_KM = """2 * 6371.0 * asin(sqrt(
        pow(sin((radians({lat2}) - radians({lat1})) / 2), 2)
        + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))"""


def km_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return _KM.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2)


def flags_sql(rows: str, deviation: str = "window", velocity_seconds: int = 300) -> str:
    """All four flags over a relation. ``deviation`` is the trailing window or the reference mean."""
    trailing = (
        "avg(amount) OVER (PARTITION BY client_id ORDER BY sec"
        " RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING)"
        if deviation == "window"
        else "avg_amount_30d"
    )
    km = km_sql("prev_lat", "prev_lon", "merchant_latitude", "merchant_longitude")
    return f"""
    SELECT *, amount > 2000 AS flag_amount_threshold, txn_count_in_window >= 3 AS flag_velocity,
      coalesce(prev_lat IS NOT NULL, false) AND (implied_speed_kmh > 900) AS flag_geo_jump,
      mean IS NOT NULL AND amount > 3 * mean AS flag_spending_deviation
    FROM (
      SELECT *, CASE WHEN sec > prev_sec THEN {km} / ((sec - prev_sec) / 3600.0) END AS implied_speed_kmh
      FROM (
        SELECT *, {trailing} AS mean,
          count(*) OVER (PARTITION BY card_id ORDER BY sec
            RANGE BETWEEN {velocity_seconds} PRECEDING AND CURRENT ROW) AS txn_count_in_window,
          lag(merchant_latitude) OVER (PARTITION BY card_id ORDER BY date, id) AS prev_lat,
          lag(merchant_longitude) OVER (PARTITION BY card_id ORDER BY date, id) AS prev_lon,
          lag(sec) OVER (PARTITION BY card_id ORDER BY date, id) AS prev_sec
        FROM {rows}))"""


def verdict_sql(rows: str) -> str:
    names = ("amount_threshold", "velocity", "geo_jump", "spending_deviation")
    points = " + ".join(f"CASE WHEN flag_{n} THEN 25 ELSE 0 END" for n in names)
    reasons = ", ".join(f"CASE WHEN flag_{n} THEN '{n}' END" for n in names)
    return f"""
    SELECT *, {points} AS risk_score, ({points}) > 0 AS fraud_flag,
      nullif(concat_ws(', ', {reasons}), '') AS risk_reason
    FROM {rows}"""


CTES = {
    "txn": RAW_TXN,
    "geo": GEO,
    "placed": PLACED,
    "merchants": MERCHANTS,
    "customers": CUSTOMERS,
    "cards": CARDS,
    "reference": REFERENCE,
    "busy": BUSY,
    "flagged": flags_sql("placed"),
    "scored": verdict_sql("flagged"),
}
NEEDS = {
    "placed": ("txn", "geo"),
    "merchants": ("txn",),
    "reference": ("txn",),
    "flagged": ("placed",),
    "scored": ("flagged",),
}


def with_tables(body: str, *names: str, **extra: str) -> str:
    """``body`` under the named relations and those they need, then the extra ones in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{name} AS ({CTES[name]})" for name in ordered] + [f"{n} AS ({q})" for n, q in extra.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
