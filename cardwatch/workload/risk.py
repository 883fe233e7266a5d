"""The rules and what is said about the transaction fact."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cardwatch.operators import (
    apply_amount_rule,
    apply_geo_jump_rule,
    apply_spending_deviation_rule,
    apply_velocity_rule,
    check_row_count,
    missing_geo_breakdown,
    null_counts,
    orphan_keys,
    score_all_rules,
)
from cardwatch.operators.scd import scd2_merge
from cardwatch.plans import silver
from cardwatch.settings import DEFAULTS
from cardwatch.workload.bindings import (
    LOADED_AT,
    busy_orders,
    busy_transactions,
    cards,
    customers,
    flags_sql,
    geo,
    km_sql,
    merchants,
    order_transactions,
    placed_transactions,
    raw_transactions,
    transactions,
    with_tables,
)
from cardwatch.workload.registry import query

HOURLY = replace(DEFAULTS, velocity_window_seconds=3600)


@query(with_tables("SELECT id, amount, flag_amount_threshold FROM flagged", "flagged"))
def rule_amount(spark, sf_dir):
    return apply_amount_rule(transactions(spark, sf_dir)).select("id", "amount", "flag_amount_threshold")


@query(with_tables("SELECT id, card_id, txn_count_in_window, flag_velocity FROM flagged", "flagged"))
def rule_velocity(spark, sf_dir):
    rows = transactions(spark, sf_dir).select("id", "card_id", "date")
    return apply_velocity_rule(rows).select("id", "card_id", "txn_count_in_window", "flag_velocity")


@query(
    with_tables(
        "SELECT id, card_id, txn_count_in_window, flag_velocity FROM hourly",
        "placed",
        hourly=flags_sql("placed", velocity_seconds=3600),
    )
)
def rule_velocity_1h(spark, sf_dir):
    rows = transactions(spark, sf_dir).select("id", "card_id", "date")
    return apply_velocity_rule(rows, settings=HOURLY).select(
        "id", "card_id", "txn_count_in_window", "flag_velocity"
    )


@query(
    with_tables(
        "SELECT id, card_id, round(implied_speed_kmh, 3) AS implied_speed_kmh, flag_geo_jump FROM flagged",
        "flagged",
    )
)
def rule_geo_jump(spark, sf_dir):
    rows = placed_transactions(spark, sf_dir).select(
        "id", "card_id", "date", "merchant_latitude", "merchant_longitude"
    )
    return apply_geo_jump_rule(rows).select(
        "id", "card_id", F.round("_implied_speed_kmh", 3).alias("implied_speed_kmh"), "flag_geo_jump"
    )


@query(
    with_tables(
        "SELECT id, client_id, mean AS trailing_30d_avg_amount, flag_spending_deviation FROM flagged", "flagged"
    )
)
def rule_spending_deviation(spark, sf_dir):
    rows = transactions(spark, sf_dir).select("id", "client_id", "date", "amount")
    return apply_spending_deviation_rule(rows).select(
        "id", "client_id", "trailing_30d_avg_amount", "flag_spending_deviation"
    )


def jumps_sql(rows: str, previous: str, lookback: int | None = None) -> str:
    """The geo rule by what ``previous`` takes for the place before."""
    recent = "true" if lookback is None else f"sec - prev_sec <= {lookback}"
    km = km_sql("prev_lat", "prev_lon", "merchant_latitude", "merchant_longitude")
    return f"""
        SELECT id, card_id, round(speed, 3) AS implied_speed_kmh,
          coalesce(prev_lat IS NOT NULL AND {recent}, false) AND speed > 900 AS flag_geo_jump
        FROM (SELECT *, CASE WHEN sec > prev_sec AND {recent} THEN {km} / ((sec - prev_sec) / 3600.0) END AS speed
              FROM (SELECT *, {previous.format("merchant_latitude")} AS prev_lat,
                      {previous.format("merchant_longitude")} AS prev_lon,
                      {previous.format("CASE WHEN merchant_latitude IS NOT NULL THEN sec END") if "IGNORE" in previous else previous.format("sec")} AS prev_sec
                    FROM {rows}))"""


BEFORE = "lag({}) OVER (PARTITION BY card_id ORDER BY date, id)"
LAST_KNOWN = "lag({} IGNORE NULLS) OVER (PARTITION BY card_id ORDER BY date, id)"


def judged_jumps(spark, sf_dir, settings):
    rows = placed_transactions(spark, sf_dir).select(
        "id", "card_id", "date", "merchant_latitude", "merchant_longitude"
    )
    return apply_geo_jump_rule(rows, settings=settings).select(
        "id", "card_id", F.round("_implied_speed_kmh", 3).alias("implied_speed_kmh"), "flag_geo_jump"
    )


@query(with_tables(jumps_sql("placed", LAST_KNOWN), "placed"))
def rule_geo_jump_last_known(spark, sf_dir):
    """Rows without a place do not hide the place before them."""
    return judged_jumps(spark, sf_dir, replace(DEFAULTS, geo_ignore_unknown_places=True))


@query(with_tables(jumps_sql("placed", BEFORE, 86_400), "placed"))
def rule_geo_jump_lookback(spark, sf_dir):
    """A place is remembered for a day."""
    return judged_jumps(spark, sf_dir, replace(DEFAULTS, geo_lookback_seconds=86_400))


@query("""
    SELECT id, client_id, mean AS trailing_30d_avg_amount,
      mean IS NOT NULL AND amount > 3 * mean AS flag_spending_deviation
    FROM (SELECT *, avg(amount) OVER (PARTITION BY client_id ORDER BY sec
              RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING) AS mean
          FROM (SELECT o_orderkey AS id, o_custkey AS client_id, round(o_totalprice * 100) * 0.25 AS amount,
                  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS sec FROM orders))""")
def rule_spending_deviation_orders(spark, sf_dir):
    return apply_spending_deviation_rule(order_transactions(spark, sf_dir)).select(
        "id", "client_id", "trailing_30d_avg_amount", "flag_spending_deviation"
    )


@query(
    with_tables(
        "SELECT id, card_id, txn_count_in_window, flag_velocity FROM judged", "busy", judged=flags_sql("busy")
    )
)
def rule_velocity_hot(spark, sf_dir):
    """A third of the rows on one card."""
    return apply_velocity_rule(busy_transactions(spark, sf_dir)).select(
        "id", "card_id", "txn_count_in_window", "flag_velocity"
    )


@query(
    with_tables(
        "SELECT id, card_id, round(implied_speed_kmh, 3) AS implied_speed_kmh, flag_geo_jump FROM judged",
        "busy",
        judged=flags_sql("busy"),
    )
)
def rule_geo_jump_hot(spark, sf_dir):
    return apply_geo_jump_rule(busy_transactions(spark, sf_dir)).select(
        "id", "card_id", F.round("_implied_speed_kmh", 3).alias("implied_speed_kmh"), "flag_geo_jump"
    )


@query(
    with_tables(
        "SELECT id, client_id, mean AS trailing_30d_avg_amount, flag_spending_deviation FROM judged",
        "busy",
        judged=flags_sql("busy"),
    )
)
def rule_spending_deviation_hot(spark, sf_dir):
    return apply_spending_deviation_rule(busy_transactions(spark, sf_dir)).select(
        "id", "client_id", "trailing_30d_avg_amount", "flag_spending_deviation"
    )


@query("""
    SELECT id, client_id, mean AS trailing_30d_avg_amount,
      mean IS NOT NULL AND amount > 3 * mean AS flag_spending_deviation
    FROM (SELECT *, avg(amount) OVER (PARTITION BY client_id ORDER BY sec
              RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING) AS mean
          FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE o_custkey END AS client_id,
                  round(o_totalprice * 100) * 0.25 AS amount,
                  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS sec FROM orders))""")
def rule_spending_deviation_hot_days(spark, sf_dir):
    """Times are dates only, so very many rows of the one customer share a second."""
    return apply_spending_deviation_rule(busy_orders(spark, sf_dir)).select(
        "id", "client_id", "trailing_30d_avg_amount", "flag_spending_deviation"
    )


@query(
    with_tables(
        """SELECT id, client_id, card_id, flag_amount_threshold, flag_velocity, flag_geo_jump,
             flag_spending_deviation, fraud_flag, risk_score, risk_reason FROM scored""",
        "scored",
    )
)
def score_all(spark, sf_dir):
    return score_all_rules(placed_transactions(spark, sf_dir)).select(
        *("id", "client_id", "card_id"),
        *("flag_amount_threshold", "flag_velocity", "flag_geo_jump", "flag_spending_deviation"),
        *("fraud_flag", "risk_score", "risk_reason"),
    )


@query(
    with_tables(
        """SELECT id, transaction_id, client_id, card_id, fraud_flag, risk_score, risk_reason,
             'open' AS investigation_status, '2024-02-01' AS scored_on
           FROM (SELECT *, id AS transaction_id FROM scored)""",
        "scored",
    )
)
def fraud_risk(spark, sf_dir):
    risk = silver.fraud_risk(score_all_rules(placed_transactions(spark, sf_dir)), LOADED_AT)
    return risk.withColumn("scored_on", F.date_format("scored_at", "yyyy-MM-dd")).drop("scored_at")


@query(
    with_tables(
        "SELECT avg(CASE WHEN fraud_flag THEN 1 ELSE 0 END) AS fraud_rate, count(*) AS total FROM scored", "scored"
    )
)
def fraud_rate(spark, sf_dir):
    return silver.fraud_rate(score_all_rules(placed_transactions(spark, sf_dir)))


@query(
    with_tables(
        """SELECT id, strftime(date, '%Y-%m-%d %H:%M:%S.%f') AS date, client_id, card_id, amount, channel,
             merchant_id, zip, mcc, merchant_latitude, merchant_longitude FROM placed""",
        "placed",
    )
)
def geo_enrich(spark, sf_dir):
    return placed_transactions(spark, sf_dir).withColumn(
        "date", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    )


@query(
    with_tables(
        """SELECT channel, zip IS NULL AS zip_is_null, count(*) AS count FROM placed
           WHERE merchant_latitude IS NULL GROUP BY ALL""",
        "placed",
    )
)
def missing_geo_breakdown_query(spark, sf_dir):
    return missing_geo_breakdown(placed_transactions(spark, sf_dir))


@query(
    with_tables(
        """SELECT client_id, avg(amount) AS avg_amount_30d, CAST(max(epoch_us(date)) AS BIGINT) AS as_of_us
           FROM txn GROUP BY client_id""",
        "txn",
    )
)
def spending_reference(spark, sf_dir):
    return silver.spending_reference(transactions(spark, sf_dir)).select(
        "client_id", "avg_amount_30d", F.unix_micros("as_of_date").alias("as_of_us")
    )


@query("SELECT event_id AS id, CAST(epoch_us(ts) AS BIGINT) AS date_us FROM events ORDER BY ts, event_id LIMIT 500")
def earliest_n(spark, sf_dir):
    first = silver.earliest(raw_transactions(spark, sf_dir), 500)
    return first.select("id", F.unix_micros(F.col("date").cast("timestamp")).alias("date_us"))


@query(
    with_tables(
        """SELECT 'orphan_keys' AS "check", label, violations FROM (
             SELECT 'transactions (card_id)' AS label, count(*) AS violations FROM txn
             WHERE NOT EXISTS (SELECT 1 FROM cards WHERE cards.id = txn.card_id AND card_type = 'Debit')
             UNION ALL
             SELECT 'transactions (client_id)', count(*) FROM txn
             WHERE NOT EXISTS (SELECT 1 FROM customers c WHERE c.id = txn.client_id AND c.yearly_income >= 0)
             UNION ALL
             SELECT 'transactions (merchant_id)', count(*) FROM txn
             WHERE NOT EXISTS (SELECT 1 FROM merchants m WHERE m.id = txn.merchant_id AND m.mcc_description IS NOT NULL))""",
        "txn",
        "merchants",
        "cards",
        "customers",
    )
)
def orphan_keys_query(spark, sf_dir):
    """The three checks of the fact, against dimensions from which some members were lost."""
    card_dim = scd2_merge(None, cards(spark, sf_dir), ["id"], ["card_type"], LOADED_AT)
    customer_dim = scd2_merge(None, customers(spark, sf_dir), ["id"], ["income_tier"], LOADED_AT)
    return silver.fact_orphans(
        transactions(spark, sf_dir),
        card_dim.filter(F.col("card_type") == "Debit"),
        customer_dim.filter(F.col("yearly_income") >= 0),
        merchants(spark, sf_dir).filter(F.col("mcc_description").isNotNull()),
    )


@query(
    with_tables(
        """SELECT 'orphan_keys' AS "check", 'cards' AS label, count(*) AS violations FROM cards
           WHERE NOT EXISTS (SELECT 1 FROM customers c WHERE c.id = cards.client_id AND c.yearly_income IS NOT NULL)""",
        "cards",
        "customers",
    )
)
def orphan_cards(spark, sf_dir):
    known = customers(spark, sf_dir).filter(F.col("yearly_income").isNotNull())
    return orphan_keys(cards(spark, sf_dir), "client_id", known, "id", "cards")


@query(
    with_tables(
        """SELECT CAST(count(*) FILTER (id IS NULL) AS BIGINT) AS id,
             CAST(count(*) FILTER (amount IS NULL) AS BIGINT) AS amount,
             CAST(count(*) FILTER (zip IS NULL) AS BIGINT) AS zip,
             CAST(count(*) FILTER (merchant_latitude IS NULL) AS BIGINT) AS merchant_latitude FROM placed""",
        "placed",
    )
)
def null_counts_query(spark, sf_dir):
    return null_counts(placed_transactions(spark, sf_dir), ["id", "amount", "zip", "merchant_latitude"])


@query(with_tables("SELECT count(*) AS row_count FROM txn", "txn"))
def row_count(spark, sf_dir):
    """The row-count check itself, which raises on an empty fact."""
    counted = check_row_count(transactions(spark, sf_dir), "transactions")
    return spark.createDataFrame([(counted,)], "row_count bigint")


@query("SELECT n_nationkey, lpad(CAST(501 + n_nationkey * 97 AS VARCHAR), 5, '0') AS zip, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 3 GROUP BY ALL")
def geo_reference(spark, sf_dir):
    """The postal-code reference with the number of customers living at each centroid."""
    places = geo(spark, sf_dir).withColumn("n_nationkey", ((F.col("latitude") + 60) / 5).cast("int"))
    living = customers(spark, sf_dir).groupBy("longitude").agg(F.count(F.lit(1)).alias("customers"))
    return places.join(living, "longitude", "left").select(
        "n_nationkey", "zip", F.coalesce("customers", F.lit(0)).alias("customers")
    )
