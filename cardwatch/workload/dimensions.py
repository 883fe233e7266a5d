"""Slowly changing dimensions and the merchant dimension."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.operators.scd import changed_rows, scd1_upsert, scd2_merge, scd2_scd3_merge
from cardwatch.plans import silver
from cardwatch.session import fresh_folder
from cardwatch.sources import read_json_map, read_zip_centroids
from cardwatch.workload.bindings import (
    LOADED_AT,
    MERGED_AT,
    card_snapshot,
    card_update,
    cards,
    categories,
    customer_snapshot,
    customer_update,
    customers,
    geo,
    merchants,
    transactions,
    with_tables,
)
from cardwatch.workload.registry import query

SNAPSHOT = """
    SELECT id, address, yearly_income, income_tier, birth_year, longitude,
      CAST(NULL AS VARCHAR) AS previous_address, '2024-02-01' AS valid_from,
      CAST(NULL AS VARCHAR) AS valid_to, true AS is_current FROM customers
    UNION ALL
    SELECT id, address, yearly_income, 'earlier', birth_year, longitude, NULL, '2023-01-01', '2024-02-01', false
    FROM customers WHERE id % 3 = 0"""

UPDATE = """
    SELECT id, CASE WHEN id % 5 = 0 THEN '12 New Road' ELSE address END AS address, yearly_income,
      CASE WHEN id % 7 = 0 THEN 'very_high' ELSE income_tier END AS income_tier,
      birth_year + 1 AS birth_year, longitude
    FROM customers WHERE yearly_income > -10000 OR yearly_income IS NULL
    UNION ALL
    SELECT id + 1000000000, address, yearly_income, income_tier, birth_year, longitude
    FROM customers WHERE id % 10 = 0"""

CARD_UPDATE = """
    SELECT id, client_id, card_type, '12/2030' AS expires, CASE WHEN id % 30 <> 0 THEN has_chip END AS has_chip,
      CASE WHEN id % 20 = 0 THEN credit_limit + 500 ELSE credit_limit END AS credit_limit FROM cards"""


def dated(df: DataFrame) -> DataFrame:
    """Validity as text, which both engines print alike."""
    return df.withColumns(
        {
            "valid_from": F.date_format("effective_start", "yyyy-MM-dd"),
            "valid_to": F.date_format("effective_end", "yyyy-MM-dd"),
        }
    ).drop("effective_start", "effective_end")


@query(
    with_tables(
        """SELECT u.* FROM updated u JOIN snapshot s ON u.id = s.id AND s.is_current
           WHERE u.income_tier IS DISTINCT FROM s.income_tier OR u.address IS DISTINCT FROM s.address""",
        "customers",
        snapshot=SNAPSHOT,
        updated=UPDATE,
    )
)
def scd_changed_rows(spark, sf_dir):
    current = silver.current(customer_snapshot(spark, sf_dir))
    return changed_rows(customer_update(spark, sf_dir), current, ["id"], ["income_tier", "address"])


@query(
    with_tables(
        """SELECT * FROM updated UNION ALL
           SELECT * FROM (SELECT id, address, yearly_income, income_tier, birth_year, longitude FROM customers) t
           WHERE NOT EXISTS (SELECT 1 FROM updated u WHERE u.id = t.id)""",
        "customers",
        updated=UPDATE,
    )
)
def scd1_upsert_query(spark, sf_dir):
    update = customer_update(spark, sf_dir)
    return scd1_upsert(customers(spark, sf_dir).select(*update.columns), update, ["id"])


@query(
    with_tables(
        """SELECT id, client_id, card_brand, card_type, '****-****-****-' || right(CAST(card_number AS VARCHAR), 4)
             AS card_number_masked, '12/2027' AS expires, has_chip, credit_limit, '2024-02-01' AS valid_from,
             CAST(NULL AS VARCHAR) AS valid_to, true AS is_current FROM cards""",
        "cards",
    )
)
def scd2_initial_load(spark, sf_dir):
    return dated(
        scd2_merge(None, cards(spark, sf_dir), ["id"], ["card_type", "has_chip", "credit_limit"], LOADED_AT)
    )


@query(
    with_tables(
        """SELECT c.id, c.card_type, '12/2027' AS expires, c.has_chip, c.credit_limit, '2024-02-01' AS valid_from,
             CASE WHEN changed THEN '2024-03-01' END AS valid_to, NOT changed AS is_current
           FROM cards c JOIN compared USING (id)
           UNION ALL
           SELECT u.id, u.card_type, u.expires, u.has_chip, u.credit_limit, '2024-03-01', NULL, true
           FROM updated u JOIN compared USING (id) WHERE changed""",
        "cards",
        updated=CARD_UPDATE,
        compared="""SELECT c.id, c.card_type IS DISTINCT FROM u.card_type OR c.has_chip IS DISTINCT FROM u.has_chip
                      OR c.credit_limit IS DISTINCT FROM u.credit_limit AS changed
                    FROM cards c JOIN updated u ON c.id = u.id""",
    )
)
def scd2_merge_query(spark, sf_dir):
    merged = scd2_merge(
        card_snapshot(spark, sf_dir),
        card_update(spark, sf_dir),
        ["id"],
        ["card_type", "has_chip", "credit_limit"],
        MERGED_AT,
    )
    return dated(merged).select(
        *("id", "card_type", "expires", "has_chip", "credit_limit", "valid_from", "valid_to", "is_current")
    )


@query(
    with_tables(
        """SELECT * FROM snapshot WHERE NOT is_current
           UNION ALL
           SELECT s.id, CASE WHEN moved AND NOT changed THEN new_address ELSE s.address END, s.yearly_income,
             s.income_tier, s.birth_year, s.longitude,
             CASE WHEN moved AND NOT changed THEN s.address ELSE s.previous_address END, s.valid_from,
             CASE WHEN changed THEN '2024-03-01' ELSE s.valid_to END, NOT coalesce(changed, false)
           FROM snapshot s LEFT JOIN compared USING (id) WHERE s.is_current
           UNION ALL
           SELECT u.id, u.address, u.yearly_income, u.income_tier, u.birth_year, u.longitude, old_address,
             '2024-03-01', NULL, true
           FROM updated u LEFT JOIN compared USING (id) WHERE changed IS NULL OR changed""",
        "customers",
        snapshot=SNAPSHOT,
        updated=UPDATE,
        compared="""SELECT s.id, s.income_tier IS DISTINCT FROM u.income_tier AS changed,
                      s.address IS DISTINCT FROM u.address AS moved, u.address AS new_address, s.address AS old_address
                    FROM snapshot s JOIN updated u ON s.id = u.id WHERE s.is_current""",
    )
)
def scd23_merge(spark, sf_dir):
    return dated(
        scd2_scd3_merge(
            customer_snapshot(spark, sf_dir),
            customer_update(spark, sf_dir),
            ["id"],
            ["income_tier"],
            "address",
            MERGED_AT,
        )
    )


@query(
    with_tables(
        """SELECT id, address, yearly_income, income_tier, birth_year, longitude, previous_address, valid_from,
             valid_to, is_current FROM snapshot""",
        "customers",
        snapshot=SNAPSHOT,
    )
)
def scd23_initial_load(spark, sf_dir):
    return dated(customer_snapshot(spark, sf_dir))


@query(
    with_tables(
        """SELECT c.id, c.card_brand, c.card_type, '****-****-****-' || right(CAST(card_number AS VARCHAR), 4)
             AS card_number_masked, c.credit_limit, u.income_tier FROM cards c JOIN customers u ON c.client_id = u.id""",
        "cards",
        "customers",
    )
)
def conformed_cards(spark, sf_dir):
    owners = customers(spark, sf_dir).select(F.col("id").alias("client_id"), "income_tier")
    return (
        cards(spark, sf_dir)
        .join(owners, "client_id")
        .select("id", "card_brand", "card_type", "card_number_masked", "credit_limit", "income_tier")
    )


@query(with_tables("SELECT id, merchant_city, merchant_state, merchant_zip, mcc FROM merchants", "merchants"))
def merchants_dedup(spark, sf_dir):
    return merchants(spark, sf_dir).drop("mcc_description")


@query(with_tables("SELECT * FROM merchants", "merchants"))
def merchants_dim(spark, sf_dir):
    return merchants(spark, sf_dir)


@query(
    with_tables(
        "SELECT t.id, t.mcc, n.n_name AS mcc_description FROM txn t LEFT JOIN nation n ON t.mcc = CAST(5000 + n_nationkey AS VARCHAR)",
        "txn",
    )
)
def mcc_lookup(spark, sf_dir):
    """The category of every transaction, from a JSON file with one flat object."""
    path = fresh_folder(spark, "mcc")
    # One entry per category, a fixed small vocabulary.
    pairs = F.map_from_entries(F.collect_list(F.struct("mcc", "mcc_description")))
    categories(spark, sf_dir).agg(F.to_json(pairs).alias("value")).write.text(path)
    return (
        transactions(spark, sf_dir)
        .join(read_json_map(spark, path), "mcc", "left")
        .select("id", "mcc", "mcc_description")
    )


@query(
    with_tables(
        "SELECT t.id, t.zip, g.latitude, g.longitude FROM txn t LEFT JOIN geo g ON t.zip = g.zip", "txn", "geo"
    )
)
def zip_lookup(spark, sf_dir):
    """The place of every transaction, from a CSV file whose inference drops leading zeros."""
    path = fresh_folder(spark, "zip")
    geo(spark, sf_dir).select(
        F.col("zip").cast("int").alias("zip_code"), "latitude", "longitude"
    ).write.option("header", True).csv(path)
    return (
        transactions(spark, sf_dir)
        .join(read_zip_centroids(spark, path), "zip", "left")
        .select("id", "zip", "latitude", "longitude")
    )


@query(
    with_tables(
        """SELECT c.id, c.card_type, CASE WHEN changed THEN '12/2027' ELSE u.expires END AS expires, c.has_chip,
             c.credit_limit, '2024-02-01' AS valid_from, CASE WHEN changed THEN '2024-03-01' END AS valid_to,
             NOT changed AS is_current
           FROM cards c JOIN updated u USING (id) JOIN compared USING (id)
           UNION ALL
           SELECT u.id, u.card_type, u.expires, u.has_chip, u.credit_limit, '2024-03-01', NULL, true
           FROM updated u JOIN compared USING (id) WHERE changed
           UNION ALL
           SELECT id, 'Earlier', '01/2001', has_chip, credit_limit, '2023-01-01', '2024-02-01', false
           FROM cards WHERE id % 3 = 0""",
        "cards",
        updated=CARD_UPDATE,
        compared="""SELECT c.id, c.card_type IS DISTINCT FROM u.card_type OR c.has_chip IS DISTINCT FROM u.has_chip
                      OR c.credit_limit IS DISTINCT FROM u.credit_limit AS changed
                    FROM cards c JOIN updated u ON c.id = u.id""",
    )
)
def scd_hybrid(spark, sf_dir):
    """Expiry dates are refreshed in place: alone, beside a tracked change, and never on closed rows."""
    loaded = card_snapshot(spark, sf_dir)
    closed = loaded.filter(F.col("id") % 3 == 0).withColumns(
        {
            "card_type": F.lit("Earlier"),
            "expires": F.lit("01/2001"),
            "effective_start": F.lit(datetime(2023, 1, 1)).cast("timestamp"),
            "effective_end": F.lit(LOADED_AT).cast("timestamp"),
            "is_current": F.lit(False),
        }
    )
    merged = scd2_merge(
        loaded.unionByName(closed),
        card_update(spark, sf_dir),
        ["id"],
        ["card_type", "has_chip", "credit_limit"],
        MERGED_AT,
        scd1_cols=["expires"],
    )
    return dated(merged).select(
        *("id", "card_type", "expires", "has_chip", "credit_limit", "valid_from", "valid_to", "is_current")
    )
