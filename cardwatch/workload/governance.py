"""Masked and filtered views, and the regions they filter by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.operators import (
    Viewer,
    assign_regions,
    card_number_mask,
    policy_view,
    register_sql_functions,
    secured_view,
)
from cardwatch.operators.access import ANALYSTS, AUDITORS, birth_year_mask
from cardwatch.operators.policies import POLICY
from cardwatch.workload.bindings import customer_snapshot, raw_cards, raw_customers, table, with_tables
from cardwatch.workload.registry import query

REGIONS = "SELECT *, 'Region_' || ntile(4) OVER (ORDER BY longitude, id) AS region FROM customers"
MANAGER = Viewer("asia@example.org")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(
        F.concat(F.lower(F.regexp_replace("r_name", " ", "_")), F.lit("@example.org")).alias("rm_email"),
        F.concat(F.lit("Region_"), (F.col("r_regionkey") % 4 + 1).cast("string")).alias("assigned_region"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_customers(spark, sf_dir).select("id", "birth_year", "longitude")


@query(with_tables("SELECT id, longitude, region FROM regions", "customers", regions=REGIONS))
def region_quartile(spark, sf_dir):
    return assign_regions(people(spark, sf_dir)).select("id", "longitude", "region")


@query(
    with_tables(
        """SELECT 'Region_' || ntile AS region, count(*) AS n
           FROM (SELECT ntile(4) OVER (ORDER BY longitude, id, is_current) AS ntile
                 FROM (SELECT id, longitude, true AS is_current FROM customers
                       UNION ALL SELECT id, longitude, false FROM customers WHERE id % 3 = 0))
           GROUP BY ntile""",
        "customers",
    )
)
def region_counts(spark, sf_dir):
    """Regions of all versions of the customer dimension, closed ones included."""
    versions = customer_snapshot(spark, sf_dir).select("id", "longitude", "is_current")
    placed = assign_regions(versions, ("longitude", "id", "is_current"))
    return placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(with_tables("SELECT id, CAST(birth_year // 10 * 10 AS INTEGER) AS birth_year, longitude FROM customers", "customers"))
def secured_customers(spark, sf_dir):
    analyst = Viewer("analyst@example.org", frozenset({ANALYSTS}))
    return secured_view(people(spark, sf_dir), analyst, {"birth_year": birth_year_mask})


@query(with_tables("SELECT id, birth_year, longitude FROM customers", "customers"))
def unmasked_customers(spark, sf_dir):
    auditor = Viewer("auditor@example.org", frozenset({AUDITORS}))
    return secured_view(people(spark, sf_dir), auditor, {"birth_year": birth_year_mask})


@query(
    with_tables(
        """SELECT id, client_id, '****-****-****-' || right(CAST(card_number AS VARCHAR), 4) AS seen_by_manager,
             CAST(card_number AS VARCHAR) AS seen_by_auditor FROM cards""",
        "cards",
    )
)
def secured_cards(spark, sf_dir):
    held = raw_cards(spark, sf_dir).select(
        "id", "client_id", F.col("card_number").alias("seen_by_manager"), F.col("card_number").alias("seen_by_auditor")
    )
    auditor = Viewer("auditor@example.org", frozenset({AUDITORS}))
    masked = secured_view(held, MANAGER, {"seen_by_manager": card_number_mask})
    return secured_view(masked, auditor, {"seen_by_auditor": card_number_mask})


@query(
    with_tables(
        """SELECT id, birth_year, longitude, region FROM regions r
           WHERE EXISTS (SELECT 1 FROM region a
                         WHERE lower(replace(a.r_name, ' ', '_')) || '@example.org' = 'asia@example.org'
                           AND 'Region_' || (a.r_regionkey % 4 + 1) = r.region)""",
        "customers",
        regions=REGIONS,
    )
)
def row_filtered_customers(spark, sf_dir):
    regions = assign_regions(people(spark, sf_dir))
    return secured_view(regions, MANAGER, {"birth_year": birth_year_mask}, assignments(spark, sf_dir)).select(
        "id", "birth_year", "longitude", "region"
    )


# The access matrix of the roles.
MATRIX = [
    ("*", "customers", None, "assigned"),
    ("*", "customers", "birth_year", "plain"),
    (ANALYSTS, "customers", None, "all"),
    (ANALYSTS, "customers", "birth_year", "decade"),
    (AUDITORS, "customers", None, "all"),
    (AUDITORS, "customers", "birth_year", "plain"),
    ("*", "cards", None, "assigned"),
    ("*", "cards", "card_number", "last4"),
    (ANALYSTS, "cards", None, "all"),
    (ANALYSTS, "cards", "card_number", "last4"),
    (AUDITORS, "cards", None, "all"),
    (AUDITORS, "cards", "card_number", "plain"),
]


def held_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with their customer's region."""
    homes = assign_regions(people(spark, sf_dir)).select(F.col("id").alias("client_id"), "region")
    return raw_cards(spark, sf_dir).select("id", "client_id", "card_number").join(homes, "client_id")


def by_policy(spark: SparkSession, sf_dir: str, viewer: Viewer) -> DataFrame:
    """Both tables as one viewer sees them, told apart by ``part``."""
    policy, mine = spark.createDataFrame(MATRIX, POLICY), assignments(spark, sf_dir)
    homes = assign_regions(people(spark, sf_dir))
    seen = policy_view(homes, "customers", viewer, policy, mine)
    held = policy_view(held_cards(spark, sf_dir), "cards", viewer, policy, mine)
    return seen.select(
        F.lit("customers").alias("part"), "id", F.col("birth_year").cast("string").alias("shown"), "region"
    ).unionByName(held.select(F.lit("cards").alias("part"), "id", F.col("card_number").alias("shown"), "region"))


def policy_sql(year: str, number: str, rows: str) -> str:
    return with_tables(
        f"""SELECT 'customers' AS part, id, CAST({year} AS VARCHAR) AS shown, region FROM regions WHERE {rows}
            UNION ALL
            SELECT 'cards', c.id, {number}, region FROM cards c JOIN regions r ON r.id = c.client_id WHERE {rows}""",
        "customers",
        "cards",
        regions=REGIONS,
    )


LAST4 = "'****-****-****-' || right(CAST(card_number AS VARCHAR), 4)"
MINE = """region IN (SELECT 'Region_' || (r_regionkey % 4 + 1) FROM region
            WHERE lower(replace(r_name, ' ', '_')) || '@example.org' = 'asia@example.org')"""


@query(policy_sql("birth_year // 10 * 10", LAST4, "true"))
def policy_analyst(spark, sf_dir):
    return by_policy(spark, sf_dir, Viewer("analyst@example.org", frozenset({ANALYSTS})))


@query(policy_sql("birth_year", LAST4, MINE))
def policy_manager(spark, sf_dir):
    return by_policy(spark, sf_dir, MANAGER)


@query(policy_sql("birth_year", "CAST(card_number AS VARCHAR)", "true"))
def policy_auditor(spark, sf_dir):
    """In both groups: what shows more counts."""
    return by_policy(spark, sf_dir, Viewer("auditor@example.org", frozenset({AUDITORS, ANALYSTS})))


@query(
    with_tables(
        f"""SELECT r.id, birth_year, {LAST4} AS card_number, region FROM regions r JOIN cards c ON c.client_id = r.id
            WHERE {MINE}""",
        "customers",
        "cards",
        regions=REGIONS,
    )
)
def sql_secured_view(spark, sf_dir):
    """Masks and row filter in SQL text alone, over session functions."""
    register_sql_functions(spark)
    return spark.sql(
        """SELECT p.id, mask_birth_year(p.birth_year, split(:groups, ',')) AS birth_year,
             mask_card_number(CAST(c.card_number AS STRING), split(:groups, ',')) AS card_number, p.region
           FROM {people} p JOIN {cards} c ON c.client_id = p.id
           WHERE sees_all_regions(split(:groups, ','))
              OR EXISTS (SELECT 1 FROM {assigned} a WHERE a.rm_email = :who AND a.assigned_region = p.region)""",
        args={"who": MANAGER.email, "groups": ",".join(sorted(MANAGER.groups))},
        people=assign_regions(people(spark, sf_dir)),
        cards=raw_cards(spark, sf_dir),
        assigned=assignments(spark, sf_dir),
    )
