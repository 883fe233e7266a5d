"""Ingest, layouts and versioned tables. Each query writes the whole table to the shared folder,
reads it back through the operator and returns all of it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.functions import parse_currency
from cardwatch.operators import counting, rescued_rows, type_drift
from cardwatch.session import fresh_folder
from cardwatch.sources import SnapshotTable, ingest_csv_folder, write_by_month, write_clustered, write_interleaved
from cardwatch.sources.schemas import TRANSACTION_COLUMNS, TRANSACTION_HINTS
from cardwatch.workload.bindings import raw_transactions, table, transactions, with_tables
from cardwatch.workload.registry import query

MID_MONTH = "2024-01-15"


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw transactions as text; some dates are damaged, ``points`` is a column without a hint."""
    stamp = F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return raw_transactions(spark, sf_dir).select(
        "id",
        F.when(F.col("id") % 97 == 0, "someday").otherwise(stamp).alias("date"),
        *("client_id", "card_id", "amount", "use_chip", "merchant_id"),
        *("merchant_city", "merchant_state", "zip", "mcc"),
        (F.col("id") % 10).alias("points"),
        (F.col("date") < F.lit(MID_MONTH).cast("timestamp_ntz")).alias("early"),
    )


def drop_csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").option("header", True).csv(folder)


def ingest(spark: SparkSession, root: str) -> DataFrame:
    return ingest_csv_folder(
        spark, f"{root}/in", f"{root}/raw", f"{root}/state", "raw_transactions", TRANSACTION_HINTS, TRANSACTION_COLUMNS
    )


@query("""
    SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 97 <> 0 THEN CAST(epoch_us(ts) AS BIGINT) END AS date_us,
      CASE WHEN event_id % 101 <> 0 THEN round(value * 100) * 0.25 END AS amount,
      CAST(event_id % 10 AS INTEGER) AS points, event_id % 97 = 0 AS rescued, true AS has_source
    FROM events""")
def ingest_csv(spark, sf_dir):
    root = fresh_folder(spark, "ingest")
    drop_csv(csv_rows(spark, sf_dir).drop("early"), f"{root}/in")
    return ingest(spark, root).select(
        "id",
        F.unix_micros("date").alias("date_us"),
        parse_currency("amount").alias("amount"),
        "points",
        F.col("_rescued_data").isNotNull().alias("rescued"),
        F.col("_source_file").isNotNull().alias("has_source"),
    )


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id % 10 AS INTEGER) AS points FROM events")
def ingest_incremental(spark, sf_dir):
    """Two deliveries and three runs: every row comes in once."""
    root = fresh_folder(spark, "ingest")
    rows = csv_rows(spark, sf_dir)
    drop_csv(rows.filter("early").drop("early"), f"{root}/in")
    ingest(spark, root)
    drop_csv(rows.filter("not early").drop("early"), f"{root}/in")
    ingest(spark, root)
    return ingest(spark, root).select("id", "points")


@query("""
    SELECT CAST(event_id AS VARCHAR) AS id,
      CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN CAST(event_id % 10 AS INTEGER) END AS points,
      CAST(5000 + event_id % (SELECT count(*) FROM supplier) % 28 AS VARCHAR) AS mcc
    FROM events""")
def ingest_evolved(spark, sf_dir):
    """The second delivery has a new column, and in the middle of the header."""
    root = fresh_folder(spark, "ingest")
    rows = csv_rows(spark, sf_dir)
    drop_csv(rows.filter("early").drop("early", "points"), f"{root}/in")
    ingest(spark, root)
    later = rows.filter("not early")
    drop_csv(later.select("id", "points", *[c for c in TRANSACTION_COLUMNS if c != "id"]), f"{root}/in")
    return ingest(spark, root).select("id", "points", "mcc")


@query("""SELECT CAST(event_id AS VARCHAR) AS id, '{"date":"someday"}' AS _rescued_data FROM events WHERE event_id % 97 = 0""")
def rescued_rows_query(spark, sf_dir):
    root = fresh_folder(spark, "ingest")
    drop_csv(csv_rows(spark, sf_dir).drop("early"), f"{root}/in")
    return rescued_rows(ingest(spark, root)).select("id", "_rescued_data")


@query(
    with_tables(
        "SELECT id, amount, zip, CAST(year(date) AS INTEGER) AS txn_year, CAST(month(date) AS INTEGER) AS txn_month FROM txn",
        "txn",
    )
)
def fact_partitioned(spark, sf_dir):
    path = fresh_folder(spark, "fact")
    write_by_month(transactions(spark, sf_dir), path)
    return spark.read.parquet(path).select("id", "amount", "zip", "txn_year", "txn_month")


@query(with_tables("SELECT client_id, card_id, count(*) AS n, sum(amount) AS total FROM txn GROUP BY ALL", "txn"))
def clustered_fact(spark, sf_dir):
    path = fresh_folder(spark, "fact")
    write_clustered(transactions(spark, sf_dir), path)
    return (
        spark.read.parquet(path)
        .groupBy("client_id", "card_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    )


def score_versions(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    """Three versions of a score: with gaps, repaired, and recalibrated."""
    rows = transactions(spark, sf_dir).select("id", (F.col("amount") > 2000).cast("int").alias("fired"))
    history = SnapshotTable(spark, fresh_folder(spark, "risk"))
    history.publish(rows.select("id", (F.col("fired") * 25).alias("risk_score")), datetime(2024, 1, 1))
    repaired = F.coalesce("fired", F.lit(0))
    history.publish(rows.select("id", (repaired * 25).alias("risk_score")), datetime(2024, 1, 10))
    history.publish(rows.select("id", (repaired * 50).alias("risk_score")), datetime(2024, 1, 20))
    return history


@query(
    with_tables(
        """SELECT CAST(0 AS BIGINT) AS version, count(*) FILTER (amount IS NULL) AS null_risk_score_rows FROM txn
           UNION ALL SELECT 1, 0 UNION ALL SELECT 2, 0""",
        "txn",
    )
)
def version_audit(spark, sf_dir):
    return score_versions(spark, sf_dir).audit([0, 1, 2], "risk_score")


@query(
    with_tables(
        "SELECT id, CASE WHEN amount > 2000 THEN 25 ELSE 0 END AS risk_score FROM txn", "txn"
    )
)
def read_as_of(spark, sf_dir):
    return score_versions(spark, sf_dir).read(timestamp=datetime(2024, 1, 15))


@query(
    with_tables(
        """SELECT version, strftime(committed_at, '%Y-%m-%d') AS committed_on, row_count
           FROM (SELECT v.*, lead(committed_at) OVER (ORDER BY version) AS replaced_at
                 FROM (VALUES (CAST(0 AS BIGINT), TIMESTAMP '2024-01-01'), (1, TIMESTAMP '2024-01-10'),
                              (2, TIMESTAMP '2024-01-20')) v(version, committed_at)),
                (SELECT count(*) AS row_count FROM txn)
           WHERE replaced_at < TIMESTAMP '2024-01-21' - INTERVAL 168 HOUR""",
        "txn",
    )
)
def expired_versions(spark, sf_dir):
    """The dry run of the retention: which versions would go, and how many rows each holds."""
    history = score_versions(spark, sf_dir)
    expired = history.expired(datetime(2024, 1, 21))
    sizes = history.read_versions([0, 1, 2]).groupBy("version").agg(F.count(F.lit(1)).alias("row_count"))
    return sizes.join(expired, "version").select(
        "version", F.date_format("committed_at", "yyyy-MM-dd").alias("committed_on"), "row_count"
    )


COUNTED = ("id", "amount", "zip", "merchant_id")


@query(
    with_tables(
        " UNION ALL ".join(
            f"SELECT '{name}' AS column_name, count(*) AS n_rows, count(*) FILTER ({name} IS NULL) AS n_nulls FROM txn"
            for name in COUNTED
        ),
        "txn",
    )
)
def publish_counts(spark, sf_dir):
    """Rows and NULLs as the publishing write itself counted them."""
    rows, counts = counting(transactions(spark, sf_dir), "transactions", COUNTED)
    SnapshotTable(spark, fresh_folder(spark, "fact")).publish(rows, datetime(2024, 1, 1))
    found = [(name, counts.rows, counts.nulls[name]) for name in COUNTED]
    return spark.createDataFrame(found, "column_name string, n_rows long, n_nulls long")


CURVE = ("l_orderkey", "l_partkey")
FILES = 16


def filters(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    """For each clustered column the second quarter of its range."""
    ends = table(spark, sf_dir, "lineitem").agg(*[f(name).alias(f"{f.__name__}_{name}") for name in CURVE for f in (F.min, F.max)]).first()
    found = {}
    for name in CURVE:
        low, high = ends[f"min_{name}"], ends[f"max_{name}"]
        found[name] = (low + (high - low) // 4, low + (high - low) // 2)
    return found


def files_for(spark: SparkSession, path: str, name: str, low: int, high: int) -> int:
    """How many files a filter cannot skip by their least and greatest value."""
    spans = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min(name).alias("low"), F.max(name).alias("high"))
    return spans.filter((F.col("high") >= low) & (F.col("low") <= high)).count()


@query("""
    WITH ends AS (SELECT min(l_orderkey) AS lo, max(l_orderkey) AS ho, min(l_partkey) AS lp, max(l_partkey) AS hp FROM lineitem)
    SELECT 'l_orderkey' AS column_name, count(*) AS n_rows, sum(l_quantity) AS quantity, true AS skips_files FROM lineitem, ends
    WHERE l_orderkey BETWEEN lo + (ho - lo) // 4 AND lo + (ho - lo) // 2
    UNION ALL
    SELECT 'l_partkey', count(*), sum(l_quantity), true FROM lineitem, ends
    WHERE l_partkey BETWEEN lp + (hp - lp) // 4 AND lp + (hp - lp) // 2""")
def interleaved_lineitem(spark, sf_dir):
    """Line items along a curve over two independent columns: a filter on either one skips files. Sorted by
    both, the filter on the second skips none."""
    path = fresh_folder(spark, "lineitem")
    write_interleaved(table(spark, sf_dir, "lineitem"), path, CURVE, FILES)
    parts = []
    for name, (low, high) in filters(spark, sf_dir).items():
        skips = files_for(spark, path, name, low, high) < 0.75 * FILES
        kept = spark.read.parquet(path).filter(F.col(name).between(low, high))
        totals = kept.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))
        parts.append(totals.select(F.lit(name).alias("column_name"), "n_rows", "quantity", F.lit(skips).alias("skips_files")))
    return parts[0].unionByName(parts[1])


# An expectation of the documents table that three columns do not meet.
EXPECTED = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "int", "n_chars": "double", "licence": "string"}


@query("""
    WITH expected(column_name, expected_type) AS (VALUES ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'),
           ('source', 'int'), ('n_chars', 'double'), ('licence', 'string')),
    found AS (SELECT column_name, CASE lower(data_type) WHEN 'varchar' THEN 'string' WHEN 'integer' THEN 'int' ELSE lower(data_type) END AS found_type
              FROM (DESCRIBE documents) t(column_name, data_type))
    SELECT coalesce(e.column_name, f.column_name) AS "column",
      CASE WHEN found_type IS NULL THEN 'missing' WHEN expected_type IS NULL THEN 'unexpected'
           WHEN expected_type = found_type THEN 'matched' ELSE 'retyped' END AS status, expected_type, found_type
    FROM expected e FULL JOIN found f USING (column_name)""")
def schema_drift(spark, sf_dir):
    """The documents table against an expectation: columns and types."""
    return type_drift(table(spark, sf_dir, "documents"), EXPECTED)
