import random

import pytest
from pyspark.sql import functions as F

from cardwatch.functions import CHANNEL_NAMES, clean_zip, decade, income_tier, mask_pan, parse_currency, recode
from cardwatch.operators import (
    Viewer,
    assign_regions,
    card_number_mask,
    check_orphan_keys,
    check_rescued_rows,
    check_row_count,
    global_ntile,
    null_counts,
    check_schema_drift,
    schema_drift,
    secured_view,
)
from cardwatch.operators.access import ANALYSTS, AUDITORS, birth_year_mask
from cardwatch.plans import gold, silver


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(expression).collect()]


def test_parse_currency(spark):
    got = apply(spark, ["$59,696.00", "$-77.5", "59696", "abc", "", None], parse_currency("v"))
    assert got == [59696.0, -77.5, 59696.0, None, None, None]


def test_clean_zip(spark):
    got = apply(spark, ["2134.0", "501", "123456", "12345-6789", "NaN", None, "90210"], clean_zip("v"))
    assert got == ["02134", "00501", "12345", None, None, None, "90210"]
    assert apply(spark, [501, 99950], clean_zip("v"), "int") == ["00501", "99950"]


def test_income_tier(spark):
    got = apply(spark, [None, -5.0, 29999.99, 30000.0, 80000.0, 150000.0], income_tier("v"), "double")
    assert got == ["unknown", "low", "low", "medium", "high", "very_high"]


def test_recode_mask_decade(spark):
    assert apply(spark, ["Chip Transaction", "Fax", None], recode("v", CHANNEL_NAMES)) == ["chip", "Fax", None]
    assert apply(spark, ["4344676511950444", None], mask_pan("v")) == ["****-****-****-0444", None]
    assert apply(spark, [4344676511950444], mask_pan("v"), "bigint") == ["****-****-****-0444"]
    assert apply(spark, [1987, 1990, None], decade("v"), "int") == [1980, 1990, None]


def test_orphans(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id bigint, fk string")
    ref = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    assert check_orphan_keys(df, "fk", ref, "key", "rows") == 2
    assert check_orphan_keys(df.filter("id < 3"), "fk", ref, "key", "rows") == 0


def test_null_counts(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, "y")], "a bigint, b string")
    assert null_counts(df).first().asDict() == {"a": 1, "b": 1}
    assert null_counts(df, ["b"]).first().asDict() == {"b": 1}
    assert null_counts(df.filter("false")).first().asDict() == {"a": None, "b": None}


def test_counts(spark):
    assert check_row_count(spark.range(2), "two") == 2
    with pytest.raises(ValueError):
        check_row_count(spark.range(0), "none")
    df = spark.createDataFrame([(1, None), (2, "malformed")], "id bigint, _rescued_data string")
    assert check_rescued_rows(df, "rows") == 1
    assert check_rescued_rows(df.drop("_rescued_data"), "rows") == 0


def test_schema_drift(spark):
    frame = spark.createDataFrame([], "a int, c int, _rescued_data string")
    got = {row["column"]: row["status"] for row in schema_drift(frame, ["a", "b"]).collect()}
    assert got == {"a": "matched", "b": "missing", "c": "unexpected"}
    assert check_schema_drift(frame, ["a", "b"], "s") == {"matched": ["a"], "missing": ["b"], "unexpected": ["c"]}


@pytest.mark.parametrize(("rows", "buckets"), [(0, 4), (3, 4), (1498, 4), (1000, 7)])
def test_global_ntile(spark, rows, buckets):
    rng = random.Random(1)
    # a third of the rows share one value
    data = [(i, 0.0 if i % 3 == 0 else rng.choice([None, rng.uniform(-9, 9)])) for i in range(rows)]
    df = spark.createDataFrame(data, "id long, longitude double")
    got = global_ntile(df, ["longitude", "id"], buckets)
    want = df.selectExpr("*", f"ntile({buckets}) over (order by longitude, id) as ntile")
    assert got.columns == ["id", "longitude", "ntile"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_access(spark):
    people = spark.createDataFrame([(i, float(i), 1980 + i, 4000000000000000 + i) for i in range(8)], "id long, longitude double, birth_year int, card_number bigint")
    regions = assign_regions(people)
    assert sorted((r.region, r["count"]) for r in regions.groupBy("region").count().collect()) == [(f"Region_{n}", 2) for n in range(1, 5)]
    assigned = spark.createDataFrame([("rm@example.org", "Region_1"), ("rm@example.org", "Region_1"), ("other@example.org", "Region_2")], "rm_email string, assigned_region string")
    masks = {"birth_year": birth_year_mask, "card_number": card_number_mask}
    see = lambda viewer: {r.id: (r.birth_year, r.card_number) for r in secured_view(regions, viewer, masks, assigned).collect()}
    manager = see(Viewer("rm@example.org"))
    assert manager == {0: (1980, "****-****-****-0000"), 1: (1981, "****-****-****-0001")}
    analyst = see(Viewer("a@example.org", frozenset({ANALYSTS})))
    assert len(analyst) == 8 and analyst[7] == (1980, "****-****-****-0007")
    auditor = see(Viewer("b@example.org", frozenset({AUDITORS})))
    assert len(auditor) == 8 and auditor[7] == (1987, "4000000000000007")
    assert see(Viewer("nobody@example.org")) == {}


def test_merchants_and_gold(spark):
    raw = spark.createDataFrame(
        [("1", "2024-01-01 10:00:00", "m1", "Old", "NY", "501", "10"), ("2", "2024-01-02 10:00:00", "m1", "New", "NY", "501.0", "10"), ("3", "2024-01-01 10:00:00", "m2", "X", None, None, "99")],
        "id string, date string, merchant_id string, merchant_city string, merchant_state string, zip string, mcc string",
    )
    mcc = spark.createDataFrame([("10", "Food")], "mcc string, mcc_description string")
    merchants = silver.merchants(raw, mcc)
    assert sorted(map(tuple, merchants.collect())) == [("m1", "New", "NY", "00501", "10", "Food"), ("m2", "X", None, None, "99", None)]

    risk = spark.createDataFrame(
        [("1", "c1", "k1", True, 25, "velocity"), ("2", "c1", "k1", False, 0, None), ("3", "c2", "k2", None, 0, None)],
        "id string, client_id string, card_id string, fraud_flag boolean, risk_score int, risk_reason string",
    ).withColumns({"transaction_id": F.col("id"), "scored_at": F.lit("2024-02-01").cast("timestamp")})
    txns = raw.select("id", F.col("date").cast("timestamp").alias("date"), F.when(F.col("id") == "1", 10.0).alias("amount"), "merchant_id")
    streaming = risk.filter("id = '2'").withColumn("transaction_id", F.lit("s9"))
    fraud = gold.unified_risk(risk.withColumn("investigation_status", F.lit("open")), txns, streaming, txns.filter("false"))
    assert fraud.count() == 4
    assert fraud.filter("source = 'streaming'").select("amount", "merchant_id", "investigation_status").first() == (0.0, None, "open")
    daily = {(str(r.txn_date), r.source): r for r in gold.daily_fraud_summary(fraud).collect()}
    assert daily["2024-01-01", "batch"].fraud_rate == 0.5 and daily["2024-01-01", "batch"].flagged_amount == 10.0
    dim = spark.createDataFrame([("c1", "low", "A St", True), ("c1", "high", "B St", False)], "id string, income_tier string, address string, is_current boolean")
    profile = gold.customer_risk_profile(fraud, dim).collect()
    assert len(profile) == 1 and profile[0].source == ["batch", "streaming"] and profile[0].total_transactions == 3
    assert profile[0].avg_transaction_amount == 5.0 and profile[0].income_tier == "low"
    spend = {(r.mcc_description, r.source): (r.transaction_count, r.total_amount, r.avg_amount) for r in gold.merchant_category_spend(fraud, merchants).collect()}
    assert spend == {("Food", "batch"): (2, 10.0, 10.0), (None, "batch"): (1, None, None)}
    assert [r.transaction_id for r in gold.investigation_queue(fraud).collect()] == ["1"]
    assert gold.unified_risk(risk.withColumn("investigation_status", F.lit("open")), txns).count() == 3


def test_amounts_that_are_not_finite_are_unknown(spark):
    rows = spark.createDataFrame([("$NaN",), ("$Infinity",), ("-Infinity",), ("$1,5",), (None,)], "raw string")
    assert [r[0] for r in rows.select(parse_currency("raw")).collect()] == [None, None, None, 15.0, None]
