from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cardwatch.operators.scd import changed_rows, scd1_upsert, scd2_merge, scd2_scd3_merge

T1, T2, T3 = datetime(2024, 1, 1), datetime(2024, 2, 1), datetime(2024, 3, 1)
TIER = "id string, income_tier string"


@pytest.mark.parametrize(
    ("source", "target", "want"),
    [
        ([("c1", "gold"), ("c2", "silver")], [("c1", "silver"), ("c2", "silver")], {"c1"}),
        ([("c1", "gold")], [("c1", None)], {"c1"}),
        ([("c1", None)], [("c1", None)], set()),
        ([("c1", "gold"), ("c99", "bronze")], [("c1", "gold")], set()),
    ],
)
def test_changed_rows(spark, source, target, want):
    got = changed_rows(spark.createDataFrame(source, TIER), spark.createDataFrame(target, TIER), ["id"], ["income_tier"])
    assert got.columns == ["id", "income_tier"]
    assert {r.id for r in got.collect()} == want


def test_changed_rows_any_tracked_column(spark):
    schema = "id string, card_type string, credit_limit bigint"
    got = changed_rows(
        spark.createDataFrame([("card1", "GOLD", 5000)], schema), spark.createDataFrame([("card1", "GOLD", 3000)], schema),
        ["id"], ["card_type", "credit_limit"],
    )
    assert got.count() == 1


def test_scd1(spark):
    schema = "id string, city string"
    source = spark.createDataFrame([("a", "Rome"), ("c", "Oslo")], schema)
    target = spark.createDataFrame([("a", "Paris"), ("b", "Bern")], schema)
    rows = lambda df: sorted((r.id, r.city) for r in df.collect())
    merged = scd1_upsert(target, source, ["id"])
    assert rows(merged) == [("a", "Rome"), ("b", "Bern"), ("c", "Oslo")]
    assert rows(scd1_upsert(merged, source, ["id"])) == rows(merged)
    assert rows(scd1_upsert(None, source, ["id"])) == [("a", "Rome"), ("c", "Oslo")]


@pytest.mark.parametrize(("rows", "message"), [([("a", "1"), ("a", "2")], "several source rows"), ([(None, "1")], "NULL merge key")])
def test_bad_source_keys_raise(spark, rows, message):
    source = spark.createDataFrame(rows, "id string, city string")
    target = spark.createDataFrame([("b", "x")], "id string, city string")
    with pytest.raises(Exception, match=message):
        scd1_upsert(target, source, ["id"]).collect()
    with pytest.raises(Exception, match=message):
        scd2_merge(None, source, ["id"], ["city"], T1).collect()


def test_scd2_with_untracked_columns_and_expired_keys(spark):
    schema = "id string, card_type string, expires string"
    first = scd2_merge(None, spark.createDataFrame([("a", "Debit", "x"), ("b", "Debit", "x"), ("gone", "Debit", "x")], schema), ["id"], ["card_type"], T1)
    expired_only = spark.createDataFrame([("old", "Debit", "x", T1, T2, False)], first.schema)
    target = first.unionByName(expired_only)
    source = spark.createDataFrame([("a", "Credit", "y"), ("b", "Debit", "y"), ("new", None, "y"), ("old", "Credit", "y")], schema)
    got = scd2_merge(target, source, ["id"], ["card_type"], T3)
    assert got.columns == target.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [
            ("a", "Debit", "x", T1, T3, False), ("a", "Credit", "y", T3, None, True),
            ("b", "Debit", "x", T1, None, True),  # the untracked column is not refreshed
            ("gone", "Debit", "x", T1, None, True), ("new", None, "y", T3, None, True),
            ("old", "Debit", "x", T1, T2, False), ("old", "Credit", "y", T3, None, True),
        ],
        key=str,
    )


def test_scd2_scd3_hybrid(spark):
    schema = "id string, income_tier string, address string, age int"
    target = scd2_scd3_merge(
        None,
        spark.createDataFrame([(k, "low", "A St", 1) for k in ("tier", "both", "addr", "same", "gone")] + [("null", None, None, 1)], schema),
        ["id"], ["income_tier"], "address", T1,
    )
    source = spark.createDataFrame(
        [("tier", "high", "A St", 2), ("both", "high", "B St", 2), ("addr", "low", "B St", 2), ("same", "low", "A St", 2), ("new", "low", "C St", 2), ("null", "low", None, 2)],
        schema,
    )
    merge = lambda snapshot, at: scd2_scd3_merge(snapshot, source, ["id"], ["income_tier"], "address", at)
    got = merge(target, T2)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert got.columns == ["id", "income_tier", "address", "age", "previous_address", "effective_start", "effective_end", "is_current"]
    assert rows(got) == sorted(
        [
            ("tier", "low", "A St", 1, None, T1, T2, False), ("tier", "high", "A St", 2, "A St", T2, None, True),
            ("both", "low", "A St", 1, None, T1, T2, False), ("both", "high", "B St", 2, "A St", T2, None, True),
            ("addr", "low", "B St", 1, "A St", T1, None, True),
            ("same", "low", "A St", 1, None, T1, None, True), ("gone", "low", "A St", 1, None, T1, None, True),
            ("new", "low", "C St", 2, None, T2, None, True),
            ("null", None, None, 1, None, T1, T2, False), ("null", "low", None, 2, None, T2, None, True),
        ],
        key=str,
    )
    assert rows(merge(got, T3)) == rows(got)
    assert got.filter("is_current").groupBy("id").count().filter("count > 1").count() == 0


def test_scd_takes_the_clock_once(spark):
    source = spark.createDataFrame([(str(i), str(i)) for i in range(20)], TIER)
    first = scd2_merge(None, source, ["id"], ["income_tier"])
    again = scd2_merge(first, source.withColumn("income_tier", F.lit("x")), ["id"], ["income_tier"])
    assert again.filter("not is_current").select("effective_end").union(again.filter("is_current").select("effective_start")).distinct().count() == 1


def test_source_columns_must_be_known(spark):
    target = scd2_merge(None, spark.createDataFrame([("a", "low")], TIER), ["id"], ["income_tier"], T1)
    with pytest.raises(ValueError, match="region"):
        scd2_merge(target, spark.createDataFrame([("a", "low", "x")], TIER + ", region string"), ["id"], ["income_tier"], T2)


def test_rows_without_is_current_are_kept_as_closed(spark):
    schema = "id string, tier string, effective_start timestamp, effective_end timestamp, is_current boolean"
    then = datetime(2024, 1, 1)
    target = spark.createDataFrame([("a", "low", then, None, True), ("b", "low", then, None, None)], schema)
    source = spark.createDataFrame([("a", "low")], "id string, tier string")
    got = scd2_merge(target, source, ["id"], ["tier"], datetime(2024, 2, 1)).collect()
    assert sorted((r.id, r.is_current) for r in got) == [("a", True), ("b", None)]


def test_two_current_rows_of_a_key_raise(spark):
    schema = "id string, tier string, effective_start timestamp, effective_end timestamp, is_current boolean"
    then = datetime(2024, 1, 1)
    target = spark.createDataFrame([("a", "low", then, None, True), ("a", "high", then, None, True)], schema)
    source = spark.createDataFrame([("a", "low")], "id string, tier string")
    with pytest.raises(Exception, match="several current target rows"):
        scd2_merge(target, source, ["id"], ["tier"], datetime(2024, 2, 1)).collect()
