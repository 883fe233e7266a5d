"""Policy tables, space-filling layout, counts that come with a write, the third change class of a merge."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cardwatch.operators import Viewer, counting, policy_view, type_drift
from cardwatch.operators.policies import POLICY, register_sql_functions
from cardwatch.operators.scd import scd2_merge, scd2_scd3_merge
from cardwatch.sources import SnapshotTable, write_clustered, write_interleaved
from cardwatch.sources.sinks import curve_place

RULES = [
    ("*", "people", None, "assigned"), ("*", "people", "card", "last4"), ("*", "people", "born", "hidden"),
    ("analysts", "people", None, "all"), ("analysts", "people", "born", "decade"),
    ("auditors", "people", None, "all"), ("auditors", "people", "card", "plain"), ("auditors", "people", "born", "plain"),
    ("auditors", "people", "mail", "plain"), ("*", "people", "mail", "digest"), ("bi", "gold", None, "all"),
]


@pytest.fixture(scope="module")
def policy(spark):
    return spark.createDataFrame(RULES, POLICY)


@pytest.fixture(scope="module")
def people(spark):
    rows = [(1, 1987, 4111222233334444, "a@x", "west"), (2, None, None, None, "east"), (3, 2001, 5500, "b@x", None)]
    return spark.createDataFrame(rows, "id int, born int, card long, mail string, region string")


def seen(people, policy, *groups, email="m@x"):
    mine = people.sparkSession.createDataFrame([("m@x", "west"), ("m@x", "west"), ("n@x", "east")], "rm_email string, assigned_region string")
    return {r.id: r for r in policy_view(people, "people", Viewer(email, frozenset(groups)), policy, mine).collect()}


def test_policy_by_role(people, policy):
    manager = seen(people, policy)
    assert set(manager) == {1} and manager[1].born is None and manager[1].card == "****-****-****-4444" and len(manager[1].mail) == 64
    analyst = seen(people, policy, "analysts")
    assert set(analyst) == {1, 2, 3} and (analyst[1].born, analyst[3].born) == (1980, 2000) and analyst[3].card == "****-****-****-5500"
    auditor = seen(people, policy, "auditors", "analysts", "unheard of")
    assert (auditor[1].born, auditor[1].card, auditor[1].mail) == (1987, "4111222233334444", "a@x")
    # The schema is the same for every viewer.
    schemas = {policy_view(people, "people", Viewer("m@x", frozenset(g)), policy, people.select(F.col("mail").alias("rm_email"), F.col("region").alias("assigned_region"))).schema.simpleString() for g in ((), ("analysts",), ("auditors",))}
    assert len(schemas) == 1


def test_policy_refuses(people, policy, spark):
    with pytest.raises(PermissionError):
        policy_view(people, "elsewhere", Viewer("m@x", frozenset({"auditors"})), policy)
    with pytest.raises(PermissionError):
        policy_view(people, "gold", Viewer("m@x"), policy)
    with pytest.raises(ValueError, match="unknown rule"):
        policy_view(people, "t", Viewer("m@x"), spark.createDataFrame([("*", "t", "born", "blur")], POLICY))
    with pytest.raises(ValueError, match="not there"):
        policy_view(people, "t", Viewer("m@x"), spark.createDataFrame([("*", "t", "salary", "hidden")], POLICY))
    with pytest.raises(ValueError, match="assignments"):
        policy_view(people, "people", Viewer("m@x"), policy)


def test_sql_functions_are_plain_expressions(spark, people):
    register_sql_functions(spark)
    got = spark.sql(
        """SELECT id, mask_birth_year(born, array('fraud_risk_analysts')) AS born, mask_birth_year(born, array('x')) AS year,
             mask_card_number(CAST(card AS STRING), array('x')) AS card FROM {people}""",
        people=people,
    )
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (1, 1980, 1987, "****-****-****-4444"), (2, None, None, None), (3, 2000, 2001, "****-****-****-5500")]


# --- layout ------------------------------------------------------------------------------------


def files_read(spark, path, name, low, high):
    spans = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min(name).alias("a"), F.max(name).alias("b"))
    return spans.filter((F.col("a") <= high) & (F.col("b") >= low)).count()


def test_interleaved_layout_skips_for_both_columns(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(1000), f"k{rng.randrange(1000):04d}", k) for k in range(20_000)]
    df = spark.createDataFrame(rows, "a int, b string, n int").repartition(4)
    write_interleaved(df, f"{tmp_path}/z", ["a", "b"], files=16)
    write_clustered(df, f"{tmp_path}/sorted", ["a", "b"], files=16)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/z").collect())) == sorted(rows)
    for name, low, high in (("a", 100, 149), ("b", "k0100", "k0149")):
        assert files_read(spark, f"{tmp_path}/z", name, low, high) <= 8
    assert files_read(spark, f"{tmp_path}/sorted", "b", "k0100", "k0149") == 16


def test_interleaved_layout_of_odd_columns(spark, tmp_path):
    rows = [(None, None, None), (1.5, datetime(2024, 1, 1), "é"), (float("nan"), None, ""), (-3.0, datetime(1960, 1, 1), None)] * 3
    df = spark.createDataFrame(rows, "a double, b timestamp, c string")
    for name, part in (("all", df), ("none", df.filter("false")), ("nulls", df.filter("a IS NULL"))):
        write_interleaved(part, f"{tmp_path}/{name}", ["a", "b", "c"], files=2, bits=4)
        assert spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}").count() == part.count()
    with pytest.raises(ValueError):
        curve_place(df, ["a", "b", "c"], bits=30)


def test_place_interleaves_range_numbers(spark):
    df = spark.range(16).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"))
    got = {(r.x, r.y): r.z for r in df.withColumn("z", curve_place(df, ["x", "y"], 2)).collect()}
    bits = lambda v: (v >> 1 & 1, v & 1)
    for (x, y), z in got.items():
        (x1, x0), (y1, y0) = bits(x), bits(y)
        assert z == x1 << 3 | y1 << 2 | x0 << 1 | y0


# --- counts that come with a write -------------------------------------------------------------


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    run()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_counts_take_no_job_of_their_own(spark, tmp_path):
    rows = [(k, None if k % 4 == 0 else "x", "{}" if k == 3 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "id int, name string, _rescued_data string").repartition(3)
    watched, counts = counting(df, "t", ["id", "name"])
    plain = jobs(spark, "plain", lambda: SnapshotTable(spark, f"{tmp_path}/a").publish(df, datetime(2024, 1, 1)))

    def counted():
        SnapshotTable(spark, f"{tmp_path}/b").publish(watched, datetime(2024, 1, 1))
        assert (counts.check(), counts.rows, counts.nulls, counts.rescued) == (100, 100, {"id": 0, "name": 25}, 1)

    assert jobs(spark, "counted", counted) == plain
    empty, none = counting(df.filter("false"), "empty")
    empty.write.parquet(f"{tmp_path}/empty")
    with pytest.raises(ValueError, match="empty has 0 rows"):
        none.check()


def test_type_drift(spark):
    df = spark.createDataFrame([], "a int, b string, d double, _rescued_data string")
    got = {r["column"]: (r.status, r.expected_type, r.found_type) for r in type_drift(df, {"a": "int", "b": "bigint", "c": "date"}).collect()}
    assert got == {"a": ("matched", "int", "int"), "b": ("retyped", "bigint", "string"), "c": ("missing", "date", None), "d": ("unexpected", None, "double")}


# --- third change class ------------------------------------------------------------------------

T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def test_refreshed_columns_of_a_merge(spark):
    schema = "id int, kind string, town string, score int"
    first = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "x", 1), (3, "a", "x", 1), (4, "a", "x", 1), (5, "a", "x", 1)], schema)
    then = spark.createDataFrame([(1, "a", "x", 2), (2, "b", "x", 2), (3, "a", "y", 2), (4, "a", "x", None), (6, "a", "x", 7)], schema)
    old = scd2_scd3_merge(None, first, ["id"], ["kind"], "town", T0)
    merged = scd2_scd3_merge(old, then, ["id"], ["kind"], "town", T1, scd1_cols=["score"])
    got = {(r.id, r.kind, r.town, r.previous_town, r.score, r.is_current) for r in merged.collect()}
    assert got == {
        (1, "a", "x", None, 2, True), (2, "a", "x", None, 1, False), (2, "b", "x", "x", 2, True),
        (3, "a", "y", "x", 2, True), (4, "a", "x", None, None, True), (5, "a", "x", None, 1, True), (6, "a", "x", None, 7, True)}
    # A closed row keeps what it had, whatever comes.
    again = scd2_scd3_merge(merged, then.withColumn("score", F.lit(9)), ["id"], ["kind"], "town", T1, scd1_cols=["score"])
    assert {r.score for r in again.filter("NOT is_current").collect()} == {1}
    with pytest.raises(ValueError, match="two kinds"):
        scd2_merge(None, first, ["id"], ["kind"], T0, scd1_cols=["kind"])
