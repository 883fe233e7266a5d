"""Rule fixtures and edge tables; brute force on random rows for the history operators."""

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from cardwatch.functions import haversine_km
from cardwatch.operators.rules import (
    apply_amount_rule,
    apply_card_rules,
    apply_geo_jump_rule,
    apply_spending_deviation_rule,
    apply_velocity_rule,
    score_all_rules,
)
from cardwatch.settings import RuleSettings

NOON = datetime(2024, 1, 1, 12, 0, 0)
NEW_YORK = (40.7128, -74.0060)
LOS_ANGELES = (34.0522, -118.2437)
GEO = "card_id string, date timestamp, merchant_latitude double, merchant_longitude double, id long"


def minutes(n):
    return NOON + timedelta(minutes=n)


def test_amount_is_strictly_above(spark):
    rows = spark.createDataFrame([(1, 2500.0), (2, 100.0), (3, 2000.01), (4, 2000.0), (5, None)], "id long, amount double")
    got = {r.id: r.flag_amount_threshold for r in apply_amount_rule(rows).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False, 5: None}


def test_velocity_counts_up(spark):
    rows = spark.createDataFrame([("c1", minutes(0)), ("c1", minutes(2)), ("c1", minutes(4))], ["card_id", "date"])
    got = apply_velocity_rule(rows).orderBy("date").collect()
    assert [r.txn_count_in_window for r in got] == [1, 2, 3]
    assert [r.flag_velocity for r in got] == [False, False, True]


def test_velocity_spread_out(spark):
    rows = spark.createDataFrame([("c1", minutes(0)), ("c1", minutes(10)), ("c1", minutes(20))], ["card_id", "date"])
    assert not any(r.flag_velocity for r in apply_velocity_rule(rows).collect())


@pytest.mark.parametrize(("gap", "count"), [(300, 2), (301, 1)])
def test_velocity_window_edge(spark, gap, count):
    rows = spark.createDataFrame([("c", NOON), ("c", NOON + timedelta(seconds=gap))], ["card_id", "date"])
    assert [r.txn_count_in_window for r in apply_velocity_rule(rows).orderBy("date").collect()] == [1, count]


def test_velocity_peers_and_null_keys(spark):
    rows = spark.createDataFrame(
        [(1, "c", NOON), (2, "c", NOON + timedelta(milliseconds=900)), (3, None, NOON), (4, None, NOON), (5, "null", NOON), (6, "c", None), (7, "c", None)],
        "id long, card_id string, date timestamp",
    )
    got = {r.id: r.txn_count_in_window for r in apply_velocity_rule(rows).collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 1, 6: 2, 7: 2}


def test_haversine(spark):
    row = spark.createDataFrame([(*NEW_YORK, *LOS_ANGELES)], ["a", "b", "c", "d"])
    km = row.select(haversine_km("a", "b", "c", "d").alias("km"), haversine_km("a", "b", "a", "b").alias("zero")).first()
    assert 3850 < km.km < 4000
    assert km.zero == 0.0
    unknown = row.select(haversine_km("a", "b", "c", F.lit(None).cast("double")).alias("km")).first()
    assert unknown.km is None


def test_geo_jump_impossible_and_nearby(spark):
    far = spark.createDataFrame([("c", NOON, *NEW_YORK, 1), ("c", minutes(5), *LOS_ANGELES, 2)], GEO)
    assert [r.flag_geo_jump for r in apply_geo_jump_rule(far).orderBy("date").collect()] == [False, True]
    near = spark.createDataFrame([("c", NOON, *NEW_YORK, 1), ("c", minutes(10), 40.73, -73.995, 2)], GEO)
    assert apply_geo_jump_rule(near).orderBy("date").collect()[1].flag_geo_jump is False


def test_geo_jump_unknown_places(spark):
    rows = [
        ("now", NOON, *NEW_YORK, 1), ("now", minutes(5), None, None, 2),
        ("before", NOON, None, None, 3), ("before", minutes(5), *NEW_YORK, 4),
        ("both", NOON, None, None, 5), ("both", minutes(5), None, None, 6),
        ("same", NOON, *NEW_YORK, 7), ("same", NOON, *LOS_ANGELES, 8),
        ("hides", NOON, *NEW_YORK, 9), ("hides", minutes(1), None, None, 10), ("hides", minutes(2), *LOS_ANGELES, 11),
    ]
    got = {r.id: r.flag_geo_jump for r in apply_geo_jump_rule(spark.createDataFrame(rows, GEO)).collect()}
    assert got == {1: False, 2: None, 3: False, 4: False, 5: False, 6: False, 7: False, 8: None, 9: False, 10: None, 11: False}


def test_geo_jump_looks_back_over_slices(spark):
    rows = [("c", NOON, *NEW_YORK, 1), ("c", NOON + timedelta(hours=3), *LOS_ANGELES, 2), ("c", NOON + timedelta(days=40), *NEW_YORK, 3)]
    got = apply_geo_jump_rule(spark.createDataFrame(rows, GEO)).orderBy("id").collect()
    assert [r.flag_geo_jump for r in got] == [False, True, False]
    assert got[1]._implied_speed_kmh == pytest.approx(3935.746 / 3, rel=1e-4)


def test_spending_deviation(spark):
    schema = "client_id string, date timestamp, amount double"

    def run(rows):
        return apply_spending_deviation_rule(spark.createDataFrame(rows, schema)).orderBy("date").collect()

    ago = lambda days: NOON - timedelta(days=days)
    got = run([("c", ago(10), 100.0), ("c", ago(5), 100.0), ("c", NOON, 500.0)])
    assert got[0].flag_spending_deviation is False and got[2].flag_spending_deviation is True
    assert got[2].trailing_30d_avg_amount == 100.0
    assert run([("c", ago(10), 100.0), ("c", ago(5), 120.0), ("c", NOON, 150.0)])[2].flag_spending_deviation is False
    # exactly three times is not above; exactly 30 days back still counts, a second more does not
    assert run([("c", ago(30), 100.0), ("c", NOON, 300.0)])[1].flag_spending_deviation is False
    assert run([("c", ago(30), 100.0), ("c", NOON, 300.5)])[1].flag_spending_deviation is True
    assert run([("c", ago(30) - timedelta(seconds=1), 100.0), ("c", NOON, 900.0)])[1].trailing_30d_avg_amount is None


@pytest.mark.parametrize("money", ["double", "decimal(12,2)"])
def test_rules_against_brute_force(spark, money):
    """Many rows on one hot card, a few on others; every window re-added row by row in Python."""
    rng = random.Random(7)
    settings = RuleSettings(velocity_window_seconds=60, deviation_window_days=1)
    rows = []
    for i in range(500):
        card = "hot" if rng.random() < 0.5 else f"c{rng.randrange(6)}"
        when = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(4 * 86400) if i % 3 else rng.randrange(900), milliseconds=rng.randrange(1000))
        if i % 50 == 0:
            when = None
        place = (None, None) if rng.random() < 0.3 else (rng.uniform(-60, 60), rng.uniform(-100, 100))
        amount = None if rng.random() < 0.1 else round(rng.uniform(0, 4000), 2)
        rows.append((i, card, f"p{card}", when, amount, *place))
    df = spark.createDataFrame(
        rows, "id long, card_id string, client_id string, date timestamp, amount double, merchant_latitude double, merchant_longitude double"
    )
    df = df.withColumn("amount", F.col("amount").cast(money))
    scored = score_all_rules(df, settings)
    assert scored.schema["trailing_30d_avg_amount"].dataType == df.select(F.avg("amount")).schema[0].dataType
    got = {r.id: r for r in scored.collect()}
    assert len(got) == len(rows)
    epoch = lambda moment: None if moment is None else int((moment - datetime(1970, 1, 1)).total_seconds() // 1)
    first = datetime(1, 1, 1)  # rows without a time come first
    for i, card, client, when, amount, lat, _ in rows:
        sec = epoch(when)

        def within(other, before, upto):
            if sec is None or epoch(other) is None:  # such rows are each other's only peers
                return sec == epoch(other)
            return sec - before <= epoch(other) <= sec - upto

        assert got[i].txn_count_in_window == sum(1 for r in rows if r[1] == card and within(r[3], 60, 0))
        spent = [r[4] for r in rows if r[2] == client and within(r[3], 86400, 1) and r[4] is not None]
        if not spent:
            assert got[i].trailing_30d_avg_amount is None
        elif money == "double":
            assert got[i].trailing_30d_avg_amount == pytest.approx(sum(spent) / len(spent), rel=1e-12)
        else:
            cents = sum(round(100 * x) for x in spent)
            exact = (Decimal(cents) / 100 / len(spent)).quantize(Decimal("1e-6"), ROUND_HALF_UP)
            assert got[i].trailing_30d_avg_amount == exact
        before = [r for r in rows if r[1] == card and (r[3] or first, r[0]) < (when or first, i)]
        prev = max(before, key=lambda r: (r[3] or first, r[0])) if before else None
        if prev is None or prev[5] is None:
            assert got[i].flag_geo_jump is False
        elif lat is None or epoch(prev[3]) in (sec, None):
            assert got[i].flag_geo_jump is None
        else:
            assert got[i].flag_geo_jump is (got[i]._implied_speed_kmh > 900)
        fired = [n for n in ("amount_threshold", "velocity", "geo_jump", "spending_deviation") if got[i][f"flag_{n}"]]
        assert got[i].risk_score == 25 * len(fired)
        assert got[i].risk_reason == (", ".join(fired) or None)
        assert got[i].fraud_flag is bool(fired)


def test_places_that_are_not_numbers_are_unknown(spark):
    nan = float("nan")
    rows = [("a", NOON, nan, nan, 1), ("a", minutes(5), *NEW_YORK, 2), ("b", NOON, *NEW_YORK, 3), ("b", minutes(5), nan, 5.0, 4)]
    got = {r.id: (r.flag_geo_jump, r._implied_speed_kmh) for r in apply_geo_jump_rule(spark.createDataFrame(rows, GEO)).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (False, None), 4: (None, None)}


def test_rules_run_no_job_while_they_are_built(spark):
    group = "building rules"
    spark.sparkContext.setJobGroup(group, group)
    df = spark.createDataFrame([("c", "p", NOON, 1.0, *NEW_YORK, 1)], "card_id string, client_id string, date timestamp, amount double, merchant_latitude double, merchant_longitude double, id long")
    score_all_rules(df)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(group) == []


@pytest.mark.parametrize("ignore", [False, True])
@pytest.mark.parametrize("lookback", [None, 3600])
def test_place_before_over_days_against_brute_force(spark, ignore, lookback):
    """Cards that pause for days, rows without places or times, several rows a second."""
    rng = random.Random(11)
    settings = RuleSettings(geo_ignore_unknown_places=ignore, geo_lookback_seconds=lookback)
    rows = []
    for i in range(400):
        card = "hot" if rng.random() < 0.4 else f"c{rng.randrange(12)}"
        when = datetime(2024, 1, 1) + timedelta(days=rng.choice([0, 0, 1, 4, 40]), seconds=rng.randrange(9000), milliseconds=rng.randrange(2) * 500)
        place = rng.choice([(None, None), (5.0, None), (rng.uniform(-60, 60), rng.uniform(-100, 100)), (rng.uniform(-60, 60), float("nan"))])
        rows.append((card, None if i % 40 == 0 else when, *place, i))
    got = {r.id: r for r in apply_geo_jump_rule(spark.createDataFrame(rows, GEO), settings=settings).collect()}
    assert len(got) == len(rows)
    known = lambda x: x is not None and x == x
    second = lambda moment: None if moment is None else moment.replace(microsecond=0)
    order = lambda r: (r[1] or datetime.min, r[4])
    for card, when, lat, lon, i in rows:
        before = [r for r in rows if r[0] == card and order(r) < (when or datetime.min, i)]
        if ignore:
            before = [r for r in before if known(r[2]) and known(r[3])]
        prev = max(before, key=order, default=None)
        if prev and lookback and when and prev[1] and (second(when) - second(prev[1])).total_seconds() > lookback:
            prev = None
        if prev is None or not known(prev[2]):
            assert got[i].flag_geo_jump is False, i
        elif not (known(lat) and known(lon) and known(prev[3])) or None in (when, prev[1]) or second(prev[1]) >= second(when):
            assert got[i].flag_geo_jump is None, i
        else:
            km = spark_free_km(prev[2], prev[3], lat, lon)
            speed = km / ((second(when) - second(prev[1])).total_seconds() / 3600)
            assert got[i]._implied_speed_kmh == pytest.approx(speed)
            assert got[i].flag_geo_jump is (speed > 900)


def spark_free_km(*degrees):
    from math import asin, cos, radians, sin, sqrt

    a, b, c, d = map(radians, degrees)
    return 2 * 6371.0 * asin(sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2))


def test_card_rules_take_two_shuffles_and_no_join(spark):
    df = spark.createDataFrame([("c", NOON, *NEW_YORK, 1)], GEO)
    for rule, shuffles in ((apply_velocity_rule, 1), (apply_geo_jump_rule, 2), (apply_card_rules, 2)):
        plan = rule(df)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == shuffles and "Join" not in plan
