"""The stream against the batch rules on the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardwatch.operators.rules import apply_geo_jump_rule, apply_velocity_rule
from cardwatch.settings import RuleSettings
from cardwatch.streaming import delivered_once, read_landing, run_available, score_card_state, score_stream, unscored_flags

COLUMNS = "id long, date timestamp, card_id string, merchant_latitude double, merchant_longitude double"
SETTINGS = RuleSettings(velocity_window_seconds=600)


def rows_in_order(count=600, seed=3):
    rng = random.Random(seed)
    moment = datetime(2024, 1, 1)
    rows = []
    for i in range(count):
        moment += timedelta(seconds=rng.randrange(1, 90), milliseconds=rng.randrange(900))
        place = (None, None) if rng.random() < 0.3 else (rng.uniform(-50, 50), rng.uniform(-100, 100))
        rows.append((i, moment, "hot" if rng.random() < 0.4 else f"c{rng.randrange(20)}", *place))
    # whole seconds and fractions of one second within a card
    rows += [(count + k, moment + timedelta(seconds=60, milliseconds=100 * k), "hot", 10.0 * k, 5.0) for k in range(4)]
    return rows


def play(spark, tmp_path, chunks, settings=SETTINGS, **more):
    for chunk in chunks:
        spark.createDataFrame(chunk, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        stream = read_landing(spark, str(tmp_path / "landing"), COLUMNS)
        run_available(score_card_state(stream, settings, **more), str(tmp_path / "out"), str(tmp_path / "ckpt"), 300, state_partitions=2)
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("idle_seconds", [None, 7200])
def test_stream_equals_batch_over_restarts(spark, tmp_path, idle_seconds):
    rows = rows_in_order()
    third = len(rows) // 3
    got = play(spark, tmp_path, [rows[:third], rows[third : 2 * third], rows[2 * third :], rows[:0]], idle_seconds=idle_seconds)
    batch = apply_geo_jump_rule(apply_velocity_rule(spark.createDataFrame(rows, COLUMNS), settings=SETTINGS), settings=SETTINGS)
    columns = ["id", "flag_velocity", "flag_geo_jump"]
    want = {r.id: r for r in batch.select(*columns).collect()}
    have = {r.id: r for r in got.select(*columns).collect()}
    assert got.count() == len(rows)
    assert have == want
    seen = {(r.flag_velocity, r.flag_geo_jump) for r in have.values()}
    assert {flag for flag, _ in seen} == {True, False} and {flag for _, flag in seen} == {True, False, None}


@pytest.mark.parametrize("ignore", [False, True])
@pytest.mark.parametrize("lookback", [None, 300])
def test_stream_equals_batch_with_options(spark, tmp_path, ignore, lookback):
    settings = RuleSettings(velocity_window_seconds=600, geo_ignore_unknown_places=ignore, geo_lookback_seconds=lookback)
    rows = rows_in_order(300, seed=5)
    # A card whose place is not known for a whole run, and one with half a place.
    rows += [(900 + k, rows[-1][1] + timedelta(seconds=5 + k), "dark", None, None) for k in range(3)]
    rows += [(910, rows[-1][1] + timedelta(seconds=50), "dark", 5.0, None), (911, rows[-1][1] + timedelta(seconds=90), "dark", 5.0, 9.0)]
    rows += [(912, rows[-1][1] + timedelta(seconds=200), "dark", 50.0, 9.0)]
    got = play(spark, tmp_path, [rows[:150], rows[150:302], rows[302:306], rows[306:]], settings)
    batch = apply_geo_jump_rule(apply_velocity_rule(spark.createDataFrame(rows, COLUMNS), settings=settings), settings=settings)
    columns = ["id", "flag_velocity", "flag_geo_jump"]
    assert {r.id: r for r in got.select(*columns).collect()} == {r.id: r for r in batch.select(*columns).collect()}


def test_rows_landing_twice_count_once(spark, tmp_path):
    noon = datetime(2024, 1, 1, 12)
    rows = [(k, noon + timedelta(minutes=k), "c", 1.0, 1.0) for k in range(4)] + [(9, None, "c", 1.0, 1.0)]
    runs = [rows + rows[1:3], rows[:3] + [(7, noon + timedelta(hours=3), "c", 1.0, 1.0)], [rows[3], (8, noon + timedelta(hours=4), "c", 1.0, 1.0)]]
    for chunk in runs:
        spark.createDataFrame(chunk, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        once = delivered_once(read_landing(spark, str(tmp_path / "landing"), COLUMNS), "6 hours")
        assert once.schema.names == [c.split()[0] for c in COLUMNS.split(", ")]
        run_available(once, str(tmp_path / "out"), str(tmp_path / "ckpt"), 300, state_partitions=2)
    got = sorted((r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [0, 1, 2, 3, 7, 8, 9]
    # By now the watermark has passed the first rows: what is behind it is too late.
    spark.createDataFrame([(20, noon + timedelta(days=2), "c", 1.0, 1.0)], COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    spark.createDataFrame([(21, noon, "c", 1.0, 1.0)], COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    for folder in ("landing", "landing"):
        once = delivered_once(read_landing(spark, str(tmp_path / folder), COLUMNS), "6 hours")
        run_available(once, str(tmp_path / "out"), str(tmp_path / "ckpt"), 300, state_partitions=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_late_rows_are_judged_by_what_is_kept(spark, tmp_path):
    noon = datetime(2024, 1, 1, 12)
    first = [(1, noon, "c", 10.0, 10.0), (2, noon + timedelta(minutes=5), "c", 10.0, 10.0)]
    late = [(3, noon + timedelta(minutes=1), "c", -40.0, 90.0), (4, noon + timedelta(minutes=6), "c", 10.0, 10.0)]
    got = {r.id: r for r in play(spark, tmp_path, [first, late]).collect()}
    # row 3 sees row 1 and itself; its predecessor's place is no longer known
    assert (got[3].flag_velocity, got[3].flag_geo_jump) == (False, None)
    # row 4 follows row 2, not the late row; all four rows are in its window
    assert (got[4].flag_velocity, got[4].flag_geo_jump) == (True, False)


def test_scored_stream(spark, tmp_path):
    landing = "id string, date timestamp, client_id string, card_id string, amount double, channel string, merchant_id string"
    noon = datetime(2024, 1, 1, 12)
    rows = [("a1", noon, "p", "k1", 2500.0, "online", "m9")]
    rows += [(f"v{n}", noon + timedelta(seconds=30 * n), "q", "k2", 45.0, "chip", "m1") for n in range(3)]
    rows += [("g1", noon, "r", "k3", 60.0, "chip", "m1"), ("g2", noon + timedelta(minutes=5), "r", "k3", 60.0, "chip", "m2")]
    rows += [("d1", noon, "s", "k4", 5000.0, "online", None)]
    spark.createDataFrame(rows, landing).write.parquet(str(tmp_path / "landing"))
    merchants = spark.createDataFrame([("m1", "00001"), ("m2", "00002")], "id string, merchant_zip string")
    geo = spark.createDataFrame([("00001", 40.7, -74.0), ("00002", 34.0, -118.2)], "zip string, latitude double, longitude double")
    spending = spark.createDataFrame([("s", 100.0), ("q", 50.0)], "client_id string, avg_amount_30d double")
    risk = score_stream(read_landing(spark, str(tmp_path / "landing")), merchants, geo, spending)
    run_available(risk, str(tmp_path / "out"), str(tmp_path / "ckpt"), 300, state_partitions=2)
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r.id: (r.risk_reason, r.risk_score, r.fraud_flag) for r in out.collect()}
    quiet = (None, 0, False)
    assert got == {
        "a1": ("amount_threshold", 25, True), "v0": quiet, "v1": quiet, "v2": ("velocity", 25, True),
        "g1": quiet, "g2": ("geo_jump", 25, True), "d1": ("amount_threshold, spending_deviation", 50, True),
    }
    assert unscored_flags(out).count() == 0
    assert out.filter(F.col("scored_at").isNull()).count() == 0


def test_a_run_that_takes_too_long_is_stopped(spark, tmp_path):
    spark.createDataFrame(rows_in_order(20), COLUMNS).write.parquet(str(tmp_path / "landing"))
    stream = score_card_state(read_landing(spark, str(tmp_path / "landing"), COLUMNS), SETTINGS)
    with pytest.raises(TimeoutError):
        run_available(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), timeout_seconds=0.2, state_partitions=2)
    assert not spark.streams.active
