"""From delivered files to rollups, twice."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cardwatch.plans.refresh import Lake, last_delivered, refresh_bronze, refresh_dimensions, refresh_facts, refresh_gold, refresh_streaming
from cardwatch.sources import schemas
from cardwatch.streaming import LANDING_SCHEMA

DAY1, DAY2, DAY3 = datetime(2024, 2, 1), datetime(2024, 2, 2), datetime(2024, 2, 3)


def deliver(folder, name, columns, rows):
    folder.mkdir(parents=True, exist_ok=True)
    quote = lambda v: f'"{v}"' if "," in str(v) else str(v)
    (folder / name).write_text("\n".join([",".join(columns)] + [",".join(map(quote, row)) for row in rows]) + "\n")


def customer(key, income, address="A St"):
    return (key, 50, 65, 1974, 5, "Female", address, 40.0, -74.0, "$20,000", income, "$1,000", 700, 2)


def txn(key, when, amount, merchant, zip_code, mcc="5411"):
    return (key, when, "c1", "k1", amount, "Chip Transaction", merchant, "X", "NY", zip_code, mcc)


def test_two_days(spark, tmp_path):
    inbox = tmp_path / "in"
    lake = Lake(spark, str(inbox), str(tmp_path / "lake"))
    (inbox / "reference").mkdir(parents=True)
    (inbox / "mcc_codes.json").write_text(json.dumps({"5411": "Grocery"}))
    (inbox / "reference" / "zip_centroids.csv").write_text("zip_code,latitude,longitude\n501,40.7,-74.0\n90001,34.0,-118.2\n")
    deliver(inbox / "customers", "1.csv", schemas.CUSTOMER_COLUMNS, [customer("c1", "$29,000.00")])
    deliver(inbox / "cards", "1.csv", schemas.CARD_COLUMNS, [("k1", "c1", "Visa", "Debit", 4344676511950444, "12/2027", 623, "YES", "$24,295", "09/2002", 2008, "No")])
    deliver(inbox / "transactions", "1.csv", schemas.TRANSACTION_COLUMNS, [
        txn("t1", "2024-01-01 10:00:00", "$10.00", "m1", "501.0"), txn("t2", "2024-01-01 10:05:00", "$2,500.00", "m2", "90001.0", "9")])
    refresh_bronze(lake)
    refresh_dimensions(lake, DAY1)
    orphans = refresh_facts(lake, DAY1)
    assert {r.label: r.violations for r in orphans.collect()} == {"transactions (card_id)": 0, "transactions (client_id)": 0, "transactions (merchant_id)": 0}
    refresh_gold(lake, DAY1)
    assert {r.id: r.risk_reason for r in lake.silver("fraud_risk").collect()} == {"t1": None, "t2": "amount_threshold, geo_jump, spending_deviation"}
    assert lake.table("gold", "investigation_queue").read().count() == 1

    # the next day: a raise, a new transaction, and the stream comes up
    deliver(inbox / "customers", "2.csv", schemas.CUSTOMER_COLUMNS, [customer("c1", "$90,000.00")])
    deliver(inbox / "transactions", "2.csv", schemas.TRANSACTION_COLUMNS, [txn("t3", "2024-01-03 10:00:00", "$12.00", "m1", "501.0")])
    spark.createDataFrame([("s1", datetime(2024, 1, 4, 9), "c1", "k1", 9000.0, "online", "m1")], LANDING_SCHEMA).write.parquet(lake.landing)
    refresh_bronze(lake)
    refresh_dimensions(lake, DAY2)
    refresh_facts(lake, DAY2)
    refresh_streaming(lake, DAY2, state_partitions=2)
    refresh_gold(lake, DAY2)
    profile = lake.table("gold", "customer_risk_profile").read().first()
    assert (profile.total_transactions, profile.source, profile.income_tier) == (4, ["batch", "streaming"], "high")
    assert lake.table("gold", "daily_fraud_summary").read().filter(F.col("source") == "streaming").first().flagged_amount == 9000.0
    assert lake.table("gold", "daily_fraud_summary").history().count() == 2
    assert {(r.income_tier, r.effective_end, r.is_current) for r in lake.silver("customers").collect()} == {("low", DAY2, False), ("high", None, True)}
    assert {(r.txn_year, r.txn_month) for r in lake.silver("transactions").collect()} == {(2024, 1)}
    spend = {(r.mcc_description, r.source): r.total_amount for r in lake.table("gold", "merchant_category_spend").read().collect()}
    assert spend == {("Grocery", "batch"): 22.0, (None, "batch"): 2500.0, ("Grocery", "streaming"): 9000.0}

    # closed rows stay where they are: a further run writes current rows only
    history = lake.dimension("customers")
    closed = [str(f) for f in (tmp_path / "lake" / "silver" / "customers").rglob("is_current=false/*.parquet")]
    refresh_dimensions(lake, DAY3)
    assert [str(f) for f in (tmp_path / "lake" / "silver" / "customers").rglob("is_current=false/*.parquet")] == closed
    assert lake.silver("customers").count() == 2 and history.read(version=0).count() == 1
    assert {r.income_tier for r in history.read(timestamp=DAY1).collect()} == {"low"}
    assert history.remove_expired(DAY3 + timedelta(days=30)) == [0, 1]
    assert {(r.income_tier, r.is_current) for r in history.read().collect()} == {("low", False), ("high", True)}


def reference_files(inbox):
    (inbox / "reference").mkdir(parents=True)
    (inbox / "mcc_codes.json").write_text(json.dumps({"5411": "Grocery"}))
    (inbox / "reference" / "zip_centroids.csv").write_text("zip_code,latitude,longitude\n501,40.7,-74.0\n90001,34.0,-118.2\n")
    deliver(inbox / "customers", "1.csv", schemas.CUSTOMER_COLUMNS, [customer("c1", "$29,000.00")])
    deliver(inbox / "cards", "1.csv", schemas.CARD_COLUMNS, [("k1", "c1", "Visa", "Debit", 4344676511950444, "12/2027", 623, "YES", "$24,295", "09/2002", 2008, "No")])


def month_files(root, table, month):
    return {str(f): os.stat(f).st_mtime_ns for f in root.rglob(f"silver/{table}/data/version=*/txn_year=2024/txn_month={month}/*.parquet")}


def test_only_touched_months_are_written(spark, tmp_path):
    """Later deliveries: a late row in March, then rows of May and one without a date."""
    rng = random.Random(6)
    stamp = lambda month: f"2024-{month:02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:00"

    def some(n, month, tag):
        return [
            (f"{tag}{k}", stamp(month), rng.choice(["c1", "c2"]), rng.choice(["k1", "k2", "k3"]), f"${rng.randint(1, 40) * 100}.00", "Chip Transaction",
             f"m{rng.randint(1, 3)}", "X", "NY", rng.choice(["501.0", "90001.0", ""]), "5411")
            for k in range(n)
        ]

    days = [some(25, 1, "a") + some(25, 2, "b") + some(6, 3, "c") + some(20, 4, "d"), some(3, 3, "late"), some(20, 5, "e"), [txn("none", "", "$5.00", "m1", "501.0")]]
    inbox = tmp_path / "in"
    reference_files(inbox)
    lake = Lake(spark, str(inbox), str(tmp_path / "lake"))
    columns = ["id", "fraud_flag", "risk_score", "risk_reason", "amount", "merchant_id", "date"]
    for n, rows in enumerate(days):
        before = {(t, m): month_files(tmp_path / "lake", t, m) for t in ("transactions", "fraud_risk") for m in range(1, 5)}
        deliver(inbox / "transactions", f"{n}.csv", schemas.TRANSACTION_COLUMNS, rows)
        refresh_bronze(lake)
        if n == 0:
            refresh_dimensions(lake, DAY1)
        refresh_facts(lake, DAY1 + timedelta(days=n))
        anew = {key for key, files in before.items() if month_files(tmp_path / "lake", *key) != files}
        scored = {("fraud_risk", m) for m in range(1, 5)}
        assert anew == [
            {(t, m) for t in ("transactions", "fraud_risk") for m in range(1, 5)},
            {("transactions", 3), ("fraud_risk", 3), ("fraud_risk", 4)},
            set(),
            scored,
        ][n]
        assert lake.silver("transactions").count() == sum(map(len, days[: n + 1]))
        if n not in (1, 3):
            continue
        got = sorted(map(repr, lake.silver("fraud_risk").select(*columns).collect()))
        other = Lake(spark, str(inbox), str(tmp_path / f"whole{n}"))
        refresh_bronze(other)
        refresh_dimensions(other, DAY1)
        refresh_facts(other, DAY1, rebuild=True)
        assert got == sorted(map(repr, other.silver("fraud_risk").select(*columns).collect()))
    # Earlier versions stay readable, and removing them keeps what later ones share.
    risk = lake.fact("fraud_risk")
    assert [risk.read(version=v).count() for v in range(4)] == [76, 79, 99, 100]
    refresh_facts(lake, DAY1 + timedelta(days=9))
    assert risk.history().count() == 4
    facts = lake.fact("transactions")
    facts.remove_expired(DAY1 + timedelta(days=60))
    assert facts.read().count() == 100 and facts.read(version=3).count() == 100


def test_several_files_of_one_run(spark, tmp_path):
    """A backlog with two deliveries: the later file counts, whatever its name."""
    inbox = tmp_path / "in"
    reference_files(inbox)
    deliver(inbox / "customers", "0.csv", schemas.CUSTOMER_COLUMNS, [customer("c1", "$90,000.00"), customer("c2", "$1.00")])
    os.utime(inbox / "customers" / "1.csv", (1_700_000_000, 1_700_000_000))
    deliver(inbox / "transactions", "1.csv", schemas.TRANSACTION_COLUMNS, [txn("t1", "2024-01-01 10:00:00", "$10.00", "m1", "501.0")])
    lake = Lake(spark, str(inbox), str(tmp_path / "lake"))
    refresh_bronze(lake)
    refresh_dimensions(lake, DAY1)
    assert {(r.id, r.income_tier) for r in lake.silver("customers").collect()} == {("c1", "high"), ("c2", "low")}
    # A NULL key is not lost on the way to the merge.
    deliver(inbox / "customers", "3.csv", schemas.CUSTOMER_COLUMNS, [customer("", "$90,000.00")])
    refresh_bronze(lake)
    assert last_delivered(lake.bronze("customers"), ["id"]).filter("id IS NULL").count() == 1
    with pytest.raises(Exception, match="NULL merge key"):
        refresh_dimensions(lake, DAY2)
