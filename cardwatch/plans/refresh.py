"""One pass over all layers: raw files to conformed tables to rollups.

Every table is written once and read back by whatever needs it next, so no step repeats another's
work and a lost executor costs one step at most. A table's new version is computed from its last one
and published beside it.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.operators import check_missing_geo, check_orphan_keys, counting
from cardwatch.operators.rules import score_all_rules
from cardwatch.operators.scd import scd1_upsert, scd2_merge, scd2_scd3_merge
from cardwatch.plans import gold, silver
from cardwatch.settings import DEFAULTS, RuleSettings
from cardwatch.sources import (
    DimensionTable,
    MonthTable,
    SnapshotTable,
    ingest_csv_folder,
    ingest_metrics,
    read_json_map,
    read_raw,
    read_zip_centroids,
    schemas,
)
from cardwatch.sources.months import Month, in_months, months_of
from cardwatch.sources.paths import has_files
from cardwatch.sources.sinks import with_month
from cardwatch.streaming import LANDING_SCHEMA, read_landing, run_available, score_stream, unscored_flags

log = logging.getLogger(__name__)

RAW_SOURCES = {
    "customers": (schemas.CUSTOMER_HINTS, schemas.CUSTOMER_COLUMNS),
    "cards": (schemas.CARD_HINTS, schemas.CARD_COLUMNS),
    "transactions": (schemas.TRANSACTION_HINTS, schemas.TRANSACTION_COLUMNS),
}

# Dimensions that keep the history of their rows.
DIMENSIONS = ("customers", "cards")
# Facts whose months are replaced one by one.
FACTS = ("transactions", "fraud_risk", "card_last_rows")


@dataclass(frozen=True)
class Lake:
    """Where things are: ``inbox`` with the delivered files, ``root`` with everything made of them."""

    spark: SparkSession
    inbox: str
    root: str

    def table(self, layer: str, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/{layer}/{name}")

    def bronze(self, name: str, after_batch: int | None = None) -> DataFrame:
        return read_raw(self.spark, f"{self.root}/bronze/{name}", f"{self.root}/state/{name}", after_batch)

    def silver(self, name: str) -> DataFrame:
        kinds = dict.fromkeys(DIMENSIONS, self.dimension) | dict.fromkeys(FACTS, self.fact)
        return kinds[name](name).read() if name in kinds else self.table("silver", name).read()

    def fact(self, name: str) -> MonthTable:
        return MonthTable(self.spark, f"{self.root}/silver/{name}")

    def dimension(self, name: str) -> DimensionTable:
        return DimensionTable(self.spark, f"{self.root}/silver/{name}")

    @property
    def landing(self) -> str:
        return f"{self.inbox}/stream"

    @property
    def risk_streaming(self) -> str:
        return f"{self.root}/silver/fraud_risk_streaming"


def refresh_bronze(lake: Lake) -> None:
    """Take in what is new of the three sources. An empty table stops the run.

    Rows and rescued values were counted by the writes of the ingest; no table is read again for it.
    """
    for name, (hints, columns) in RAW_SOURCES.items():
        state = f"{lake.root}/state/{name}"
        ingest_csv_folder(
            lake.spark,
            f"{lake.inbox}/{name}",
            f"{lake.root}/bronze/{name}",
            state,
            f"bronze_{name}",
            hints,
            columns,
        )
        rows, rescued = ingest_metrics(lake.spark, state).agg(F.sum("rows"), F.sum("rescued")).first()
        if not rows:
            raise ValueError(f"raw {name} has no rows")
        log.info("raw %s: %d rows", name, rows)
        if rescued:
            log.warning("raw %s: %d rows have rescued values", name, rescued)


def last_delivered(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of each key's last delivery: of the newest file that has the key, however many files one
    run took in. Several rows of a key in one file stay, and so do NULL keys, for the merge to reject."""
    delivery = F.struct("_ingested_at", "_source_time", "_source_file")
    newest = raw.groupBy(*keys).agg(F.max(delivery).alias("_newest")).select(
        *[F.col(key).alias(f"_of_{key}") for key in keys], "_newest"
    )
    same = reduce(and_, [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys])
    return raw.join(newest, same & delivery.eqNullSafe(F.col("_newest")), "left_semi").select(*raw.columns)


def publish_counted(table: SnapshotTable, df: DataFrame, label: str, at: datetime) -> None:
    """Publish, and check by what the write itself counted: rows, and NULLs by column."""
    watched, counts = counting(df, label, df.columns)
    table.publish(watched, at)
    counts.check()


def refresh_dimensions(lake: Lake, at: datetime) -> None:
    spark = lake.spark

    def publish(name: str, merge) -> None:
        table = lake.table("silver", name)
        publish_counted(table, merge(table.read_if_any()), name, at)

    def publish_dimension(name: str, merge) -> None:
        """Merge with the current rows only: closed rows stay in the files where they are."""
        table = lake.dimension(name)
        publish_counted(table, merge(table.current()), name, at)

    customers = silver.customers(last_delivered(lake.bronze("customers"), ["id"]))
    publish_dimension("customers", lambda old: scd2_scd3_merge(old, customers, ["id"], ["income_tier"], "address", at))
    cards = silver.cards(last_delivered(lake.bronze("cards"), ["id"]))
    tracked = ["card_type", "has_chip", "credit_limit"]
    publish_dimension("cards", lambda old: scd2_merge(old, cards, ["id"], tracked, at))
    categories = read_json_map(spark, f"{lake.inbox}/mcc_codes.json")
    merchants = silver.merchants(lake.bronze("transactions"), categories)
    publish("merchants", lambda old: scd1_upsert(old, merchants, ["id"]))
    centroids = read_zip_centroids(spark, f"{lake.inbox}/reference/zip_centroids.csv")
    publish("merchant_geo_reference", lambda old: scd1_upsert(old, centroids, ["zip"]))
    check_orphan_keys(lake.silver("cards"), "client_id", lake.silver("customers"), "id", "cards")


def refresh_facts(
    lake: Lake, at: datetime, settings: RuleSettings = DEFAULTS, rebuild: bool = False
) -> DataFrame:
    """The transaction fact by month, its scores and the spending reference; returns the checks.

    Only months that new rows fall into are written, and only those and later ones are scored again, over
    the months before that the rules look back to. What a card did before them comes from the stored last
    rows of each month. All other months stay in the files where they are. ``rebuild`` does everything anew,
    as after a change of ``settings`` or of the postal codes.
    """
    facts = lake.fact("transactions")
    # Kept with the scores, which are written last: what a failed run left undone counts as new.
    done = None if rebuild else lake.fact("fraud_risk").mark()
    taken_in = ingest_metrics(lake.spark, f"{lake.root}/state/transactions").agg(F.max("batch")).first()[0]
    fresh = _fact_rows(lake.bronze("transactions", None if done is None else int(done)))
    touched = months_of(fresh)
    if touched:
        # From the raw rows and not by adding to the stored month: a run repeated after a failure does no harm.
        rows = fresh if done is None else _fact_rows(lake.bronze("transactions")).filter(in_months(touched))
        facts.publish_months(rows.repartitionByRange("date"), touched, at)
        last_rows = lake.fact("card_last_rows")
        changed = facts.read().filter(in_months(touched))
        last_rows.publish_months(_last_rows(changed), touched, at)
        _rescore(lake, None if done is None else touched, at, settings, str(taken_in))
    written = facts.read()
    lake.table("silver", "customer_spending_reference").publish(silver.spending_reference(written), at)
    return silver.fact_orphans(
        written, lake.silver("cards"), lake.silver("customers"), lake.silver("merchants")
    )


def _fact_rows(raw: DataFrame) -> DataFrame:
    return with_month(silver.transactions(raw).drop("mcc"))


def _last_rows(fact: DataFrame) -> DataFrame:
    """Each card's last row of each month."""
    rows = F.struct(*fact.columns)
    latest = fact.groupBy("card_id", "txn_year", "txn_month").agg(F.max_by(rows, F.struct("date", "id")).alias("_row"))
    return latest.select("_row.*")


def _rescore(lake: Lake, touched: list[Month] | None, at: datetime, settings: RuleSettings, mark: str) -> None:
    """Scores from the first touched month on; of all months if that cannot be told."""
    written, facts = lake.silver("transactions"), lake.fact("fraud_risk")
    every = months_of(written)
    # Rows without a date come before all others; and whose place is skipped, no stored last row tells.
    whole = touched is None or None in touched or settings.geo_ignore_unknown_places
    months = every if whole else [month for month in every if month and month >= touched[0]]
    rows = written
    if not whole:
        window = max(settings.deviation_window_seconds, settings.velocity_window_seconds)
        start = datetime(*touched[0], 1) - timedelta(seconds=window)
        since = F.col("txn_year") * 100 + F.col("txn_month") >= start.year * 100 + start.month
        earlier = lake.silver("card_last_rows").filter(~F.coalesce(since, F.lit(False)))
        rows = written.filter(since).unionByName(_last_of_all(earlier))
    placed = silver.with_places(rows, lake.silver("merchant_geo_reference"))
    risk = with_month(silver.with_details(score_all_rules(placed, settings), at)).filter(in_months(months))
    watched, counts = counting(risk, "fraud_risk", risk.columns)
    facts.publish_months(watched, months, at, mark)
    counts.check()
    check_missing_geo(placed.filter(in_months(months)))


def _last_of_all(last_rows: DataFrame) -> DataFrame:
    """Each card's last row, whatever the month."""
    latest = last_rows.groupBy("card_id").agg(F.max_by(F.struct(*last_rows.columns), F.struct("date", "id")).alias("_row"))
    return latest.select("_row.*")


def refresh_streaming(
    lake: Lake,
    at: datetime | None = None,
    settings: RuleSettings = DEFAULTS,
    state_partitions: int | None = None,
    timeout_seconds: float | None = None,
) -> None:
    """Score the landing rows that are new since the last run; flagged rows without a score stop it."""
    scored = score_stream(
        read_landing(lake.spark, lake.landing),
        lake.silver("merchants"),
        lake.silver("merchant_geo_reference"),
        lake.silver("customer_spending_reference"),
        settings,
        scored_at=at,
    )
    run_available(
        scored,
        lake.risk_streaming,
        f"{lake.root}/state/fraud_risk_streaming",
        timeout_seconds=timeout_seconds,
        state_partitions=state_partitions,
    )
    if has_files(lake.spark, lake.risk_streaming):
        unscored = unscored_flags(lake.spark.read.parquet(lake.risk_streaming)).count()
        if unscored:
            raise ValueError(f"{unscored} flagged rows of the streaming leg have no score")


def refresh_gold(lake: Lake, at: datetime) -> None:
    streaming = landing = None
    if has_files(lake.spark, lake.risk_streaming):
        streaming = lake.spark.read.parquet(lake.risk_streaming)
        landing = lake.spark.read.schema(LANDING_SCHEMA).parquet(lake.landing)
    # The batch leg was stored with its details: no join back to the fact.
    unified = gold.unified_risk(lake.silver("fraud_risk"), None, streaming, landing)
    publish_counted(lake.table("silver", "unified_risk"), unified, "unified_risk", at)
    fraud = lake.silver("unified_risk")
    rollups = {
        "daily_fraud_summary": gold.daily_fraud_summary(fraud),
        "customer_risk_profile": gold.customer_risk_profile(fraud, lake.silver("customers")),
        "merchant_category_spend": gold.merchant_category_spend(fraud, lake.silver("merchants")),
        "investigation_queue": gold.investigation_queue(fraud),
    }
    for name, rollup in rollups.items():
        publish_counted(lake.table("gold", name), rollup, f"gold {name}", at)
