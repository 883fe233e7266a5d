"""The registered queries: each applies one operator to its whole table and derives its digest."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.llm import (
    decontam,
    langid,
    licenses,
    lmscore,
    packing,
    pii,
    runs,
    sharding,
    simhash,
    spelling,
    sql,
    tiles,
    topk,
    toxicity,
)


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = Entry(run, sql)
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_sum_of_squares_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"), packing.vocabulary_file())
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").alias("offset")
    )


@query("op4_jump_hash_shards", sql.SHARDS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded_digest(table(spark, sf_dir, "documents"), shards=24)
    return placed.withColumn("law", F.lit("key"))


@query("op5_covering_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


@query("op3_pigeonhole_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_license_set_join", sql.LICENSES)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    base = F.array_distinct("places.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "labels")), ",").alias("labels"),
        "score",
    )


@query("op7_ftrl_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query("op9_deobfuscated_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.scores(docs, model).select(
        "doc_id",
        F.coalesce(langid.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op10_feistel_pseudonyms")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", pii.replaced_kinds("text").alias("kinds"))
    return pii.pseudonymized(docs).select(
        "doc_id", "text", F.size("kinds").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds")
    )


@query("op2_kd_tree_top_k", sql.TOP_K)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(spark, sf_dir, "embeddings"), scale=64.0)
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


@query("op8_cross_entropy_difference")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def misspelt(doc_id: int | None, run: str) -> str:
    """Leaves out a code point of every 97th run; a NULL id counts as an empty one."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % 97 == 0 else run


@query("op11_partenum_variants", sql.VARIANTS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), misspelt))


@query("op12_int8_tile_duplicates", sql.TILES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.linked(table(spark, sf_dir, "embeddings"), threshold=0.93)


def repeating(doc_id: int | None, words: list[str]) -> list[str]:
    """Makes every tenth document periodic from some word on; documents without an id stay as they are."""
    h, n = 0 if doc_id is None else zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeating, with_text=False)
    keys = F.transform(
        "runs",
        lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")),
    )
    best = found.withColumn("best", F.array_min(keys))
    length = -F.col("best.less")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
