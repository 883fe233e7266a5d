"""Sharding by jump consistent hashing, in DataFrame expressions only.

A stable 64-bit key decides the shard: a linear congruential sequence started at the key tells at
which shard counts the key would move, and the last such count below the present one is its shard.
No ring table is kept, and one more shard takes rows from all others without any moving between them.

Rows are numbered within their shard without one task seeing a whole shard: rows that agree in
everything are one row with a count, each shard is cut into buckets by the sequence's first number and
the text's checksum, and a bucket starts after the rows of the buckets before it.

Edge cases: a NULL key is taken as key -1; a NULL text has no bytes and the checksum of no bytes;
repeated rows each get a slot; an empty table gives no rows; other columns are ignored by
``sharded_digest`` and kept by ``with_shard``, which replaces a column of the name it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardwatch.llm.common import written

#: Multiplier of the sequence, and the range of the numbers drawn from it.
MULTIPLIER = 2862933555777941757
DRAWS = 2.0**31

LOW_16, LOW_32 = (1 << 16) - 1, (1 << 32) - 1
#: Rows that one window group numbers, about.
BUCKET_ROWS = 50_000


def with_shard(df: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """Adds the shard of each row; no shuffle. Keys that are not integers are hashed first."""
    return df.withColumn(name, jump_shard(stable_key(df, key), shards))


def stable_key(df: DataFrame, key: str) -> Column:
    whole = dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(key).cast("long") if whole else F.xxhash64(key), F.lit(-1).cast("long"))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard from 0 to ``shards - 1`` for a key of type long."""
    start = F.struct(
        F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("jump"), *_halves(key)
    )

    def move(state: Column, _: Column) -> Column:
        high, low = _step(state["high"], state["low"])
        drawn = F.shiftright(high, 1) + 1
        jump = F.floor((state["jump"] + 1).cast("double") * (F.lit(DRAWS) / drawn.cast("double")))
        moved = F.struct(
            state["jump"].alias("shard"), jump.cast("long").alias("jump"), high.alias("high"), low.alias("low")
        )
        return F.when(state["jump"] >= shards, state).otherwise(moved)

    turns = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(turns, start, move, lambda state: state["shard"].cast("int"))


def first_number(key: Column) -> Column:
    """The first 31-bit number of the key's sequence."""
    high, _ = _step(*_halves(key))
    return F.shiftright(high, 1)


def _halves(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(F.lit(LOW_32)).alias("low")


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """``key * MULTIPLIER + 1`` modulo 2**64 in two halves, by products that fit a signed long."""
    by_high, by_low = F.lit(MULTIPLIER >> 32), F.lit(MULTIPLIER & LOW_32)
    upper = F.shiftright(low, 16) * by_low
    lower = low.bitwiseAND(F.lit(LOW_16)) * by_low + F.shiftleft(upper.bitwiseAND(F.lit(LOW_16)), 16) + 1
    carried = F.shiftright(lower, 32) + F.shiftright(upper, 16)
    new_high = (carried + _product_low(high, by_low) + _product_low(low, by_high)).bitwiseAND(F.lit(LOW_32))
    return new_high, lower.bitwiseAND(F.lit(LOW_32))


def _product_low(a: Column, b: Column) -> Column:
    upper = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(LOW_16))
    return (a.bitwiseAND(F.lit(LOW_16)) * b + F.shiftleft(upper, 16)).bitwiseAND(F.lit(LOW_32))


def sharded_digest(docs: DataFrame, shards: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shard with one shard more, for every row.

    Texts are read once and not shuffled: the digests are written, and the number of rows sets the
    number of buckets.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    digests = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    key = stable_key(digests, "doc_id")
    alike = digests.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    sharded = written(
        alike.withColumns({"shard": jump_shard(key, shards), "grown_shard": jump_shard(key, shards + 1)}), "digests"
    )
    rows = sharded.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    buckets = max(1, -(-rows // (shards * bucket_rows)))
    counted = sharded.withColumn("bucket", F.pmod(first_number(key) + F.col("text_crc32"), F.lit(buckets)))
    in_bucket = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    in_shard = Window.partitionBy("shard").orderBy("bucket")
    starts = (
        counted.groupBy("shard", "bucket")
        .agg(F.sum("copies").alias("rows"))
        .select("shard", "bucket", (F.sum("rows").over(in_shard) - F.col("rows")).alias("before"))
    )
    placed = counted.withColumn("upto", F.sum("copies").over(in_bucket)).join(starts, ["shard", "bucket"])
    last = F.col("before") + F.col("upto") - 1
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        F.explode(F.sequence(last - F.col("copies") + 1, last)).alias("slot"),
        "grown_shard",
    )
