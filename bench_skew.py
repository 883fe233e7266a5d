"""The rules with one key that holds a third of all rows, next to plain windows over the key.

    python bench_skew.py [sf_dir] [minutes the rows spread over]

The rows are the line items; the plain windows are what one would write without thinking of skew.
Their deviation rule takes many minutes beyond sf0.01.
"""

from __future__ import annotations

import sys
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from cardwatch.functions import haversine_km
from cardwatch.operators import apply_geo_jump_rule, apply_spending_deviation_rule, apply_velocity_rule
from cardwatch.session import ensure_shared_folder, fresh_folder, local_session, remove_working_folders


def fact(spark, sf_dir, minutes):
    hot = F.col("l_orderkey") % 3 == 0
    second = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.monotonically_increasing_id().alias("id"),
        F.when(hot, -1).otherwise(F.col("l_orderkey")).alias("card_id"),
        F.when(hot, -1).otherwise(F.col("l_orderkey")).alias("client_id"),
        F.timestamp_seconds(1_700_000_000 + F.pmod(second, F.lit(minutes * 60))).alias("date"),
        (F.round(F.col("l_extendedprice")) * 0.25).alias("amount"),
        (F.col("l_suppkey") % 50).cast("double").alias("merchant_latitude"),
        (F.col("l_partkey") % 90).cast("double").alias("merchant_longitude"),
    )


def plain_velocity(df):
    w = Window.partitionBy("card_id").orderBy(F.col("date").cast("long")).rangeBetween(-300, 0)
    return df.withColumn("n", F.count(F.lit(1)).over(w))


def plain_geo(df):
    w = Window.partitionBy("card_id").orderBy("date", "id")
    before = [F.lag(c).over(w) for c in ("merchant_latitude", "merchant_longitude")]
    return df.withColumn("km", haversine_km(*before, "merchant_latitude", "merchant_longitude"))


def plain_deviation(df):
    w = Window.partitionBy("client_id").orderBy(F.col("date").cast("long")).rangeBetween(-30 * 86400, -1)
    return df.withColumn("mean", F.avg("amount").over(w))


def seconds(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(sf_dir: str, minutes: int) -> None:
    spark = local_session(spark__ui__showConsoleProgress="false")
    ensure_shared_folder(spark)
    path = fresh_folder(spark, "skew")
    fact(spark, sf_dir, minutes).repartition(8).write.parquet(path)
    df = spark.read.parquet(path)
    print(f"{df.count()} rows over {minutes} minutes, {df.filter('card_id = -1').count()} of one card")
    for name, ours, plain in (
        ("velocity", apply_velocity_rule, plain_velocity),
        ("geo_jump", apply_geo_jump_rule, plain_geo),
        ("deviation", apply_spending_deviation_rule, plain_deviation),
    ):
        seconds(ours(df.limit(1000)))
        print(f"{name:10} cardwatch {seconds(ours(df)):7.1f} s   plain window {seconds(plain(df)):7.1f} s", flush=True)
    remove_working_folders(spark)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", int(sys.argv[2]) if len(sys.argv) > 2 else 43200)
