"""Ranking a whole table without putting it into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.session import fresh_folder


def global_ntile(df: DataFrame, order_cols: Sequence[str], buckets: int, name: str = "ntile") -> DataFrame:
    """``ntile(buckets) over (order by order_cols)`` for a table of any size.

    ``order_cols`` must order the rows totally. Only these columns are range-partitioned, sorted and
    written. One row count per partition tells where each bucket begins, the rows there are looked up,
    and every row of ``df`` is labelled by comparing it with these few, without a shuffle.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, "ranks")
    # The id is (partition << 33) + position within the sorted partition.
    df.select(*order_cols).repartitionByRange(*order_cols).sortWithinPartitions(*order_cols).withColumn(
        "_id", F.monotonically_increasing_id()
    ).write.parquet(path)
    ordered = spark.read.parquet(path)
    part = F.shiftright("_id", 33)
    # At most one row per shuffle partition.
    sizes = sorted((row[0], row[1]) for row in ordered.groupBy(part).agg(F.count(F.lit(1))).collect())
    starts = _first_rows(sizes, buckets)
    border = F.struct(*order_cols)
    rows = ordered.filter(F.col("_id").isin(sorted(set(starts)))).select("_id", *order_cols).collect()
    known = {row["_id"]: row for row in rows}
    bucket = F.lit(1)
    for start in starts:
        first = F.struct(*[F.lit(known[start][c]).cast(df.schema[c].dataType).alias(c) for c in order_cols])
        bucket = bucket + (border >= first).cast("int")
    return df.withColumn(name, bucket)


def _first_rows(sizes: list[tuple[int, int]], buckets: int) -> list[int]:
    """The ids of the first rows of the second and later buckets, as far as there are any."""
    total = sum(size for _, size in sizes)
    each, spare = divmod(total, buckets)
    # The first ``spare`` buckets hold one row more than the others.
    ranks = [k * each + min(k, spare) for k in range(1, buckets)]
    found, before = [], 0
    for part, size in sizes:
        found += [(part << 33) + rank - before for rank in ranks if before <= rank < before + size]
        before += size
    return found
