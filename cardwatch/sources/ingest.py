"""Incremental ingest of a folder of CSV files.

A file stream with a checkpoint keeps track of which files are new. It carries file names only; each
micro-batch reads its files with Spark's CSV reader, every column as a string and bound by the
file's own header, and casts to the types of the stored schema. Values that do not fit are kept in
``_rescued_data``. Each micro-batch writes a folder of its own with overwrite, so a batch repeated
after a failure replaces itself.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardwatch.operators.quality import check_schema_drift, counting
from cardwatch.sources.paths import exists

BATCH = "_ingest_batch"
RESCUED = "_rescued_data"
DAMAGED = "_damaged_line"
METRICS = "batch bigint, rows bigint, rescued bigint"


def ingest_csv_folder(
    spark: SparkSession,
    source_folder: str,
    target: str,
    state: str,
    stream_name: str,
    schema_hints: str = "",
    expected_columns: Sequence[str] | None = None,
    header: bool = True,
    max_files_per_batch: int | None = None,
) -> DataFrame:
    """Take in the files that are new since the last run and return the whole raw table.

    ``state`` holds the checkpoint and the stored schema. Columns without a hint get the type that
    Spark infers from all files of the run in which they first appear; columns new in a later file are
    appended to the schema. ``max_files_per_batch`` cuts a run into micro-batches, for a backlog of
    more files than the driver can name at once; the first of them then decides the types, so give
    hints with it.
    """

    def take_in(files: DataFrame, batch_id: int) -> None:
        # File names only.
        paths = sorted(row.path for row in files.select("path").collect())
        if not paths:
            return
        by_header = _group_by_header(spark, paths, header)
        schema = _evolve_schema(spark, state, batch_id, by_header, schema_hints, header)
        if expected_columns is not None:
            check_schema_drift(spark.createDataFrame([], schema), expected_columns, stream_name)
        parts = [_read_typed(spark, group, names, schema, header) for names, group in by_header.items()]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows, counts = counting(rows.withColumn("_ingested_at", F.current_timestamp()), stream_name)
        rows.write.mode("overwrite").parquet(f"{target}/{BATCH}={batch_id}")
        told = spark.createDataFrame([(counts.rows, counts.rescued)], "rows bigint, rescued bigint")
        told.coalesce(1).write.mode("overwrite").parquet(f"{state}/metrics/batch={batch_id}")

    files = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary"
    )
    if max_files_per_batch:
        files = files.option("maxFilesPerTrigger", max_files_per_batch)
    query = (
        files.load(source_folder)
        .select("path")
        .writeStream.queryName(stream_name)
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(take_in)
        .start()
    )
    query.awaitTermination()
    return read_raw(spark, target, state)


def ingest_metrics(spark: SparkSession, state: str) -> DataFrame:
    """(batch, rows, rescued): what each micro-batch counted while it was written."""
    if not exists(spark, f"{state}/metrics"):
        return spark.createDataFrame([], METRICS)
    return spark.read.schema(METRICS).parquet(f"{state}/metrics")


def read_raw(spark: SparkSession, target: str, state: str, after_batch: int | None = None) -> DataFrame:
    """The raw table under the stored schema. Columns that came later are NULL in earlier rows. With
    ``after_batch`` only what later micro-batches took in; other folders are not opened."""
    stored = _stored_schema(spark, state)
    if stored is None:
        raise ValueError(f"nothing has been taken in to {target} yet")
    added = [T.StructField(name, T.StringType()) for name in (RESCUED, "_source_file")]
    added += [T.StructField(name, T.TimestampType()) for name in ("_source_time", "_ingested_at")]
    raw = spark.read.schema(T.StructType([*stored.fields, *added, T.StructField(BATCH, T.LongType())])).parquet(target)
    return (raw if after_batch is None else raw.filter(F.col(BATCH) > after_batch)).drop(BATCH)


def _group_by_header(
    spark: SparkSession, paths: Sequence[str], header: bool
) -> dict[tuple[str, ...], list[str]]:
    """Files by their column names, from one distributed job over the first line of each file."""
    lines = (
        spark.read.text(list(paths))
        .select(
            "value",
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("place"),
        )
        .filter((F.col("start") == 0) & (F.trim("value") != ""))
    )
    first = lines.groupBy("path").agg(F.min_by("value", "place").alias("line"))
    known = set(paths)
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, own in first.groupBy("line").agg(F.collect_list("path")).collect():
        names = _names(next(csv.reader([line.removeprefix("\ufeff")])), header)
        # The metadata column gives paths in their encoded form.
        groups.setdefault(names, []).extend(path if path in known else unquote(path) for path in own)
    return {names: sorted(own) for names, own in sorted(groups.items())}


def _names(fields: list[str], header: bool) -> tuple[str, ...]:
    """Column names as Spark's reader gives them: numbered where there are none or they repeat."""
    if not header:
        return tuple(f"_c{k}" for k in range(len(fields)))
    lowered = [name.lower() for name in fields]
    return tuple(
        f"_c{k}" if not name else f"{name}{k}" if lowered.count(name.lower()) > 1 else name
        for k, name in enumerate(fields)
    )


def _stored_schema(spark: SparkSession, state: str, before: int | None = None) -> T.StructType | None:
    """The schema as of the last micro-batch, or of the last one before a given one."""
    if not exists(spark, f"{state}/schema"):
        return None
    stored = spark.read.schema("json string, batch int").parquet(f"{state}/schema")
    if before is not None:
        stored = stored.filter(F.col("batch") < before)
    latest = stored.agg(F.max_by("json", "batch").alias("json")).first()
    return T.StructType.fromJson(json.loads(latest.json)) if latest.json else None


def _evolve_schema(spark, state, batch_id, by_header, schema_hints, header) -> T.StructType:
    """The stored schema plus the columns these files bring; stored again if it grew."""
    known = _stored_schema(spark, state, batch_id) or T.StructType()
    hints = {f.name: f.dataType for f in T.StructType.fromDDL(schema_hints).fields} if schema_hints else {}
    fields = {field.name: field.dataType for field in known.fields}
    for names, paths in by_header.items():
        fresh = [name for name in names if name not in fields]
        inferred = {}
        if any(name not in hints for name in fresh):
            reader = spark.read.option("header", header).option("inferSchema", "true")
            inferred = {field.name: field.dataType for field in reader.csv(paths).schema.fields}
        for name in fresh:
            fields[name] = hints[name] if name in hints else inferred[name]
    schema = T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    if schema != known:
        spark.createDataFrame([(schema.json(),)], "json string").write.mode("overwrite").parquet(
            f"{state}/schema/batch={batch_id}"
        )
    return schema


def _read_typed(
    spark: SparkSession, paths: Sequence[str], names: Sequence[str], schema: T.StructType, header: bool
) -> DataFrame:
    """Files of one header: strings by position, then the types of ``schema`` by name."""
    raw_schema = T.StructType([T.StructField(name, T.StringType()) for name in [*names, DAMAGED]])
    raw = (
        spark.read.schema(raw_schema)
        .option("header", header)
        .option("columnNameOfCorruptRecord", DAMAGED)
        .csv(list(paths))
        .withColumns({"_source_file": F.col("_metadata.file_path"), "_source_time": F.col("_metadata.file_modification_time")})
    )
    present = set(names)
    typed, rescued = [], []
    for field in schema.fields:
        if field.name not in present:
            typed.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        text = F.col(f"`{field.name}`")
        value = text.try_cast(field.dataType)
        typed.append(value.alias(field.name))
        if not isinstance(field.dataType, T.StringType):
            rescued += [F.lit(field.name), F.when(value.isNull(), text)]
    rescued += [F.lit(DAMAGED), F.col(DAMAGED)]
    kept = F.map_filter(F.create_map(*rescued), lambda _, text: text.isNotNull())
    return raw.select(
        *typed,
        F.when(F.size(kept) > 0, F.to_json(kept)).alias(RESCUED),
        *("_source_file", "_source_time"),
    )
