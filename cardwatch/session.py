"""Session settings used by tests and the bench, and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(master)
        .appName("cardwatch")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small inputs still use all local cores after a shuffle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; raises where none is set."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured.rstrip("/")


def ensure_shared_folder(spark: SparkSession) -> None:
    """For entry points: where no shared folder is set, take one below the session's warehouse."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        spark.sparkContext.setCheckpointDir(f"{warehouse}/_checkpoints")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder, among those of this application."""
    return f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_working_folders(spark: SparkSession) -> None:
    """Delete what this application wrote below the shared folder. For the end of a run: frames that
    were made of these files can no longer be read."""
    remove_folder(spark, _application_folder(spark))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder and all that is in it, in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/cardwatch-{spark.sparkContext.applicationId}"
