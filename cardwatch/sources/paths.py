"""Paths in whatever file system Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; failures to look are raised."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def has_files(spark: SparkSession, folder: str) -> bool:
    """Whether a folder exists and holds anything that a reader would read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return False
    names = [status.getPath().getName() for status in system.listStatus(place)]
    return any(not name.startswith(("_", ".")) for name in names)
