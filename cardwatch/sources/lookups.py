"""Small reference files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.functions.cleaning import clean_zip
from cardwatch.functions.geo import known_degrees


def read_json_map(
    spark: SparkSession, path: str, key: str = "mcc", value: str = "mcc_description"
) -> DataFrame:
    """A file with one flat JSON object, ``{"code": "description"}``, as rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def read_zip_centroids(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header and the columns zip_code, latitude, longitude and possibly more."""
    table = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return table.withColumnRenamed("zip_code", "zip").withColumns(
        {"zip": clean_zip("zip"), "latitude": known_degrees("latitude"), "longitude": known_degrees("longitude")}
    )
