"""The corpus pipeline: documents in, places in training sequences out.

``STAGES`` lists the stages in order. Each takes the documents that its predecessor kept, with the
columns of ``documents``; the last one returns one row per piece of a document and its place.

Stages work by the doc_id where they have to tell documents apart; in the others rows are enough. An
empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.llm import decontam, neardup, packing, pii, toxicity
from cardwatch.session import ensure_shared_folder, fresh_folder, remove_folder

#: No SQL: the toxicity classifier is trained, and fingerprints and tokens are not SQL's.
ORACLE_SQL = None


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored 0.3 or more go. Learns from the labels of the documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ensure_shared_folder(spark)
    return toxicity.without_toxic(docs, toxicity.trained(docs, toxicity.learnable(labels)))


def not_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: of documents whose five-word shingles are 80 percent alike, one stays."""
    ensure_shared_folder(spark)
    return neardup.near_duplicates_removed(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a window of a benchmark item within its error budget go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonymized(spark: SparkSession, docs: DataFrame, sf_dir: str, key: str = pii.DEMO_KEY) -> DataFrame:
    """Operator 10: personal numbers, addresses and dates become pseudonyms under the key; n_chars follows
    the text."""
    replaced = pii.pseudonymized(docs, key)
    if "n_chars" not in docs.columns:
        return replaced
    same = F.col("n_chars").isNull() | F.col("text").isNull()
    n_chars = F.when(same, F.col("n_chars")).otherwise(F.length("text"))
    return replaced.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every remaining document gets its place in a sequence of 4096 tokens."""
    ensure_shared_folder(spark)
    return packing.pack_documents(docs, packing.vocabulary_file(), capacity=4096)


STAGES = [
    ("toxicity", not_toxic),
    ("near_duplicates", not_near_duplicate),
    ("decontamination", not_in_benchmark),
    ("personal_data", pseudonymized),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next stage, and
    removed once that one is written. The last copy stays, since what is returned reads it."""
    ensure_shared_folder(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path, schema = fresh_folder(spark, name), docs.schema
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
