"""A training-data pipeline of five stages, each written as Parquet and read again as the next one's documents.

Quality rules drop what they reject, near-dedup keeps one document of each near-duplicate group, decontamination drops
documents with benchmark passages, the secret scan replaces what it finds by a mark (n_chars follows), and packing gives the
pieces of the training sequences. Near-duplicates are texts whose 5-word shingles have a Jaccard similarity of 0.8 or more,
and what these link. In every stage null, empty and wordless texts are documents like others (the quality rules drop them as
too short), repeated rows are copies of each other, null doc_ids come after all others where one of a group stays, extra
columns of any name are kept up to packing, texts are read whole, and an empty table gives no rows. SQL cannot express the fingerprints or the tokenizer, so there is no oracle; tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontaminate, packing, quality, secrets, simhash
from reelspark.llm.common import new_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, memo=100_000)  # workers live through all stages and keep what they remember


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        at = new_table(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
