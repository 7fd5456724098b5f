"""Corpus pipeline: toxicity, quality rules, near-duplicates, personal data, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as
Parquet and read again as the next stage's docs. All but the last keep the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import stage
from palimpsest.llm.jaccard_join import keep_one
from palimpsest.llm.packing import pack_documents, with_crc
from palimpsest.llm.personal_data import redact
from palimpsest.llm.quality_rules import keep_good
from palimpsest.llm.toxicity import score


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("not rejected").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (five-word shingles, similarity 0.8): the smallest id."""
    return keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars of the new text."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in windows of 2048 tokens."""
    return with_crc(pack_documents(docs))


STAGES = [
    ("toxicity", toxicity),
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packing),
]

#: No SQL states the trained stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
