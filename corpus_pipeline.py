"""From raw documents to packed training batches: quality rules, near-duplicate
removal, redaction of personal data, mixing of sources, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is
written as Parquet and read again as the next stage's documents. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import mix, neardup, packing, pii, rules
from helixframe.llm.tables import arrow_rows
from helixframe.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy; the others go."""
    arrow_rows(spark)
    return rules.keep_good(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8) stays."""
    arrow_rows(spark)
    return neardup.keep_one(docs, size=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by the name of its kind."""
    return pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a row for each copy or part taken."""
    arrow_rows(spark)
    return mix.mixed(docs)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their length bucket, batch and slot."""
    packed = packing.pack(docs, docs.columns)
    return packed.select("doc.*", "n_tokens", "bucket", "bucket_len", "batch", "slot")


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("personal data", personal_data), ("mixing", mixing), ("packing", packing_)]

#: sketches, contexts and seeded selection are outside SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return docs
