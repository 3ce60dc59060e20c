"""The corpus job: language ID, near duplicates, leaks of benchmarks, secrets, packing.

Each stage works on all that its predecessor kept; between two stages the documents are written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelytics.llm import decontaminate, language_id, near_duplicates, packing, secret_scans
from panelytics.llm.storage import stored


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told."""
    return language_id.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_duplicates.without_near_duplicates(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a passage of the benchmark."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live secrets replaced in their texts."""
    return secret_scans.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens as pieces of sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", with_language),
    ("MinHash near-dedup", without_copies),
    ("benchmark decontamination", without_leaks),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Trained and iterative stages aren't expressible in SQL; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from ``documents`` to packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
