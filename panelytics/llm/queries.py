"""The operators of this subpackage as registered queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelytics.llm import (
    conversations,
    decontaminate,
    embeddings,
    html_text,
    language_id,
    merkle,
    near_duplicates,
    oracle,
    packing,
    personal_data,
    secret_scans,
    suffix_dedup,
    token_counts,
    url_filters,
)


def _over(name: str, operator: Callable[..., DataFrame], *others: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*(spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in (name, *others)))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": _over("documents", suffix_dedup.report),
        "op2_decontamination": _over("documents", lambda d, b: decontaminate.report(d, b).drop("longest"), "benchmark"),
        "op3_near_duplicates": _over("documents", near_duplicates.near_duplicates),
        "op4_packing": _over("documents", packing.pack),
        "op5_main_text": _over("pages", html_text.extract),
        "op6_language_id": _over("documents", language_id.report),
        "op7_secret_scans": _over("documents", secret_scans.report),
        "op8_near_vectors": _over("embeddings", embeddings.near_vectors),
        "op9_token_counts": _over("documents", token_counts.report),
        "op10_url_filters": _over("pages", url_filters.judge),
        "op11_merkle_manifest": _over("documents", merkle.report),
        "op12_personal_data": _over("documents", personal_data.report),
        "op13_conversation_repair": _over("conversations", conversations.report),
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
