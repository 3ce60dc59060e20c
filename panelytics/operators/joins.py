"""Joins between the two panels and between their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.contract import ENTITY, GROUP, KEYS


def join_panels(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Inner join on the panel key; a column both sides carry is taken from the left.

    Each key is expected at most once per side (check at load with ``assert_unique_keys``), so rows match one to
    one; see ``joined_peaks`` for panels that may repeat keys. The strategy is left to Spark: broadcast when a side is measured small, otherwise a shuffle on the key
    (none if both are bucketed by it) with adaptive skew splitting.
    """
    repeated = [name for name in right.columns if name in left.columns and name not in keys]
    return left.join(right.drop(*repeated), list(keys), "inner")


def joined_peaks(
    left: DataFrame,
    right: DataFrame,
    left_peaks: Sequence[str],
    right_peaks: Sequence[str],
    right_means: Sequence[str] = (),
    keys: Sequence[str] = KEYS,
    groups: Sequence[str] = (GROUP, ENTITY),
) -> DataFrame:
    """What ``entity_peaks`` gives on ``join_panels``, without ever forming the joined rows of a repeated key.

    Each side is reduced to one row per key (and group) first, with counts to weight the means as the joined rows
    would. A key repeated m and n times then costs one joined row instead of m times n, and no task sees more than
    one row per key and writing task. For panels known to have unique keys the plain join saves a shuffle.
    """
    days = left.groupBy(*keys, *groups).agg(
        *[F.max(name).alias(name) for name in left_peaks], F.count(F.lit(1)).alias("_copies")
    )
    values = right.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in right_peaks],
        *[F.sum(name).alias(f"_sum_{name}") for name in right_means],
        *[F.count(name).alias(f"_count_{name}") for name in right_means],
    )

    def mean(name: str):
        total = F.sum(F.col("_copies") * F.col(f"_sum_{name}"))
        return total / F.nullif(F.sum(F.col("_copies") * F.col(f"_count_{name}")), F.lit(0))

    return (
        days.join(values, list(keys), "inner")
        .groupBy(*groups)
        .agg(
            *[F.max(name).alias(name) for name in [*left_peaks, *right_peaks]],
            *[mean(name).alias(f"avg_{name}") for name in right_means],
        )
    )


def join_summaries(left: DataFrame, right: DataFrame, on: Sequence[str] = (ENTITY,)) -> DataFrame:
    """Inner join of two results that hold one row per ``on``."""
    return left.join(right, list(on), "inner")
