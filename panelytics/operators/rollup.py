"""Reductions: peaks of cumulative metrics, totals of daily metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.contract import ENTITY, GROUP


def real_entities(df: DataFrame, group: str = GROUP) -> DataFrame:
    """Drop the pre-aggregated rows, which carry no group."""
    return df.filter(F.col(group).isNotNull())


def entity_peaks(
    df: DataFrame, peaks: Sequence[str], means: Sequence[str] = (), keys: Sequence[str] = (GROUP, ENTITY)
) -> DataFrame:
    """Per key, the maximum of each cumulative metric (keeping its name) and the mean of others (``avg_<name>``).

    Maxima rather than last values: the last day may lack a figure. Both reduce before the shuffle, so a key with
    very many rows costs no more to move than any other.
    """
    return df.groupBy(*keys).agg(
        *[F.max(name).alias(name) for name in peaks], *[F.avg(name).alias(f"avg_{name}") for name in means]
    )


def flow_totals(df: DataFrame, flows: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Sums of daily metrics, per key or over everything (one row). All-missing sums are NULL."""
    return df.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in flows])
