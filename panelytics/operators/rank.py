"""Sorting and top-k, always with a tie-break so that the cut is stable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.contract import ENTITY


def ordered(
    df: DataFrame, by: str, ties: Sequence[str] = (ENTITY,), ascending: bool = True, missing_first: bool = False
) -> DataFrame:
    """Full sort by ``by``, then by ``ties`` ascending."""
    column = F.col(by)
    if ascending:
        key = column.asc_nulls_first() if missing_first else column.asc_nulls_last()
    else:
        key = column.desc_nulls_first() if missing_first else column.desc_nulls_last()
    return df.orderBy(key, *[F.col(tie).asc_nulls_first() for tie in ties])


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = (ENTITY,)) -> DataFrame:
    """The ``k`` rows with the largest ``by``; missing values rank last."""
    return ordered(df, by, ties, ascending=False).limit(k)


def bottom_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = (ENTITY,)) -> DataFrame:
    """The ``k`` rows with the smallest ``by``; missing values rank first."""
    return ordered(df, by, ties, ascending=True, missing_first=True).limit(k)


def head(df: DataFrame, k: int = 5) -> DataFrame:
    return df.limit(k)


def tail(df: DataFrame, order: Sequence[str], k: int = 10) -> DataFrame:
    """The last ``k`` rows of ``df`` under ``order``, in that order; found from the far end rather than by collecting."""
    last = df.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(k)
    return last.orderBy(*[F.col(c).asc_nulls_first() for c in order])
