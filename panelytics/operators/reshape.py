"""Long form for plotting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_series(df: DataFrame, x: str, y: str | Sequence[str], series: str | None = None) -> DataFrame:
    """``(series, x, y)`` rows: one series per ``y`` column, or per value of ``series`` for a single ``y``."""
    if series is not None:
        return df.select(F.col(series).alias("series"), F.col(x).alias("x"), F.col(y).alias("y"))
    names = [y] if isinstance(y, str) else list(y)
    return df.select(F.col(x).alias("x"), *names).unpivot("x", names, "series", "y").select("series", "x", "y")
