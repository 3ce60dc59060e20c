"""Null-safe rates and rounding. All arithmetic is in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def rate(numerator: Column | str, denominator: Column | str, per: float, digits: int = 2) -> Column:
    """``numerator`` per ``per`` units of ``denominator``; NULL where the denominator is 0 or NULL."""
    return F.round(
        _double(numerator) * F.lit(float(per)) / F.nullif(_double(denominator), F.lit(0.0)), digits
    )


def pct(numerator: Column | str, denominator: Column | str, digits: int = 2) -> Column:
    return rate(numerator, denominator, 100.0, digits)


def per_100k(numerator: Column | str, denominator: Column | str, digits: int = 2) -> Column:
    return rate(numerator, denominator, 100_000.0, digits)


def scaled(value: Column | str, factor: float = 100.0, digits: int = 2) -> Column:
    """A fraction as a percentage (no division, so no guard)."""
    return F.round(_double(value) * F.lit(float(factor)), digits)


def whole(value: Column | str) -> Column:
    """Round half away from zero to no decimals, staying DOUBLE."""
    return F.round(_double(value), 0)
