"""Column expressions."""

from panelytics.functions.measures import pct, per_100k, rate, scaled, whole
from panelytics.functions.parsing import blank_to_null, iso_text, nan_to_null, parse_date, parse_number

__all__ = [
    "blank_to_null",
    "iso_text",
    "nan_to_null",
    "parse_date",
    "parse_number",
    "pct",
    "per_100k",
    "rate",
    "scaled",
    "whole",
]
