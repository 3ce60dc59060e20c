"""From a raw text panel to a typed one, as projections over the scan (no shuffle, no Python)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.contract import DATE_FORMATS, MISSING_TOKENS, TEXT_COLUMNS, TIME
from panelytics.functions.parsing import blank_to_null, iso_text, nan_to_null, parse_date, parse_number


def exact_column(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalise_names(df: DataFrame) -> DataFrame:
    """Trim and lower-case the column names; refuse names that collide."""
    names = [name.strip().lower() for name in df.columns]
    clashes = sorted({name for name in names if names.count(name) > 1})
    if clashes:
        raise ValueError(f"column names collide after trimming and lower-casing: {clashes}")
    return df.toDF(*names)


def clean_panel(
    df: DataFrame,
    text_columns: Sequence[str] = TEXT_COLUMNS,
    date_column: str = TIME,
    formats: Sequence[str] = DATE_FORMATS,
    tokens: Sequence[str] = MISSING_TOKENS,
    unread: str | None = None,
) -> DataFrame:
    """Normalise names, parse ``date_column``, keep ``text_columns``, and make every other column DOUBLE.

    A date that no layout reads becomes NULL; with ``unread``, a column of that name keeps its text.
    """
    named = normalise_names(df)
    is_text = {field.name: isinstance(field.dataType, T.StringType) for field in named.schema.fields}

    def cell(name: str) -> Column:
        column = exact_column(name)
        if is_text[name]:
            return blank_to_null(column, tokens)
        return column if name == date_column else column.cast("string" if name in text_columns else "double")

    def value(name: str) -> Column:
        column = exact_column(name)
        if name == date_column:
            return parse_date(column, formats) if is_text[name] else column.cast("date")
        if name in text_columns:
            return column
        return parse_number(column) if is_text[name] else column

    def finished(name: str) -> Column:
        column = exact_column(name)
        return column if name == date_column or name in text_columns else nan_to_null(column)

    # One projection per step: a step that uses the previous result twice then does not compute it twice.
    result = named.select(*[cell(name).alias(name) for name in named.columns])
    kept = []
    if unread is not None:
        text = exact_column(date_column) if is_text.get(date_column) else F.lit(None)
        result, kept = result.withColumn(unread, text.cast("string")), [exact_column(unread)]
    for step in (value, finished):
        result = result.select(*[step(name).alias(name) for name in named.columns], *kept)
    if unread is not None:
        result = result.withColumn(unread, F.when(exact_column(date_column).isNull(), exact_column(unread)))
    return result


def iso_dates(df: DataFrame, columns: Sequence[str] = (TIME,)) -> DataFrame:
    """DATE columns as ISO text, for targets without a date type."""
    return df.withColumns({name: iso_text(name) for name in columns})
