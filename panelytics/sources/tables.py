"""Panels as SQL tables, and ad-hoc SQL over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from panelytics.contract import KEYS
from panelytics.operators.rank import head
from panelytics.sources.sinks import write_panel


def register(
    df: DataFrame,
    name: str,
    persistent: bool = False,
    buckets: int | None = None,
    keys: Sequence[str] = KEYS,
    path: str | None = None,
) -> DataFrame:
    """Make ``df`` queryable as ``name``, replacing an earlier table of that name.

    A temporary view by default. ``persistent`` saves a catalog table; with ``buckets`` it is bucketed and sorted
    by the panel key, so joining two panels saved with the same number of buckets shuffles neither. Its files go to
    ``path``, or else to the warehouse.
    """
    spark = df.sparkSession
    if not persistent:
        df.createOrReplaceTempView(name)
        return df
    if buckets:
        # One task per bucket: otherwise every writing task leaves a file in every bucket.
        writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    else:
        writer = df.write
    if path is not None:
        writer = writer.option("path", path)
    writer.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """The result of a SQL text, lazily; a closing semicolon is allowed."""
    return spark.sql(text.strip().rstrip(";"))


def show_sql(spark: SparkSession, title: str, text: str, rows: int = 15, store: str | None = None) -> DataFrame:
    """Print ``title`` and the first ``rows`` rows; return the whole result.

    With ``store`` the result is written there once, and both the preview and the caller read that. Without, the preview
    runs the query as far as its rows need, and the caller's action runs it again; 0 rows prints the title only.
    """
    result = run_sql(spark, text)
    if store is not None:
        result = write_panel(result, store)
    print(title)
    if rows:
        head(result, rows).show(rows, truncate=False)
    return result
