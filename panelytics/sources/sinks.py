"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from panelytics.operators.clean import iso_dates


def write_panel(df: DataFrame, path: str, cluster_by: Sequence[str] = ()) -> DataFrame:
    """Store a panel as Parquet, without a shuffle by default, and return it read back.

    With ``cluster_by`` (say entity and time) rows are range-partitioned and sorted: files get even sizes even when
    one entity holds most rows, and a filter on one entity skips the row groups of all others. That costs a shuffle
    of the panel and a second read to find the ranges, so it pays for panels often filtered by entity.
    """
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export(df: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False) -> None:
    """Write a result for other tools: ``parquet``, or ``csv`` with a header and ISO dates.

    ``single_file`` is for results of known small size, such as a ranking; the rows are worked out in parallel and only
    then brought together.
    """
    out = df.repartition(1) if single_file else df
    if fmt == "parquet":
        out.write.mode("overwrite").parquet(path)
    elif fmt == "csv":
        days = [f.name for f in out.schema.fields if isinstance(f.dataType, T.DateType)]
        iso_dates(out, days).write.mode("overwrite").option("escape", '"').csv(path, header=True)
    else:
        raise ValueError(f"unknown format: {fmt}")
