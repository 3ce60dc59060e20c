"""Data-quality reports. Each is one row (or one row per column), computed from combined partial counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.contract import CODE, ENTITY, GROUP, KEYS, MISSINGNESS_SIZE, TIME
from panelytics.operators.clean import exact_column
from panelytics.operators.rank import top_k


def shape(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``columns``."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def coverage(df: DataFrame, code: str = CODE, entity: str = ENTITY, group: str = GROUP, time: str = TIME) -> DataFrame:
    """One row: size, distinct codes and entities, time range, and the number of roll-up rows.

    Rows are first reduced to one per (code, entity, is-roll-up), so the two distinct counts run on that small
    result and the panel itself is neither multiplied per distinct count nor shuffled row by row.
    """
    seen = df.groupBy(code, entity, F.col(group).isNull().alias("_rollup")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(time).alias("_first"), F.max(time).alias("_last")
    )
    return seen.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.count_distinct(code).alias("iso_codes"),
        F.count_distinct(entity).alias("locations"),
        F.min("_first").alias("start_date"),
        F.max("_last").alias("end_date"),
        F.sum(F.when(F.col("_rollup"), F.col("_n")).otherwise(0)).alias("aggregate_rows"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str] = KEYS, name: str = "duplicate_iso_date_rows") -> DataFrame:
    """One row: how many rows repeat a key seen before. Missing key values count as equal to each other."""
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name))


def assert_unique_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Return ``df``, or raise if any key repeats. Eager: meant to run once, when a panel is loaded."""
    repeated = duplicate_keys(df, keys, "n").first()["n"]
    if repeated:
        raise ValueError(f"{repeated} rows repeat a key in {tuple(keys)}")
    return df


def table_profile(
    df: DataFrame,
    name: str,
    entity: str = ENTITY,
    group: str = GROUP,
    time: str = TIME,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row describing the table: size, distinct entities with and without a group, time range, repeated keys.

    The table is read once: both halves of the report start from the same counts per key, entity and kind of row.
    """
    named = [F.col(key).alias(f"_key_{i}") for i, key in enumerate(keys)]
    counts = [F.count(F.lit(1)).alias("_n"), F.min(time).alias("_first"), F.max(time).alias("_last")]
    seen = df.groupBy(*named, F.col(entity).alias("_entity"), F.col(group).isNotNull().alias("_grouped")).agg(*counts)

    def folded(*columns: str) -> DataFrame:
        # the same aggregates in both halves, so that they share the shuffle of ``seen``
        sums = [F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last")]
        return seen.groupBy(*columns).agg(*sums)

    whole = [
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.min("_first").alias("start_date"),
        F.max("_last").alias("end_date"),
    ]
    size = folded("_entity", "_grouped").agg(
        *whole,
        F.count_distinct("_entity").alias("unique_locations"),
        F.count_distinct(F.when(F.col("_grouped"), F.col("_entity"))).alias("country_locations"),
    )
    repeats = folded(*[f"_key_{i}" for i in range(len(keys))]).agg(
        *whole, F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_iso_date_rows")
    )
    # Two one-row reports side by side: stacked, then folded into one row.
    parts = size.unionByName(repeats, allowMissingColumns=True)
    return parts.agg(*[F.max(column).alias(column) for column in parts.columns]).select(
        F.lit(name).alias("table"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        "unique_locations",
        "country_locations",
        "start_date",
        "end_date",
        "duplicate_iso_date_rows",
    )


def compare_profiles(tables: dict[str, DataFrame], **roles) -> DataFrame:
    """One profile row per named table."""
    rows = [table_profile(df, name, **roles) for name, df in tables.items()]
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row)
    return stacked


def rollup_labels(df: DataFrame, entity: str = ENTITY, group: str = GROUP) -> DataFrame:
    """Sorted labels of the pre-aggregated rows (those without a group)."""
    unlabelled = F.col(group).isNull() & F.col(entity).isNotNull()
    return df.filter(unlabelled).select(entity).distinct().orderBy(entity)


def missingness(df: DataFrame, k: int | None = MISSINGNESS_SIZE) -> DataFrame:
    """Share of missing values per column in percent, worst first, ``k`` rows (all when None). One pass."""

    def present(field: T.StructField):
        column = exact_column(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.when(~F.isnan(column), column)
        return F.count(column)

    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[present(f).alias(f"_present_{i}") for i, f in enumerate(fields)]
    )
    shares = counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f.name).alias("column"),
                        (
                            (F.col("_rows") - F.col(f"_present_{i}")) * F.lit(100.0) / F.nullif("_rows", F.lit(0))
                        ).alias("missing_pct"),
                    )
                    for i, f in enumerate(fields)
                ]
            )
        )
    )
    return top_k(shares, "missing_pct", len(fields) if k is None else k, ties=["column"])
