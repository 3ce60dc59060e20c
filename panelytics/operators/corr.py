"""Pairwise Pearson correlation with pairwise deletion of missing values, in one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]


#: Values are grouped by binary order of magnitude, so many orders to a group, and scaled to the middle of the range of
#: doubles; their squares, and sums of those, stay far from both its ends. Ordinary values are all in group 0, unscaled.
_ORDERS, _OUTERMOST = 400, 2


def _finite(name: str) -> str:
    """SQL, as the expressions of many columns are quicker parsed than built. NaN is above infinity."""
    value = f"CAST(`{name.replace('`', '``')}` AS DOUBLE)"
    return f"CASE WHEN abs({value}) < double('Infinity') THEN {value} END"


def _group(value: str) -> str:
    """The group of a value's size: 0 for missing values, zero, and all between 2**-200 and 2**200."""
    least, most = 2.0 ** -(_ORDERS // 2), 2.0 ** (_ORDERS // 2)
    ordinary = f"{value} IS NULL OR {value} = 0 OR abs({value}) BETWEEN {least!r}D AND {most!r}D"
    group = f"CAST(rint(log2(abs({value})) / {_ORDERS}) AS INT)"
    return f"CASE WHEN {ordinary} THEN 0 ELSE greatest(least({group}, {_OUTERMOST}), -{_OUTERMOST}) END"


def _power(groups: Column) -> Column:
    return F.pow(F.lit(2.0), groups * _ORDERS)


def _merged(parts: Column) -> Column:
    """Moments over all groups of a pair, in units of the largest groups of either column."""
    top_a, top_b = F.array_max(parts["group_a"]), F.array_max(parts["group_b"])

    def step(so_far: Column, part: Column) -> Column:
        scale_a, scale_b = _power(part["group_a"] - top_a), _power(part["group_b"] - top_b)
        n = so_far["n"] + part["n"]
        off_a, off_b = part["mean_a"] * scale_a - so_far["mean_a"], part["mean_b"] * scale_b - so_far["mean_b"]
        share, weight = part["n"] / n, so_far["n"] * part["n"] / n
        return F.struct(
            n.alias("n"),
            (so_far["mean_a"] + off_a * share).alias("mean_a"),
            (so_far["mean_b"] + off_b * share).alias("mean_b"),
            (so_far["sxx"] + part["sxx"] * scale_a * scale_a + off_a * off_a * weight).alias("sxx"),
            (so_far["syy"] + part["syy"] * scale_b * scale_b + off_b * off_b * weight).alias("syy"),
            (so_far["sxy"] + part["sxy"] * scale_a * scale_b + off_a * off_b * weight).alias("sxy"),
        )

    nothing = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean_a", "mean_b", "sxx", "syy", "sxy")])
    return F.aggregate(parts, nothing, step)


def _pair_correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(_i, _j, corr)`` for column numbers ``_i <= _j``.

    Only finite values count. Each row is fanned out to one entry per column pair and folded into moments per pair and
    groups of sizes before the shuffle, which therefore moves one row per pair, task and groups met, nearly always one.
    The groups carry their powers of two along and are merged last, so squares neither overflow nor vanish, and the data
    is read once. Against one aggregate expression per pair and moment the fan-out costs a quarter for 10 columns, where
    the wide aggregate no longer compiles to code.
    """
    last = F.lit(len(names) - 1)

    columns = [f"_{i}" for i in range(len(names))]
    plain = df.selectExpr(*[f"{_finite(name)} AS {c}" for name, c in zip(names, columns)])
    grouped = plain.selectExpr(*columns, *[f"{_group(c)} AS {c}g" for c in columns])
    scaled = [f"CASE WHEN {c}g = 0 THEN {c} ELSE {c} * pow(2.0D, -{c}g * {_ORDERS}) END" for c in columns]
    values = grouped.selectExpr(
        f"array({', '.join(scaled)}) AS row", f"array({', '.join(f'{c}g' for c in columns)}) AS groups"
    )
    # A row without values changes no moment but makes every pair appear, even when the input is empty.
    blank = df.sparkSession.range(0, 1, 1, 1).select(
        F.array_repeat(F.lit(None).cast("double"), len(names)).alias("row"),
        F.array_repeat(F.lit(0), len(names)).alias("groups"),
    )
    at = lambda array, number: F.col(array)[F.col(number)]
    both = at("row", "_i").isNotNull() & at("row", "_j").isNotNull()
    pairs = (
        values.unionByName(blank)
        .select("row", "groups", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
        .select("row", "groups", "_i", F.explode(F.sequence("_i", last)).alias("_j"))
        .select(
            "_i",
            "_j",
            F.when(both, at("groups", "_i")).otherwise(0).alias("group_a"),
            F.when(both, at("groups", "_j")).otherwise(0).alias("group_b"),
            F.when(both, at("row", "_i")).alias("a"),
            F.when(both, at("row", "_j")).alias("b"),
        )
    )
    moments = pairs.groupBy("_i", "_j", "group_a", "group_b").agg(
        F.count("a").cast("double").alias("n"),
        F.max("a").alias("top_a"),
        F.max("b").alias("top_b"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.regr_sxx("b", "a").alias("sxx"),
        F.regr_syy("b", "a").alias("syy"),
        F.regr_sxy("b", "a").alias("sxy"),
    )
    # where a column has one value, that is its mean, to the last bit: a constant column over several groups stays one
    moments = moments.withColumns(
        {
            "mean_a": F.when(F.col("sxx") == 0, F.col("top_a")).otherwise(F.col("mean_a")),
            "mean_b": F.when(F.col("syy") == 0, F.col("top_b")).otherwise(F.col("mean_b")),
        }
    )
    part = F.struct("n", "group_a", "group_b", "mean_a", "mean_b", "sxx", "syy", "sxy")
    # at most (2 * _OUTERMOST + 1) ** 2 groups
    parts = moments.groupBy("_i", "_j").agg(F.collect_list(F.when(F.col("n") > 0, part)).alias("parts"))
    own = F.get("parts", F.lit(0))
    merged = parts.select("_i", "_j", F.when(F.size("parts") > 1, _merged(F.col("parts"))).alias("m"), own.alias("own"))
    sxx, syy, sxy = (F.coalesce(F.col(f"m.{c}"), F.col(f"own.{c}")) for c in ("sxx", "syy", "sxy"))
    r = sxy / F.nullif(F.sqrt(sxx) * F.sqrt(syy), F.lit(0.0))
    # greatest and least skip NULLs and rank NaN above all numbers, so neither must reach them
    clipped = F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return merged.select("_i", "_j", clipped.alias("corr"))


def _name(names: Sequence[str], number: str) -> Column:
    return F.array(*[F.lit(name) for name in names])[F.col(number)]


def corr_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(x, y, corr)`` for every unordered pair of numeric columns, each with itself included.

    NULL when either column is constant, or absent, over the rows where both are present and finite. Without numeric
    columns there are no rows.
    """
    names = _numeric(df, columns)
    if not names:
        return df.sparkSession.createDataFrame([], "x string, y string, corr double")
    return _pair_correlations(df, names).select(_name(names, "_i").alias("x"), _name(names, "_j").alias("y"), "corr")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The square matrix: one row per column, named in ``column``, in the order of ``columns``."""
    names = _numeric(df, columns)
    if not names:
        return df.sparkSession.createDataFrame([], "column string")
    pairs = _pair_correlations(df, names)
    both_ways = F.array(
        F.struct("_i", "_j", "corr"), F.struct(F.col("_j").alias("_i"), F.col("_i").alias("_j"), F.col("corr"))
    )
    cells = pairs.select(F.inline(both_ways))
    # every (_i, _j) holds one value, or the same value twice
    rows = cells.groupBy("_i").agg(
        *[F.max(F.when(F.col("_j") == number, F.col("corr"))).alias(name) for number, name in enumerate(names)]
    )
    return rows.orderBy("_i").select(_name(names, "_i").alias("column"), *names)
