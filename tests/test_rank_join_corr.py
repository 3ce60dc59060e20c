from __future__ import annotations

import datetime as dt
import math
import random
from fractions import Fraction

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelytics.operators import (
    bottom_k,
    corr_matrix,
    corr_pairs,
    entity_peaks,
    head,
    join_panels,
    join_summaries,
    joined_peaks,
    ordered,
    tail,
    to_series,
    top_k,
)

RANKED = [("d", 1.0), ("c", None), ("b", 2.0), ("a", 2.0), ("e", 0.5)]


@pytest.fixture
def ranked(spark):
    return spark.createDataFrame(RANKED, "location string, v double").repartition(3)


def _names(df):
    return "".join(row[0] for row in df.collect())


def test_ties_are_cut_by_name_and_missing_ranks_last(ranked):
    assert _names(top_k(ranked, "v", 1)) == "a"
    assert _names(top_k(ranked, "v", 9)) == "abdec"
    assert _names(bottom_k(ranked, "v", 3)) == "ced"
    assert _names(ordered(ranked, "v")) == "edabc"
    assert _names(ordered(ranked, "v", missing_first=True, ascending=False)) == "cabde"


def test_top_k_does_not_sort_globally(ranked, plan_of):
    assert "TakeOrderedAndProject" in plan_of(top_k(ranked, "v", 2))
    assert "TakeOrderedAndProject" in plan_of(tail(ranked, ["location"], 2))


def test_head_and_tail(ranked):
    assert _names(tail(ranked, ["location"], 2)) == "de"
    assert head(ranked, 2).count() == 2


D1, D2 = dt.date(2021, 1, 1), dt.date(2021, 1, 2)


def test_only_matched_days_and_present_keys_join(spark):
    left = spark.createDataFrame(
        [("X", D1, "Asia", 1.0), ("X", D2, "Asia", 2.0), (None, D1, "Asia", 3.0), ("Y", None, "Asia", 4.0)],
        "iso_code string, date date, continent string, a double",
    )
    right = spark.createDataFrame(
        [("X", D1, "other", 10.0), ("Z", D1, "other", 20.0), (None, D1, "other", 30.0), ("Y", None, "other", 40.0)],
        "iso_code string, date date, continent string, b double",
    )
    joined = join_panels(left, right)
    assert joined.columns == ["iso_code", "date", "continent", "a", "b"]
    assert joined.collect() == [("X", D1, "Asia", 1.0, 10.0)]


def _repeated(rng, n, columns):
    value = lambda: rng.choice([None, *map(float, range(6))])
    keys = [(rng.choice(["X", "Y", None]), rng.choice([D1, D2, None])) for _ in range(n)]
    return [(*key, *[value() for _ in range(columns)]) for key in keys]


def test_peaks_of_repeated_keys_equal_those_of_all_joined_rows(spark):
    rng = random.Random(3)
    left = [(*row, f"G{rng.randint(0, 3)}", "E") for row in _repeated(rng, 120, 1)]
    right = _repeated(rng, 90, 3)
    a = spark.createDataFrame(left, "iso_code string, date date, u double, continent string, location string")
    b = spark.createDataFrame(right, "iso_code string, date date, v double, w double, x double").withColumn(
        "x", F.when(F.col("iso_code") == "Y", F.col("x"))
    )
    slow = entity_peaks(join_panels(a, b), ["u", "v"], ["w", "x"]).orderBy("continent").collect()
    fast = joined_peaks(a, b, ["u"], ["v"], ["w", "x"]).orderBy("continent").collect()
    assert len(slow) == len(fast) == 4
    for want, got in zip(slow, fast):
        assert tuple(got)[:4] == tuple(want)[:4]
        assert tuple(got)[4:] == pytest.approx(tuple(want)[4:], abs=1e-12)


def test_a_key_with_very_many_copies_is_joined_once(spark):
    key = [F.lit("X").alias("iso_code"), F.lit(D1).alias("date")]
    a = spark.range(200_000).select(*key, F.col("id").alias("u"), F.lit("G").alias("continent"), F.lit("E").alias("location"))
    b = spark.range(200_000).select(*key, (F.col("id") % 7).alias("v"))
    assert joined_peaks(a, b, ["u"], ["v"], ["v"]).select("u", "v", F.round("avg_v", 4)).first() == (199999, 6, 3.0)


def test_summaries_join(spark):
    a = spark.createDataFrame([("X", 1), ("Y", 2)], "location string, a int")
    b = spark.createDataFrame([("Y", 3), (None, 4)], "location string, b int")
    assert join_summaries(a, b).collect() == [("Y", 2, 3)]


NAMES = ["a", "b", "c", "constant", "empty", "rare"]


def _frame():
    rng = random.Random(5)
    rows = []
    for i in range(80):
        a = rng.uniform(-5, 5)
        rows.append(
            (
                a if i % 7 else None,
                a * 2 + rng.uniform(-1, 1) if i % 5 else None,
                rng.uniform(0, 1e6),
                3.3,
                None,
                1.0 if i == 3 else None,
                f"t{i}",
            )
        )
    return rows


def test_correlation_matches_pandas(spark):
    rows = _frame()
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", label string").repartition(4)
    expected = pd.DataFrame(rows, columns=[*NAMES, "label"])[NAMES].astype(float).corr()
    matrix = corr_matrix(df, [*NAMES, "label"]).collect()
    assert [row["column"] for row in matrix] == NAMES
    for row in matrix:
        for other in NAMES:
            want = expected.loc[row["column"], other]
            if math.isnan(want):
                assert row[other] is None
            else:
                assert row[other] == pytest.approx(want, abs=1e-9) and -1 <= row[other] <= 1
    pairs = {(r["x"], r["y"]): r["corr"] for r in corr_pairs(df, NAMES).collect()}
    assert len(pairs) == 21
    assert all(row[y] == pairs[(x, y)] for row in matrix for (x, y) in pairs if row["column"] == x)


def test_correlation_of_nothing_has_every_cell(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert [tuple(row) for row in corr_matrix(empty, ["a", "b"]).collect()] == [("a", None, None), ("b", None, None)]
    assert corr_pairs(empty, ["a", "b"]).count() == 3


def _pair(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a double, b double")
    return {(r["x"], r["y"]): r["corr"] for r in corr_pairs(df, ["a", "b"]).collect()}[("a", "b")]


def test_only_finite_pairs_count(spark):
    inf, nan = math.inf, math.nan
    assert _pair(spark, [1.0, inf, 3.0, 4.0], [5.0, 1.0, 9.0, 2.0]) == pytest.approx(-0.2485, abs=1e-4)
    assert _pair(spark, [1.0, nan, 3.0, 4.0], [5.0, 1.0, 9.0, -inf]) == pytest.approx(1.0)
    assert _pair(spark, [inf, -inf, nan], [1.0, 2.0, 3.0]) is None


@pytest.mark.parametrize("size", [1.0, 1e160, 1e-170, 1e300, 1e-300])
def test_squares_neither_overflow_nor_vanish(spark, size):
    r = _pair(spark, [x * size for x in (1.0, 2.0, 3.0)], [2.0, 1.0, 5.0])
    assert r == pytest.approx(0.720577, abs=1e-6)
    assert _pair(spark, [x * size for x in (1.0, 2.0, 3.0)], [x / size for x in (2.0, 1.0, 5.0)]) == pytest.approx(r)


def test_correlation_without_numeric_columns_has_no_rows(spark):
    df = spark.createDataFrame([("x", "y")], "a string, b string")
    assert corr_pairs(df, ["a", "b"]).collect() == [] and corr_matrix(df, ["a", "b"]).collect() == []


def test_perfect_correlation_stays_within_bounds(spark):
    rows = [(0.1 * i, -0.3 * i) for i in range(30)]
    (value,) = [r["corr"] for r in corr_pairs(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).collect() if r["x"] != r["y"]]
    assert -1.0 <= value <= -0.999999


def test_long_forms(spark):
    df = spark.createDataFrame([(1, "p", 2.0, 3.0)], "t int, g string, u double, v double")
    assert sorted(to_series(df, "t", ["u", "v"]).collect()) == [("u", 1, 2.0), ("v", 1, 3.0)]
    assert to_series(df, "t", "v", series="g").collect() == [("p", 1, 3.0)]


def test_correlated_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "i double, `a b` double")
    assert [row["column"] for row in corr_matrix(df, ["i", "a b"]).collect()] == ["i", "a b"]


def _exact(rows):
    """Correlation in fractions, over pairs where both are present."""
    pairs = [(Fraction(a), Fraction(b)) for a, b in rows if a is not None and b is not None]
    n = len(pairs)
    mean = [sum(p[i] for p in pairs) / n for i in (0, 1)]
    sxy, sxx, syy = (sum((p[i] - mean[i]) * (p[j] - mean[j]) for p in pairs) for i, j in ((0, 1), (0, 0), (1, 1)))
    if not sxx or not syy:
        return None
    squared = sxy * sxy / (sxx * syy)
    return math.sqrt(squared) * (1 if sxy > 0 else -1)


@pytest.mark.parametrize("seed", range(3))
def test_values_of_all_sizes_in_one_column(spark, seed):
    rng = random.Random(seed)
    sizes = [(1e160, 1.0), (1e-170, 1e300), (1.0, 1e-300), (5e-324, 8e307), (1e-170, 1e-171)]
    for a_size, b_size in sizes:
        rows = []
        for _ in range(60):
            a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
            a_scale, b_scale = rng.choice([a_size, a_size, 1.0]), rng.choice([b_size, 1e60])
            rows.append((a * a_scale, (a + b) * b_scale if rng.random() < 0.9 else None))
        df = spark.createDataFrame(rows, "a double, b double").repartition(3)
        got = {(r["x"], r["y"]): r["corr"] for r in corr_pairs(df, ["a", "b"]).collect()}
        assert got["a", "b"] == pytest.approx(_exact(rows), abs=1e-9)


def test_a_constant_beside_values_of_all_sizes(spark):
    df = spark.range(300).select(F.lit(0.1).alias("a"), F.pow(F.lit(10.0), F.col("id") * 2 - 300).alias("b"))
    got = {(r["x"], r["y"]): r["corr"] for r in corr_pairs(df, ["a", "b"]).collect()}
    assert got == {("a", "a"): None, ("a", "b"): None, ("b", "b"): 1.0}


def test_correlation_reads_its_input_once(spark, plan_of, tmp_path):
    spark.range(10).selectExpr("id * 1.5D AS a", "id * id * 1D AS b").write.parquet(str(tmp_path / "t"))
    plan = plan_of(corr_matrix(spark.read.parquet(str(tmp_path / "t")), ["a", "b"]))
    assert plan.count("FileScan parquet") == 1 and "Subquery" not in plan
