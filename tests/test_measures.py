from __future__ import annotations

from pyspark.sql import functions as F

from panelytics.functions import pct, per_100k, rate, scaled, whole
from panelytics.operators import entity_peaks, flow_totals, real_entities


def _one(spark, column, **values):
    schema = ", ".join(f"{name} double" for name in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_zero_and_missing_denominators_give_null(spark):
    assert _one(spark, pct("a", "b"), a=5.0, b=0.0) is None
    assert _one(spark, pct("a", "b"), a=5.0, b=None) is None
    assert _one(spark, pct("a", "b"), a=None, b=5.0) is None


def test_rates(spark):
    assert _one(spark, pct("a", "b"), a=1.0, b=3.0) == 33.33
    assert _one(spark, pct("a", "b", 3), a=1.0, b=3.0) == 33.333
    assert _one(spark, per_100k("a", "b"), a=1.0, b=3.0) == 33333.33
    assert _one(spark, rate("a", "b", 1, 0), a=5.0, b=2.0) == 3.0
    assert _one(spark, scaled("a"), a=0.12345) == 12.35


def test_halves_round_away_from_zero_in_decimal_form(spark):
    assert [_one(spark, scaled("a", 1.0), a=v) for v in (0.285, 1.005, -0.285)] == [0.29, 1.01, -0.29]
    assert [_one(spark, whole("a"), a=v) for v in (0.5, 1.5, -2.5)] == [1.0, 2.0, -3.0]


def test_integer_input_stays_double(spark):
    df = spark.createDataFrame([(1, 4)], "a int, b bigint").select(pct("a", "b").alias("r"), whole("a").alias("w"))
    assert dict(df.dtypes) == {"r": "double", "w": "double"}
    assert df.first() == (25.0, 1.0)


ROWS = [
    ("Asia", "A", 1.0, 10.0, None),
    ("Asia", "A", 3.0, None, None),
    ("Asia", "A", None, 30.0, None),
    ("Asia", "B", None, 5.0, None),
    (None, "World", 99.0, 999.0, None),
]
SCHEMA = "continent string, location string, stock double, flow double, empty double"


def test_peaks_skip_missing_values(spark):
    df = real_entities(spark.createDataFrame(ROWS, SCHEMA))
    result = entity_peaks(df, ["stock", "empty"], means=["flow"]).orderBy("location").collect()
    assert result == [("Asia", "A", 3.0, None, 20.0), ("Asia", "B", None, None, 5.0)]


def test_totals_are_null_only_when_all_values_are_missing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert flow_totals(df, ["flow", "empty"]).collect() == [(1044.0, None)]
    by_group = flow_totals(real_entities(df), ["stock", "flow"], ["continent"]).collect()
    assert by_group == [("Asia", 4.0, 45.0)]


def test_global_total_of_nothing_is_one_row(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).filter(F.lit(False))
    assert flow_totals(df, ["flow"]).collect() == [(None,)]


def test_peaks_combine_before_the_shuffle(spark, plan_of):
    plan = plan_of(entity_peaks(spark.createDataFrame(ROWS, SCHEMA), ["stock"]))
    assert "partial_max" in plan and plan.index("partial_max") > plan.index("Exchange")
