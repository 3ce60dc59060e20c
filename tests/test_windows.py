from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelytics.operators import running_total, trailing_mean, windows

SCHEMA = "location string, iso_code string, date date, x double, y double"
START = dt.date(2020, 11, 20)


def _rows(series):
    """One location per series; days may be skipped and two codes may share a location and day."""
    rows = []
    for i, days in enumerate(series):
        for gap, code, x in days:
            day = (rows[-1][2] if rows and rows[-1][0] == f"L{i}" else START) + dt.timedelta(days=gap)
            rows.append((f"L{i}", code, day, x, None if x is None else x * 2))
    return list({(r[0], r[1], r[2]): r for r in rows}.values())


def _by_entity(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault(row[0], []).append(row)
    return groups


def _expected(rows, n):
    out = {}
    for group in _by_entity(rows).values():
        total = 0.0
        for i, (loc, code, day, x, _) in enumerate(group):
            total += x or 0.0
            last = [r[3] for r in group[max(0, i - n + 1) : i + 1]]
            mean = sum(last) / n if len(last) == n and None not in last else None
            out[(loc, code, day)] = (total, mean, None if mean is None else mean * 2)
    return out


def _check(spark, rows, chunk, n):
    df = spark.createDataFrame(rows, SCHEMA)
    order = ["date", "iso_code"]
    total = running_total(df, "x", "total", order=order, chunk=chunk)
    last = chunk[-1] if isinstance(chunk, tuple) else chunk
    means = trailing_mean(total, ["x", "y"], order=order, n=n, chunk=last)
    assert means.columns == [*df.columns, "total", f"x_{n}d", f"y_{n}d"]
    got = {(r["location"], r["iso_code"], r["date"]): tuple(r)[5:] for r in means.collect()}
    assert got == _expected(rows, n)


CHUNKS = [None, "week", "month", "year", ("year", "month"), ("quarter", "month", "day")]


@pytest.mark.parametrize("chunk", CHUNKS)
@pytest.mark.parametrize("n", [1, 2, 7])
def test_many_random_series(spark, chunk, n):
    rng = random.Random(f"{chunk}{n}")
    series = [
        [
            (rng.choice([0, 1, 1, 1, 2, 40]), rng.choice("ab"), rng.choice([None, *map(float, range(9))]))
            for _ in range(rng.randint(1, 40))
        ]
        for _ in range(60)
    ]
    _check(spark, _rows(series), chunk, n)


_DAY = st.tuples(st.integers(0, 45), st.sampled_from("ab"), st.none() | st.integers(-50, 50).map(float))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(series=st.lists(st.lists(_DAY, min_size=1, max_size=25), min_size=1, max_size=4), chunk=st.sampled_from(CHUNKS))
def test_any_series(spark, series, chunk):
    _check(spark, _rows(series), chunk, 3)


@pytest.mark.parametrize("chunk", [None, "week"])
def test_trailing_mean_around_a_gap(spark, chunk):
    values = [float(i) if i != 9 else None for i in range(1, 19)]
    rows = [("L", "a", START + dt.timedelta(days=i), v, v) for i, v in enumerate(values)]
    df = trailing_mean(spark.createDataFrame(rows, SCHEMA), ["x"], chunk=chunk).orderBy("date")
    means = [row["x_7d"] for row in df.collect()]
    assert means == [None] * 6 + [4.0, 5.0] + [None] * 7 + [13.0, 14.0, 15.0]


@pytest.mark.parametrize("chunk", [None, "month"])
def test_series_without_entity(spark, chunk):
    rows = [("L", "a", START + dt.timedelta(days=i), float(i), 0.0) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).select("date", "x")
    out = trailing_mean(running_total(df, "x", "t", entity=(), chunk=chunk), ["x"], entity=(), chunk=chunk)
    last = out.orderBy(F.desc("date")).first()
    assert (last["t"], last["x_7d"]) == (sum(range(50)), 46.0)


def test_missing_entity_and_time_form_groups_of_their_own(spark):
    rows = [(None, "a", START, 1.0, 0.0), (None, "a", START + dt.timedelta(days=40), 2.0, 0.0), ("L", "a", None, 4.0, 0.0)]
    rows.append(("L", "a", START, 8.0, 0.0))
    df = spark.createDataFrame(rows, SCHEMA)
    plain = running_total(df, "x", "t").select("location", "date", "t").collect()
    chunked = running_total(df, "x", "t", chunk="month").select("location", "date", "t").collect()
    assert sorted(map(str, plain)) == sorted(map(str, chunked))
    assert {row["t"] for row in chunked} == {1.0, 3.0, 4.0, 12.0}


def test_hot_entity_is_split_over_tasks(spark):
    """An entity with nearly all rows: no window task may see more than its busiest chunk plus carried rows."""
    days = spark.range(4000).select(
        F.when(F.col("id") < 3900, "hot").otherwise(F.concat(F.lit("L"), F.col("id") % 50)).alias("location"),
        F.lit("a").alias("iso_code"),
        F.date_add(F.lit("2000-01-01"), F.col("id").cast("int")).alias("date"),
        F.lit(1.0).alias("x"),
    )
    out = running_total(days, "x", "t", chunk="month")
    assert out.filter("location = 'hot'").agg(F.max("t"), F.count("t")).first() == (3900.0, 3900)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(location" in plan and "_chunk" in plan.split("hashpartitioning(location")[1][:40]


@pytest.mark.parametrize("name", ["running_value_by_event_type", "trailing_value_by_event_type"])
def test_one_day_of_an_event_type_spreads_over_tasks(spark, sf_dir, name):
    from panelytics.plans import raw_tables

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        out = getattr(raw_tables, name)(spark, sf_dir)
        value = F.col(out.columns[-1])  # asked for, as Spark leaves out a window that isn't
        out = out.withColumn("task", F.spark_partition_id() + F.coalesce(value * 0, F.lit(0)).cast("int"))
        tasks = out.groupBy("event_type", F.to_date("ts").alias("day")).agg(
            F.count_distinct("task").alias("n"), F.count("*").alias("events")
        )
        assert tasks.where("events >= 20").agg(F.min("n")).first()[0] > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_totals_without_an_entity_in_nested_units(spark):
    rows = [("L", "a", START + dt.timedelta(days=i), float(i), 0.0) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA).select("date", "x")
    out = running_total(df, "x", "t", entity=(), chunk=("year", "month")).orderBy("date")
    assert [r["t"] for r in out.collect()] == [sum(range(i + 1)) for i in range(90)]


def test_halo_rows_are_limited_before_their_shuffle(spark, plan_of):
    df = spark.createDataFrame([("L", "a", START, 1.0, 1.0)], SCHEMA)
    plan = plan_of(trailing_mean(df, ["x"], chunk="month"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_last_running_value_is_the_sum(panels):
    o = panels.outcomes
    totals = running_total(o, "new_cases", "t", order=["date", "iso_code"], chunk="month")
    last = totals.groupBy("location").agg(F.max("t").alias("t"), F.sum("new_cases").alias("s"))
    assert last.filter("t <> s").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7])
@pytest.mark.parametrize("block", [1, 5, 1 << 16])
def test_spread_windows_equal_plain_ones(spark, monkeypatch, n, block):
    monkeypatch.setattr(windows, "BLOCK_ROWS", block)
    rng = random.Random(f"{n}{block}")
    series = [
        [
            (rng.choice([0, 1, 1, 1, 2, 40]), rng.choice("ab"), rng.choice([None, *map(float, range(9))]))
            for _ in range(rng.choice([1, 2, 5, 300]))
        ]
        for _ in range(25)
    ]
    rows = _rows(series)
    order = ["date", "iso_code"]
    total = running_total(spark.createDataFrame(rows, SCHEMA).repartition(5), "x", "total", order=order, spread=True)
    means = trailing_mean(total, ["x", "y"], order=order, n=n, spread=True)
    assert means.columns == ["location", "iso_code", "date", "x", "y", "total", f"x_{n}d", f"y_{n}d"]
    got = {(r["location"], r["iso_code"], r["date"]): tuple(r)[5:] for r in means.collect()}
    assert got == _expected(rows, n)


def test_one_instant_with_all_rows_is_spread(spark, plan_of):
    """No window over more than a range or block, and the input is read by one scan."""
    rows = spark.range(4000).select(
        F.lit(None).cast("string").alias("location"), F.lit(START).alias("date"), F.col("id").alias("iso_code"), F.lit(1.0).alias("x")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        total = running_total(rows, "x", "t", order=["date", "iso_code"], spread=True)
        assert total.agg(F.min(F.col("t") - F.col("iso_code")), F.max(F.col("t") - F.col("iso_code"))).first() == (1.0, 1.0)
        tasks = total.groupBy(F.spark_partition_id() + (F.col("t") * 0).cast("int")).count().collect()
        assert len(tasks) > 1 and max(r["count"] for r in tasks) < 4000
        assert plan_of(total).count("FileScan parquet") == 2  # the stored ranges and their totals
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_spread_without_an_entity_or_rows(spark):
    df = spark.range(100).select(F.col("id").alias("date"), (F.col("id") * 1.0).alias("x")).repartition(4)
    out = running_total(df, "x", "t", entity=(), spread=True).orderBy("date")
    assert [r["t"] for r in out.collect()] == [sum(range(i + 1)) for i in range(100)]
    empty = spark.createDataFrame([], SCHEMA)
    assert trailing_mean(running_total(empty, "x", "t", spread=True), ["x"], spread=True).collect() == []
