from __future__ import annotations

import datetime as dt

import pytest

from panelytics.operators import (
    assert_unique_keys,
    compare_profiles,
    coverage,
    duplicate_keys,
    missingness,
    rollup_labels,
    shape,
    table_profile,
)

D1, D2 = dt.date(2021, 1, 1), dt.date(2021, 1, 2)
SCHEMA = "iso_code string, continent string, location string, date date, n double"
ROWS = [
    ("X", "Asia", "Xland", D1, 1.0),
    ("X", "Asia", "Xland", D1, None),
    ("X", "Asia", "Xland", D1, float("nan")),
    (None, "Asia", None, D2, 4.0),
    (None, "Asia", "Yland", D2, 5.0),
    ("OWID_W", None, "World", D2, 6.0),
    ("OWID_A", None, "Asia", None, 7.0),
    ("OWID_W", None, "World", D1, 7.0),
]


@pytest.fixture
def panel(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_missing_key_values_equal_each_other(panel):
    assert duplicate_keys(panel).first()[0] == 3


def test_unique_key_check(panel):
    with pytest.raises(ValueError, match="3 rows"):
        assert_unique_keys(panel)
    unique = panel.dropDuplicates(["iso_code", "date"])
    assert assert_unique_keys(unique) is unique


def test_coverage(panel):
    assert coverage(panel).first().asDict() == {
        "rows": 8,
        "iso_codes": 3,
        "locations": 4,
        "start_date": D1,
        "end_date": D2,
        "aggregate_rows": 3,
    }


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert coverage(empty).collect() == [(0, 0, 0, None, None, None)]
    assert table_profile(empty, "t").collect() == [("t", 0, 5, 0, 0, None, None, 0)]
    assert shape(empty).collect() == [(0, 5)]
    assert {row["missing_pct"] for row in missingness(empty).collect()} == {None}


def test_profiles_of_two_tables(panel):
    rows = compare_profiles({"a": panel, "b": panel.limit(0)}).collect()
    assert [tuple(row) for row in rows] == [("a", 8, 5, 4, 2, D1, D2, 3), ("b", 0, 5, 0, 0, None, None, 0)]


def test_labels_of_rollup_rows(panel):
    assert [row[0] for row in rollup_labels(panel).collect()] == ["Asia", "World"]


def test_missing_shares_worst_first_with_name_as_tie_break(panel):
    assert [tuple(row) for row in missingness(panel).collect()] == [
        ("continent", 37.5),
        ("iso_code", 25.0),
        ("n", 25.0),
        ("date", 12.5),
        ("location", 12.5),
    ]
    assert missingness(panel, 2).count() == 2
    assert missingness(panel, None).count() == 5


def test_missingness_reads_the_table_once(panels, plan_of):
    plan = plan_of(missingness(panels.outcomes))
    assert plan.count("FileScan") == 1


def test_distinct_counts_do_not_multiply_the_panel(panels, plan_of):
    """The rows Spark fans out per distinct count are those of the grouped result, above the first shuffle."""
    plan = plan_of(coverage(panels.outcomes))
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.rindex("Exchange hashpartitioning(iso_code")
