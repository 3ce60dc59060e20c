from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelytics.contract import DATE_FORMATS, ISO, MISSING_TOKENS
from panelytics.functions import nan_to_null, parse_date, parse_number
from panelytics.operators import clean_panel, iso_dates, missingness, normalise_names


def _parsed(spark, parse, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [row[1] for row in sorted(df.select("i", parse(F.col("t"))).collect())]


def test_names_are_trimmed_and_lowered(spark):
    assert normalise_names(spark.createDataFrame([(1, 2)], [" ISO_Code ", "Date"])).columns == ["iso_code", "date"]


def test_colliding_names_are_refused(spark):
    with pytest.raises(ValueError, match="collide"):
        normalise_names(spark.createDataFrame([(1, 2)], ["A", " a "]))


@pytest.mark.parametrize(
    "text,day",
    [
        ("1/3/2020", dt.date(2020, 1, 3)),
        ("01/03/2020", dt.date(2020, 1, 3)),
        ("12/31/2020", dt.date(2020, 12, 31)),
        ("2020-01-03", dt.date(2020, 1, 3)),
        ("2020-1-3", dt.date(2020, 1, 3)),
        ("13/01/2020", dt.date(2020, 1, 13)),
        (" 1/3/2020 ", dt.date(2020, 1, 3)),
        ("2/29/2020", dt.date(2020, 2, 29)),
        ("2/30/2020", None),
        ("nan", None),
        ("", None),
        ("x", None),
        ("1/3/20", dt.date(2020, 1, 3)),
        ("12/31/21", dt.date(2021, 12, 31)),
        ("1/3/68", dt.date(2068, 1, 3)),
        ("1/3/69", dt.date(1969, 1, 3)),
        ("20200103", dt.date(2020, 1, 3)),
        ("2020/01/03", dt.date(2020, 1, 3)),
        ("01-03-2020", dt.date(2020, 1, 3)),
        ("Jan 3, 2020", dt.date(2020, 1, 3)),
        ("3 Jan 2020", dt.date(2020, 1, 3)),
        ("3-Jan-20", dt.date(2020, 1, 3)),
        ("3-JAN-20", dt.date(2020, 1, 3)),
        ("January 3, 2020", dt.date(2020, 1, 3)),
        ("1/3/2020 0:00", dt.date(2020, 1, 3)),
        ("2020-01-03 00:00:00", dt.date(2020, 1, 3)),
        (None, None),
    ],
)
def test_dates(spark, text, day):
    assert _parsed(spark, parse_date, [text]) == [day]


def test_numbers(spark):
    cases = {
        " 12 ": 12.0,
        "+5": 5.0,
        "-5": -5.0,
        "1e3": 1000.0,
        ".5": 0.5,
        "1.": 1.0,
        "inf": math.inf,
        "-Infinity": -math.inf,
        "1,234": None,
        "abc": None,
        "0x10": None,
        "0x1p3": None,
        "True": None,
        "1_000": None,
        "1d": None,
        "1f": None,
        "1.5D ": None,
        "1d\t": None,
        "1e999f": None,
        "infinite": None,
        "inf1d": None,
        " +Infinity ": math.inf,
        "": None,
        "NaN": None,
        "-nan": None,
    }
    assert _parsed(spark, lambda t: nan_to_null(parse_number(t)), list(cases)) == list(cases.values())


def test_every_missing_token_is_null_in_text_and_number_columns(spark):
    rows = [(token, token, token) for token in MISSING_TOKENS]
    cleaned = clean_panel(spark.createDataFrame(rows, "continent string, date string, new_cases string"))
    assert {tuple(row) for row in cleaned.collect()} == {(None, None, None)}


def test_whole_panel(spark):
    raw = spark.createDataFrame(
        [
            ("X", "Asia", "NA in text", "1/2/2021", "7", "extra"),
            ("Y", "NA", "null", "2021-01-03", "NaN", "1.5"),
        ],
        [" ISO_CODE", "Continent", "location ", "DATE", "new_cases", "something_else"],
    )
    cleaned = clean_panel(raw)
    assert dict(cleaned.dtypes) == {
        "iso_code": "string",
        "continent": "string",
        "location": "string",
        "date": "date",
        "new_cases": "double",
        "something_else": "double",
    }
    assert sorted(map(tuple, cleaned.collect())) == [
        ("X", "Asia", "NA in text", dt.date(2021, 1, 2), 7.0, None),
        ("Y", None, None, dt.date(2021, 1, 3), None, 1.5),
    ]


def test_names_with_special_characters(spark):
    raw = spark.createDataFrame([("1", "x")], ["share. of `all`", "tests_units"])
    cleaned = clean_panel(raw)
    assert cleaned.collect() == [(1.0, "x")]
    assert missingness(cleaned).count() == 2


def test_typed_input_is_accepted(spark):
    typed = spark.createDataFrame(
        [("X", dt.date(2021, 1, 2), 3, float("nan"))], "iso_code string, date date, a int, b double"
    )
    assert clean_panel(typed).collect() == [("X", dt.date(2021, 1, 2), 3.0, None)]


def test_cleaning_is_one_projection_without_python(spark, plan_of):
    raw = spark.createDataFrame([("X", "1/2/2021", "1")], "iso_code string, date string, n string")
    plan = plan_of(clean_panel(raw))
    assert "EvalPython" not in plan and "Exchange" not in plan


def test_iso_text(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 2),), (None,)], "date date")
    assert [row[0] for row in iso_dates(df).collect()] == ["2021-01-02", None]


def _tried_one_by_one(text, formats=DATE_FORMATS):
    """The first layout that reads the text, each tried on every text."""

    def read(layout):
        if layout == ISO:
            return F.trim(text).try_cast("date")
        day = F.try_to_date(F.trim(text), layout)
        if "yy" in layout.replace("yyyy", ""):
            return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        return day

    return F.coalesce(*map(read, formats))


def test_layouts_chosen_by_shape_read_what_trying_all_reads(spark):
    rng = random.Random(4)
    days = [dt.date(1960, 1, 1) + dt.timedelta(days=rng.randint(0, 40_000)) for _ in range(60)]
    rows = [(day, layout) for layout in DATE_FORMATS if layout != ISO for day in days]
    texts = F.lit(None).cast("string")
    for layout in DATE_FORMATS:
        texts = F.when(F.col("layout") == layout, F.date_format("day", "yyyy-MM-dd" if layout == ISO else layout)).otherwise(texts)
    made = [r[0] for r in spark.createDataFrame(rows, "day date, layout string").select(texts).collect()]
    odd = ["0/1/2020", "001/002/2020", "13/13/2020", "2/30/2020", "31/4/2020", "1//2020", "2020-13-01", "2020-02-30", "2020", "2020-05",
           "2020-01-03T00:00Z", "2020-01-03 noon", "-2020-01-03", "99999-01-01", "20201301", "2020010", "Jnu 3, 2020", "may 3, 2020",
           "Mayy 3 2020", "3 may 99", "soon", "day 17", "1/2/2020 25:00", "1/2/2020 7:5", "1.2.2020", "30.2.2020", "２/3/2020", "", " ", "/"]
    for _ in range(1500):
        text = rng.choice(made)
        at = rng.randrange(len(text))
        odd.append(text[:at] + rng.choice(["", "0", "1", "9", "/", "-", " ", "x", text[at] * 2]) + text[at + 1 :])
    df = spark.createDataFrame([(t,) for t in [*made, *odd]], "t string")
    got = df.select("t", parse_date(F.col("t")).cast("string").alias("got"), _tried_one_by_one(F.col("t")).cast("string").alias("want"))
    # a doubled hyphen is no year before Christ
    want = F.when(~F.col("want").startswith("-") | F.col("t").startswith("-"), F.col("want"))
    assert [tuple(r) for r in got.where(~F.col("got").eqNullSafe(want)).collect()] == []
    assert got.where("got is not null").count() > len(made)


def test_weekdays_and_dots(spark):
    texts = ["Fri, Jan 3, 2020", "friday 2020-01-03", "Thurs. 1/2/2020", "2020.1.3", "Sun", "Monday soon"]
    want = [dt.date(2020, 1, 3), dt.date(2020, 1, 3), dt.date(2020, 1, 2), dt.date(2020, 1, 3), None, None]
    assert _parsed(spark, parse_date, texts) == want


def test_layouts_of_unknown_parts_keep_their_place(spark):
    texts = ["2020-003", "1/2/2020", "2020w", "x2020-01-02"]
    formats = ("yyyy-DDD", "M/d/yyyy", "yyyy'w'", "'x'yyyy-MM-dd")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(parse_date(F.col("t"), formats)).collect()]
    assert got == [r[0] for r in df.select(_tried_one_by_one(F.col("t"), formats)).collect()]
    assert got[0] == dt.date(2020, 1, 3) and got[3] == dt.date(2020, 1, 2)
