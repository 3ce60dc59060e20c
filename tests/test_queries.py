"""Every registered query against independent SQL, and properties of the plans."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check_oracle
import oracle
from panelytics.operators import entity_peaks, join_panels
from panelytics.plans import questions as q
from panelytics.sources import run_sql
from panelytics.sources.star_schema import build_outcomes, build_program


@pytest.fixture(scope="module")
def duck(sf_dir):
    return check_oracle.duck(sf_dir)


@pytest.mark.parametrize("name", list(entry.panel_queries()))
def test_equals_sql(spark, duck, sf_dir, name):
    assert check_oracle.compare(spark, duck, name, sf_dir) is None


def _is_ordered(name):
    tail = entry.oracle_sql()[name].rsplit(")", 1)[-1] if name != "d08_coverage_chart" else "ORDER BY"
    return "ORDER BY" in tail


@pytest.mark.parametrize("name", [name for name in entry.panel_queries() if _is_ordered(name)])
def test_rows_come_in_the_order_of_the_sql(spark, duck, sf_dir, name):
    df = entry.panel_queries()[name](spark, sf_dir)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert [tuple(row) for row in df.select(*columns).collect()] == cursor.fetchall()


def test_every_query_has_sql():
    assert set(entry.panel_queries()) == set(oracle.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() == 15


@pytest.mark.parametrize("name", list(entry.panel_queries()))
def test_plans_stay_in_the_engine(spark, sf_dir, plan_of, name):
    plan = plan_of(entry.panel_queries()[name](spark, sf_dir))
    for node in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoop", "SortAggregate"):
        assert node not in plan


def test_panel_builds_share_the_scan_of_the_raw_tables(spark, sf_dir, plan_of):
    for build in (build_outcomes, build_program):
        df = build(spark, sf_dir)
        df.collect()
        plan = plan_of(df)
        assert "SortAggregate" not in plan and "ReusedExchange" in plan.split("Initial Plan")[0]


def test_filters_and_columns_reach_the_scan(panels, plan_of):
    plan = plan_of(q.entity_peak_days(panels.outcomes, "NATION_15"))
    assert "EqualTo(location,NATION_15)" in plan
    assert re.search(r"ReadSchema: struct<location:string,date:date,new_cases:double,new_deaths:double>", plan)
    compared = plan_of(q.running_days(q.matched_doses(*panels, "unique"), ["NATION_1", "NATION_5"]))
    assert "In(location, [NATION_1,NATION_5])" in compared and "population" in compared


def test_unused_parts_of_a_summary_are_pruned(panels, plan_of):
    plan = plan_of(q.bottom_coverage(q.matched_peaks(*panels)))
    assert "life_expectancy" not in plan and "total_deaths" not in plan and "avg(" not in plan


def test_running_doses_sum_once(panels, plan_of):
    """One window, whose sum the rate reuses; each panel is scanned and joined once."""
    spark = panels.outcomes.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(q.running_days(q.matched_doses(*panels, "unique")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Window \[", plan)) == 1
    assert (plan.count("FileScan"), plan.count("SortMergeJoin")) == (2, 1)


def test_repeated_keys_are_refused_or_asked_for(panels):
    twice = panels.outcomes.unionByName(panels.outcomes)
    with pytest.raises(ValueError, match="repeat a key"):
        q.running_doses(twice, panels.program)
    one = q.running_doses(*panels, ["NATION_1"])
    both = q.running_doses(twice, panels.program, ["NATION_1"], repeated_keys="join")
    assert both.count() == 2 * one.count()


def test_the_profile_reads_each_table_once(panels):
    df = entry.compare_profiles({"a": panels.outcomes, "b": panels.program})
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") == 2


ROLLUP_SENSITIVE = {
    "totals": lambda o, p: q.global_totals(o),
    "cases": lambda o, p: q.top_cases(q.country_peaks(o)),
    "groups": lambda o, p: q.totals_by_group(o),
    "fatality": lambda o, p: q.top_fatality(q.country_peaks(o), 1000),
    "daily": lambda o, p: q.daily_series(q.daily_totals(o)),
    "coverage": lambda o, p: q.top_coverage(q.matched_peaks(o, p)),
    "tests": lambda o, p: q.top_positive_rate(q.matched_peaks(o, p)),
    "model": lambda o, p: q.model_table(q.matched_peaks(o, p)),
}


@pytest.mark.parametrize("name", list(ROLLUP_SENSITIVE))
def test_rollup_rows_would_change_the_answer(panels, monkeypatch, name):
    right = ROLLUP_SENSITIVE[name](*panels).collect()
    monkeypatch.setattr(q, "real_entities", lambda df: df)
    assert ROLLUP_SENSITIVE[name](*panels).collect() != right


def test_countries_and_groups_add_up(panels):
    by_group = q.totals_by_group(panels.outcomes).agg(F.sum("total_cases"), F.sum("total_deaths")).first()
    total = q.global_totals(panels.outcomes).first()
    assert tuple(by_group) == (total["total_cases"], total["total_deaths"])


def test_peaks_do_not_depend_on_row_order(panels):
    shuffled = panels.outcomes.orderBy(F.hash("date", "iso_code")).repartition(5)
    keys = ["continent", "location"]
    assert sorted(map(str, entity_peaks(shuffled, ["total_cases"], keys=keys).collect())) == sorted(
        map(str, entity_peaks(panels.outcomes, ["total_cases"], keys=keys).collect())
    )


def test_reports_survive_a_csv_round_trip(spark, panels, tmp_path):
    from panelytics.plans.raw_tables import _as_raw_text
    from panelytics.plans.workflow import load, reports, run
    from panelytics.sources import export

    for panel, name in zip(panels, ("covid-deaths.csv", "covid-vaccinations.csv")):
        export(_as_raw_text(panel), str(tmp_path / "in" / name), "csv")
    options = {"focus": "NATION_15", "compared": ["NATION_1", "NATION_5"]}
    direct = reports(*panels, **options)
    loaded = reports(*load(spark, str(tmp_path / "in")), **options)
    for name in direct:
        if not name.startswith(("correlations", "chart_corr", "missing", "profile")):
            assert sorted(map(str, loaded[name]().collect())) == sorted(map(str, direct[name]().collect())), name
    assert run_sql(spark, "SELECT count(*) FROM covid_vaccinations").first()[0] == panels.program.count()
    some = ["top_cases", "top_deaths", "correlations", "peak_case_days"]
    assert run(spark, str(tmp_path / "in"), str(tmp_path / "out"), only=some, **options) == some
    for name in ("top_cases", "top_deaths", "peak_case_days"):
        again = spark.read.parquet(str(tmp_path / "out" / name))
        assert sorted(map(str, again.collect())) == sorted(map(str, direct[name]().collect()))
    assert sorted(p.name for p in (tmp_path / "out" / "summaries").iterdir()) == [
        "country_peaks",
        "daily_totals",
        "matched_peaks",
    ]
    doses = ["running_doses", "running_doses_compared", "running_doses_tail", "chart_running_lines"]
    assert run(spark, str(tmp_path / "in"), str(tmp_path / "doses"), only=doses, cluster_by=["location"], **options) == doses
    assert [p.name for p in (tmp_path / "doses" / "summaries").iterdir()] == ["matched_doses"]


def test_repeated_keys_are_refused_on_request(spark, tmp_path):
    from panelytics.contract import OUTCOMES_COLUMNS, PROGRAM_COLUMNS
    from panelytics.plans.workflow import load

    for name, columns in (("deaths.csv", OUTCOMES_COLUMNS), ("vacc.csv", PROGRAM_COLUMNS)):
        row = ",".join({"iso_code": "X", "date": "1/1/2021"}.get(c, "") for c in columns)
        (tmp_path / name).write_text(",".join(columns) + f"\n{row}\n{row}\n")
    outcomes, _ = load(spark, str(tmp_path))
    assert outcomes.count() == 2
    with pytest.raises(ValueError, match="repeat a key"):
        load(spark, str(tmp_path), require_unique_keys=True)


def test_missing_required_column_is_named(spark, tmp_path):
    from panelytics.plans.workflow import load

    (tmp_path / "deaths.csv").write_text("iso_code,date\nX,1/1/2021\n")
    with pytest.raises(ValueError, match="population"):
        load(spark, str(tmp_path))


def test_rounding_rule_of_the_sql():
    assert oracle.rounded("x", 3) == "CAST(round(CAST(x AS DECIMAL(38,10)), 3) AS DOUBLE)"


def _two_panels(folder, dates):
    from panelytics.contract import OUTCOMES_COLUMNS, PROGRAM_COLUMNS

    fixed = {"iso_code": "X", "continent": "Asia", "location": "Xland", "population": "1000", "new_cases": "10"}
    fixed |= {"new_deaths": "1", "new_vaccinations": "5"}
    for name, columns in (("deaths.csv", OUTCOMES_COLUMNS), ("vacc.csv", PROGRAM_COLUMNS)):
        rows = [",".join((fixed | {"date": date}).get(c, "") for c in columns) for date in dates]
        (folder / name).write_text("\n".join([",".join(columns), *rows]) + "\n")


def test_two_digit_years_answer_questions(spark, tmp_path):
    from panelytics.plans.workflow import load

    _two_panels(tmp_path, [f"1/{i}/20" for i in range(1, 9)])
    outcomes, program = load(spark, str(tmp_path))
    assert q.daily_series(q.daily_totals(outcomes)).count() == 8
    running = q.running_doses(outcomes, program).collect()
    assert [r["rolling_vaccination_doses"] for r in running] == [5.0 * i for i in range(1, 9)]


@pytest.mark.parametrize("stored", [False, True])
def test_unread_dates_are_reported_or_refused(spark, tmp_path, stored):
    from panelytics.plans.workflow import load

    _two_panels(tmp_path, ["1/1/20", "soon", "", "NA"])
    store = str(tmp_path / "store") if stored else None
    with pytest.warns(UserWarning, match="covid_deaths: 1 dates .* 'soon'"):
        outcomes, _ = load(spark, str(tmp_path), store)
    assert outcomes.filter("date IS NULL").count() == 3
    with pytest.raises(ValueError, match="soon"):
        load(spark, str(tmp_path), store, unread_dates="refuse")


def test_bucketed_panels_join_without_a_shuffle(spark, sf_dir, plan_of):
    from panelytics.plans import raw_tables

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = plan_of(join_panels(*raw_tables._bucketed_panels(spark, sf_dir)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in joined and "Exchange" not in joined


def test_reports_read_their_summary_and_not_the_panels(spark, sf_dir, plan_of, panels):
    """Six scans, all of the two stored summaries."""
    from panelytics.plans import raw_tables

    df = raw_tables.shared_summary_reports(spark, sf_dir)
    scans = [line for line in plan_of(df).splitlines() if "FileScan parquet" in line]
    assert len(scans) == 6
    read = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    assert read == {"country_peaks", "matched_peaks"}


def test_folded_doses_equal_those_of_all_joined_rows(spark):
    outcomes, program = [], []
    for i in range(40):
        day = dt.date(2021, 1, 1) + dt.timedelta(days=i)
        outcomes += [("X", day, "Asia", "E", 100.0)] * (i % 4) + [("Y", day, "Asia", "E", 50.0)] * (i % 3)
        program += [("X", day, None if (i + k) % 5 == 0 else float(i + k)) for k in range(i % 3 + 1)] + [("Y", day, 1.0)] * 2
    keys = "iso_code string, date date"
    left = spark.createDataFrame(outcomes, f"{keys}, continent string, location string, population double")
    right = spark.createDataFrame(program, f"{keys}, new_vaccinations double")
    joined = q.matched_doses(left, right, "join").groupBy("iso_code", "date").agg({"new_vaccinations": "sum"})
    folded = q.matched_doses(left, right, "fold")
    assert sorted(joined.collect(), key=str) == sorted(folded.select("iso_code", "date", "new_vaccinations").collect(), key=str)
    last = q.running_days(folded).agg({"rolling_vaccination_doses": "max"}).first()[0]
    assert last == q.running_days(q.matched_doses(left, right, "join")).agg({"rolling_vaccination_doses": "max"}).first()[0]
