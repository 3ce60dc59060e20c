"""The end-to-end job: CSV panels in; profile, SQL tables, answers and chart data out."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from panelytics.contract import (
    COMPARED_ENTITIES,
    FOCUS_ENTITY,
    OUTCOMES_COLUMNS,
    OUTCOMES_KEYWORD,
    OUTCOMES_TABLE,
    PROGRAM_COLUMNS,
    PROGRAM_KEYWORD,
    PROGRAM_TABLE,
)
from panelytics.operators.clean import clean_panel
from panelytics.operators.profile import assert_unique_keys, compare_profiles, coverage, missingness, rollup_labels
from panelytics.plans import questions as q
from panelytics.sources.csv_panels import read_csv_panel
from panelytics.sources.sinks import export, write_panel
from panelytics.sources.tables import register


_UNREAD = "_unread_date"


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"{name} lacks columns the questions need: {absent}")
    return df


def load(
    spark: SparkSession,
    root: str,
    store: str | None = None,
    cluster_by: Sequence[str] = (),
    require_unique_keys: bool = False,
    unread_dates: str = "report",
    buckets: int | None = None,
    **reader,
) -> tuple[DataFrame, DataFrame]:
    """Find, read, clean and register both panels; optionally refuse panels with repeated keys.

    With ``store`` the typed panels are first written there as Parquet (see ``write_panel``), so that text is parsed
    once rather than in every query; with ``buckets`` they are also saved as catalog tables bucketed by their key, and
    joined without a shuffle. ``unread_dates``: dates present that no layout reads become missing; "report" warns of
    their number and an example, "refuse" raises, "ignore" doesn't count them. With ``store`` they are counted while
    writing, else by a pass over the files that also finds rows with surplus cells, and queries then split off only the
    cells they ask for.
    """
    if unread_dates not in ("report", "refuse", "ignore"):
        raise ValueError(f"unknown choice for unread dates: {unread_dates}")
    panels = []
    for keyword, name, columns in (
        (OUTCOMES_KEYWORD, OUTCOMES_TABLE, OUTCOMES_COLUMNS),
        (PROGRAM_KEYWORD, PROGRAM_TABLE, PROGRAM_COLUMNS),
    ):
        panel = clean_panel(read_csv_panel(spark, root, keyword, **reader), unread=_UNREAD)
        panel = require_columns(panel, columns, name)
        unread = [F.count(_UNREAD).alias("n"), F.min(_UNREAD).alias("example")]
        if store is not None:
            seen = Observation()
            written = panel.observe(seen, *unread).drop(_UNREAD) if unread_dates != "ignore" else panel.drop(_UNREAD)
            typed = write_panel(written, f"{store.rstrip('/')}/{name}", cluster_by)
            found = seen.get if unread_dates != "ignore" else {"n": 0}
        else:
            typed, found = panel.drop(_UNREAD), {"n": 0}
            if unread_dates != "ignore":
                found = panel.agg(*unread).first().asDict()
                # that pass has split every row into all its cells; queries needn't
                typed = clean_panel(read_csv_panel(spark, root, keyword, checked=False, **reader))
        if found["n"]:
            text = f"{name}: {found['n']} dates can't be read and are missing, such as {found['example']!r}"
            if unread_dates == "refuse":
                raise ValueError(text)
            warnings.warn(text, stacklevel=2)
        if require_unique_keys:
            assert_unique_keys(typed)
        panels.append(register(typed, name, persistent=bool(buckets), buckets=buckets))
    return panels[0], panels[1]


def reports(
    outcomes: DataFrame,
    program: DataFrame,
    focus: str = FOCUS_ENTITY,
    compared: Sequence[str] = COMPARED_ENTITIES,
    store: str | None = None,
    unique_keys: bool = False,
) -> dict[str, Callable[[], DataFrame]]:
    """Every report by name, each a plan to be built on demand. ``unique_keys``: see ``questions.matched_peaks``.

    With ``store`` the summaries that several reports share are computed once, when first needed, and kept there.
    """
    o, p = outcomes, program
    keys = "unique" if unique_keys else "refuse"

    def shared(name: str, summary: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
        if store is None:
            return summary
        return cache(lambda: write_panel(summary(), f"{store.rstrip('/')}/{name}"))

    peaks = shared("country_peaks", lambda: q.country_peaks(o))
    daily = shared("daily_totals", lambda: q.daily_totals(o))
    matched = shared("matched_peaks", lambda: q.matched_peaks(o, p, unique_keys))
    doses = shared("matched_doses", lambda: q.matched_doses(o, p, keys))
    return {
        "profile": lambda: compare_profiles({OUTCOMES_TABLE: o, PROGRAM_TABLE: p}),
        "rollup_labels": lambda: rollup_labels(o),
        "missing_outcomes": lambda: missingness(o),
        "missing_program": lambda: missingness(p),
        "coverage": lambda: coverage(o),
        "global_totals": lambda: q.global_totals(o),
        "top_cases": lambda: q.top_cases(peaks()),
        "top_infection_rate": lambda: q.top_infection_rate(peaks()),
        "top_deaths": lambda: q.top_deaths(peaks()),
        "totals_by_group": lambda: q.totals_by_group(o),
        "top_fatality": lambda: q.top_fatality(peaks()),
        "daily_series": lambda: q.daily_series_smoothed(daily()),
        "peak_case_days": lambda: q.peak_days(daily(), "new_cases"),
        "peak_death_days": lambda: q.peak_days(daily(), "new_deaths"),
        "top_coverage": lambda: q.top_coverage(matched()),
        "bottom_coverage": lambda: q.bottom_coverage(matched()),
        "running_doses": lambda: q.running_days(doses()),
        "running_doses_compared": lambda: q.running_days(doses(), compared),
        "running_doses_tail": lambda: q.running_days_tail(doses(), compared),
        "top_positive_rate": lambda: q.top_positive_rate(matched()),
        "entity_summary": lambda: q.entity_summary(o, p, focus),
        "entity_peak_days": lambda: q.entity_peak_days(o, focus),
        "entity_daily": lambda: q.entity_daily_smoothed(o, focus),
        "model_table": lambda: q.model_table(matched()),
        "correlations": lambda: q.correlations(matched()),
        "chart_daily_lines": lambda: q.daily_lines(daily()),
        "chart_coverage_bars": lambda: q.coverage_bars(matched()),
        "chart_running_lines": lambda: q.running_lines(doses(), compared),
        "chart_entity_lines": lambda: q.entity_lines(o, focus),
        "chart_correlation_cells": lambda: q.correlation_cells(matched()),
    }


def run(
    spark: SparkSession,
    root: str,
    output: str,
    fmt: str = "parquet",
    only: Sequence[str] = (),
    require_unique_keys: bool = False,
    cluster_by: Sequence[str] = (),
    buckets: int | None = None,
    unread_dates: str = "report",
    all_matches: bool = False,
    **options,
) -> list[str]:
    """Load the panels below ``root`` and write every report (or those in ``only``) below ``output``.

    The layout options are those of ``load``. Reports on running doses need unique keys: without
    ``require_unique_keys`` they check for themselves and raise.
    """
    output = output.rstrip("/")
    outcomes, program = load(
        spark,
        root,
        f"{output}/panels",
        cluster_by,
        require_unique_keys,
        unread_dates,
        buckets,
        all_matches=all_matches,
    )
    available = reports(
        outcomes, program, store=f"{output}/summaries", unique_keys=require_unique_keys, **options
    )
    names = list(only) or list(available)
    for name in names:
        export(available[name](), f"{output}/{name}", fmt)
    return names
