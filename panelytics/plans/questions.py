"""The question catalogue over the outcomes panel and the program panel.

Every function returns a lazy DataFrame. Cumulative metrics are reduced by their maximum, daily metrics by their
sum, and rows without a group (pre-aggregated roll-ups) never enter a ranking or a total.

Rankings take one of three summaries, each one pass over the panels: ``country_peaks``, ``daily_totals`` and
``matched_peaks``. Build a summary inline for a single question (columns it does not need are pruned from the scan), or
store it once and ask several.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelytics.contract import (
    CODE,
    CORRELATED_COLUMNS,
    COVERAGE_MIN_POPULATION,
    COVERAGE_SIZE,
    ENTITY,
    FATALITY_MIN_CASES,
    FOCUS_ENTITY,
    GROUP,
    KEYS,
    PEAK_DAYS,
    RANKING_SIZE,
    RATE_MIN_POPULATION,
    TIME,
)
from panelytics.functions.measures import pct, rate, scaled, whole
from panelytics.operators.corr import corr_matrix, corr_pairs
from panelytics.operators.joins import join_panels, join_summaries, joined_peaks
from panelytics.operators.profile import assert_unique_keys
from panelytics.operators.rank import bottom_k, ordered, tail, top_k
from panelytics.operators.reshape import to_series
from panelytics.operators.rollup import entity_peaks, flow_totals, real_entities
from panelytics.operators.windows import running_total, trailing_mean

OUTCOME_PEAKS = ["population", "total_cases", "total_deaths"]
DAILY_FLOWS = ["new_cases", "new_deaths"]
DAILY_MEANS = ["new_cases_7d", "new_deaths_7d"]
DOSES = ["people_vaccinated", "people_fully_vaccinated", "total_boosters"]
ATTRIBUTES = [
    "gdp_per_capita",
    "human_development_index",
    "median_age",
    "hospital_beds_per_thousand",
    "life_expectancy",
]
PROGRAM_PEAKS = [*DOSES, "total_tests_per_thousand", "positive_rate", *ATTRIBUTES]
# name: (numerator, denominator, per)
RATES = {
    "infected_population_pct": ("total_cases", "population", 100),
    "case_fatality_pct": ("total_deaths", "total_cases", 100),
    "deaths_per_100k": ("total_deaths", "population", 100_000),
    "vaccinated_pct": ("people_vaccinated", "population", 100),
    "fully_vaccinated_pct": ("people_fully_vaccinated", "population", 100),
    "booster_pct": ("total_boosters", "population", 100),
}

def _rates(*names: str) -> list[Column]:
    return [rate(*RATES[name]).alias(name) for name in names]


# --- summaries


def country_peaks(outcomes: DataFrame) -> DataFrame:
    """One row per country: peaks of the outcomes panel."""
    return entity_peaks(real_entities(outcomes), OUTCOME_PEAKS)


def daily_totals(outcomes: DataFrame) -> DataFrame:
    """One row per calendar day: sums over all countries."""
    return flow_totals(real_entities(outcomes), DAILY_FLOWS, [TIME])


def _matched_days(
    outcomes: DataFrame, program: DataFrame, outcome_columns: Sequence[str], program_columns: Sequence[str]
) -> DataFrame:
    """Country rows of days present in both panels, with only the columns named."""
    return join_panels(
        real_entities(outcomes).select(*KEYS, GROUP, ENTITY, *outcome_columns),
        program.select(*KEYS, *program_columns),
    )


def matched_peaks(outcomes: DataFrame, program: DataFrame, unique_keys: bool = False) -> DataFrame:
    """One row per country: peaks of both panels over the days present in both, and the mean daily positive rate.

    ``unique_keys`` says both panels are known to hold each key once, so that their rows can be joined directly.
    """
    means = ["positive_rate"]
    if unique_keys:
        days = _matched_days(outcomes, program, OUTCOME_PEAKS, PROGRAM_PEAKS)
        return entity_peaks(days, [*OUTCOME_PEAKS, *PROGRAM_PEAKS], means)
    return joined_peaks(real_entities(outcomes), program, OUTCOME_PEAKS, PROGRAM_PEAKS, means)


# --- totals and rankings on the outcomes panel


def global_totals(outcomes: DataFrame) -> DataFrame:
    return flow_totals(real_entities(outcomes), DAILY_FLOWS).select(
        whole("new_cases").alias("total_cases"),
        whole("new_deaths").alias("total_deaths"),
        pct("new_deaths", "new_cases", 3).alias("death_percentage"),
    )


def totals_by_group(outcomes: DataFrame) -> DataFrame:
    totals = flow_totals(real_entities(outcomes), DAILY_FLOWS, [GROUP]).select(
        GROUP,
        whole("new_cases").alias("total_cases"),
        whole("new_deaths").alias("total_deaths"),
        pct("new_deaths", "new_cases").alias("case_fatality_pct"),
    )
    return ordered(totals, "total_deaths", [GROUP], ascending=False)


def top_cases(peaks: DataFrame, k: int = RANKING_SIZE) -> DataFrame:
    rates = _rates("infected_population_pct", "case_fatality_pct")
    return top_k(peaks.select(ENTITY, GROUP, *OUTCOME_PEAKS, *rates), "total_cases", k)


def top_infection_rate(
    peaks: DataFrame, min_population: float = RATE_MIN_POPULATION, k: int = RANKING_SIZE
) -> DataFrame:
    rates = _rates("infected_population_pct", "case_fatality_pct")
    large = peaks.filter(F.col("population") >= min_population)
    return top_k(large.select(ENTITY, GROUP, "population", "total_cases", *rates), "infected_population_pct", k)


def top_deaths(peaks: DataFrame, k: int = RANKING_SIZE) -> DataFrame:
    rates = _rates("deaths_per_100k", "case_fatality_pct")
    return top_k(peaks.select(ENTITY, GROUP, *OUTCOME_PEAKS, *rates), "total_deaths", k)


def top_fatality(peaks: DataFrame, min_cases: float = FATALITY_MIN_CASES, k: int = RANKING_SIZE) -> DataFrame:
    major = peaks.filter(F.col("total_cases") >= min_cases)
    return top_k(major.select(ENTITY, GROUP, *OUTCOME_PEAKS, *_rates("case_fatality_pct")), "case_fatality_pct", k)


# --- daily series


def daily_series(daily: DataFrame) -> DataFrame:
    return ordered(daily, TIME, ())


def _smoothed(daily: DataFrame) -> DataFrame:
    """Trailing means of the daily totals. The window has no partition key, but its input is one row per calendar
    day, which the DATE range bounds whatever the panel's size."""
    return trailing_mean(daily, DAILY_FLOWS, entity=())


def daily_series_smoothed(daily: DataFrame) -> DataFrame:
    return ordered(_smoothed(daily), TIME, ())


def peak_days(daily: DataFrame, by: str, k: int = PEAK_DAYS) -> DataFrame:
    return top_k(_smoothed(daily), by, k, ties=[TIME])


def _entity_days(outcomes: DataFrame, entity: str) -> DataFrame:
    return outcomes.filter(F.col(ENTITY) == entity)


def entity_daily(outcomes: DataFrame, entity: str = FOCUS_ENTITY) -> DataFrame:
    return ordered(_entity_days(outcomes, entity).select(TIME, *DAILY_FLOWS), TIME, ())


def entity_peak_days(outcomes: DataFrame, entity: str = FOCUS_ENTITY, k: int = PEAK_DAYS) -> DataFrame:
    return top_k(_entity_days(outcomes, entity).select(TIME, *DAILY_FLOWS), "new_cases", k, ties=[TIME])


def entity_daily_smoothed(outcomes: DataFrame, entity: str = FOCUS_ENTITY) -> DataFrame:
    smoothed = all_entities_smoothed(_entity_days(outcomes, entity))
    return ordered(smoothed.select(TIME, *DAILY_FLOWS, *DAILY_MEANS), TIME, ())


def all_entities_smoothed(outcomes: DataFrame) -> DataFrame:
    """Daily flows and their trailing means for every entity; unsorted."""
    days = outcomes.select(ENTITY, CODE, TIME, *DAILY_FLOWS)
    return trailing_mean(days, DAILY_FLOWS, order=[TIME, CODE])


# --- both panels


def _vaccinated_countries(matched: DataFrame, min_population: float) -> DataFrame:
    return matched.filter((F.col("population") >= min_population) & F.col("people_fully_vaccinated").isNotNull())


def top_coverage(
    matched: DataFrame, min_population: float = COVERAGE_MIN_POPULATION, k: int = COVERAGE_SIZE
) -> DataFrame:
    rates = _rates("vaccinated_pct", "fully_vaccinated_pct", "booster_pct")
    countries = _vaccinated_countries(matched, min_population)
    return top_k(countries.select(ENTITY, GROUP, "population", *DOSES, *rates), "fully_vaccinated_pct", k)


def top_coverage_ascending(matched: DataFrame, **limits) -> DataFrame:
    """The rows of ``top_coverage``, lowest first, as a bar chart lists them."""
    return ordered(top_coverage(matched, **limits), "fully_vaccinated_pct")


def bottom_coverage(
    matched: DataFrame, min_population: float = COVERAGE_MIN_POPULATION, k: int = COVERAGE_SIZE
) -> DataFrame:
    rates = _rates("vaccinated_pct", "fully_vaccinated_pct")
    countries = _vaccinated_countries(matched, min_population)
    shown = countries.select(ENTITY, GROUP, "population", "people_vaccinated", "people_fully_vaccinated", *rates)
    return bottom_k(shown, "fully_vaccinated_pct", k)


def top_positive_rate(
    matched: DataFrame, min_population: float = COVERAGE_MIN_POPULATION, k: int = COVERAGE_SIZE
) -> DataFrame:
    tested = matched.filter((F.col("population") >= min_population) & F.col("avg_positive_rate").isNotNull())
    rated = tested.select(
        ENTITY,
        GROUP,
        "population",
        "total_tests_per_thousand",
        scaled("avg_positive_rate").alias("avg_positive_rate_pct"),
        scaled("positive_rate").alias("max_positive_rate_pct"),
    )
    return top_k(rated, "avg_positive_rate_pct", k)


def model_table(matched: DataFrame, min_population: float = RATE_MIN_POPULATION) -> DataFrame:
    """One row per country with rounded rates and static attributes, for export and correlation."""
    rates = ["infected_population_pct", "deaths_per_100k", "case_fatality_pct", "fully_vaccinated_pct", "booster_pct"]
    large = matched.filter(F.col("population") >= min_population)
    return large.select(GROUP, ENTITY, "population", *_rates(*rates), *ATTRIBUTES)


def correlations(matched: DataFrame, **limits) -> DataFrame:
    return corr_matrix(model_table(matched, **limits), CORRELATED_COLUMNS)


def correlation_pairs(matched: DataFrame, **limits) -> DataFrame:
    return corr_pairs(model_table(matched, **limits), CORRELATED_COLUMNS)


def matched_doses(outcomes: DataFrame, program: DataFrame, repeated_keys: str = "refuse") -> DataFrame:
    """Population and doses of every country day present in both panels, for the running totals.

    A key held m times on one side and n on the other would make m x n days and inflate every later total.
    ``repeated_keys``: "refuse" counts the keys of both panels first (a job each) and raises if any repeats; "unique"
    says they are known not to; "join" asks for all m x n rows; "fold" for one row per key with the doses that those
    rows would add up to, m times the sum of the n, without ever forming them.
    """
    if repeated_keys not in ("refuse", "unique", "join", "fold"):
        raise ValueError(f"unknown choice for repeated keys: {repeated_keys}")
    if repeated_keys == "fold":
        days = real_entities(outcomes).groupBy(*KEYS, GROUP, ENTITY)
        days = days.agg(F.max("population").alias("population"), F.count(F.lit(1)).alias("_copies"))
        doses = program.groupBy(*KEYS).agg(F.sum("new_vaccinations").alias("_doses"))
        joined = join_panels(days, doses)
        return joined.withColumn("new_vaccinations", F.col("_copies") * F.col("_doses")).drop("_copies", "_doses")
    if repeated_keys == "refuse":
        for panel in (real_entities(outcomes), program):
            assert_unique_keys(panel)
    return _matched_days(outcomes, program, ["population"], ["new_vaccinations"])


def _running(days: DataFrame, entities: Sequence[str] | None) -> DataFrame:
    if entities is not None:
        days = days.filter(F.col(ENTITY).isin(*entities))
    # an entity has one row per day, so its window is small
    running = running_total(days, "new_vaccinations", "rolling_vaccination_doses", order=[TIME, CODE])
    return running.withColumn("rolling_doses_per_100_people", pct("rolling_vaccination_doses", "population"))


_RUNNING_COLUMNS = [
    GROUP,
    ENTITY,
    TIME,
    "population",
    "new_vaccinations",
    "rolling_vaccination_doses",
    "rolling_doses_per_100_people",
]


def running_days(days: DataFrame, entities: Sequence[str] | None = None) -> DataFrame:
    """Doses accumulated per entity and per 100 people over ``matched_doses``; every entity unless some are named."""
    # the rows of a repeated key differ by their totals only
    order = [ENTITY, TIME, CODE, "rolling_vaccination_doses"]
    return _running(days, entities).orderBy(*order).select(*_RUNNING_COLUMNS)


def running_days_tail(days: DataFrame, entities: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """The last ``k`` of ``running_days``, in the same order."""
    return tail(_running(days, entities), [ENTITY, TIME, CODE], k).select(*_RUNNING_COLUMNS)


def running_doses(
    outcomes: DataFrame, program: DataFrame, entities: Sequence[str] | None = None, repeated_keys: str = "refuse"
) -> DataFrame:
    """``running_days`` straight from the two panels."""
    return running_days(matched_doses(outcomes, program, repeated_keys), entities)


def running_doses_tail(
    outcomes: DataFrame,
    program: DataFrame,
    entities: Sequence[str] | None = None,
    k: int = 10,
    repeated_keys: str = "refuse",
) -> DataFrame:
    return running_days_tail(matched_doses(outcomes, program, repeated_keys), entities, k)


def entity_summary(outcomes: DataFrame, program: DataFrame, entity: str = FOCUS_ENTITY) -> DataFrame:
    """One row; each panel is reduced on its own, so a day missing from one does not hide the other's peak."""
    program_peaks = [*DOSES, "total_vaccinations"]
    both = join_summaries(
        entity_peaks(_entity_days(outcomes, entity), OUTCOME_PEAKS, keys=[ENTITY]),
        entity_peaks(_entity_days(program, entity), program_peaks, keys=[ENTITY]),
    )
    return both.select(
        ENTITY,
        *OUTCOME_PEAKS,
        *_rates("infected_population_pct", "case_fatality_pct"),
        *program_peaks,
        *_rates("vaccinated_pct", "fully_vaccinated_pct", "booster_pct"),
    )


# --- plot-ready long forms: (series, x, y)


def daily_lines(daily: DataFrame) -> DataFrame:
    return to_series(_smoothed(daily), TIME, DAILY_MEANS)


def entity_lines(outcomes: DataFrame, entity: str = FOCUS_ENTITY) -> DataFrame:
    return to_series(all_entities_smoothed(_entity_days(outcomes, entity)), TIME, DAILY_MEANS)


def coverage_bars(matched: DataFrame, **limits) -> DataFrame:
    return to_series(top_coverage(matched, **limits), ENTITY, "fully_vaccinated_pct", series=GROUP)


def running_lines(days: DataFrame, entities: Sequence[str] | None = None) -> DataFrame:
    """Lines over ``matched_doses``."""
    return to_series(_running(days, entities), TIME, "rolling_doses_per_100_people", series=ENTITY)


def correlation_cells(matched: DataFrame, **limits) -> DataFrame:
    """Every cell of the square matrix."""
    return to_series(correlations(matched, **limits), "column", list(CORRELATED_COLUMNS))
