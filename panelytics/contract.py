"""Names and constants the panels and the question catalogue agree on."""

from __future__ import annotations

# Column roles.
CODE = "iso_code"
GROUP = "continent"
ENTITY = "location"
TIME = "date"
KEYS = (CODE, TIME)

# Table names that users' SQL refers to, and the file-name keyword of each.
OUTCOMES_TABLE = "covid_deaths"
PROGRAM_TABLE = "covid_vaccinations"
OUTCOMES_KEYWORD = "death"
PROGRAM_KEYWORD = "vacc"

# Columns kept as text; every other column is numeric.
TEXT_COLUMNS = ("iso_code", "continent", "location", "date", "tests_units")

# Cell texts that mean "missing" (the public default list of the pandas CSV reader).
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Date layouts in the order they are tried; ISO stands for Spark's own text-to-date cast. Where a day and a month could
# change places, the month comes first. Two-digit years are read by the pivot below.
ISO = "iso"
DATE_FORMATS = (
    "M/d/yyyy",
    ISO,
    "d/M/yyyy",
    "M/d/yy",
    "d/M/yy",
    "yyyy/M/d",
    "yyyyMMdd",
    "M-d-yyyy",
    "d-M-yyyy",
    "M-d-yy",
    "d-M-yy",
    "M.d.yyyy",
    "d.M.yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "MMM d yyyy",
    "MMMM d yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "d-MMM-yy",
    "d MMM yy",
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yy H:mm",
    "yyyy/M/d H:mm",
    "yyyy/M/d H:mm:ss",
    "yyyy.M.d",
)
# Fixed value: the first two-digit year that means the 1900s.
TWO_DIGIT_PIVOT = 69

# Columns the catalogue names; a panel may carry more.
OUTCOMES_COLUMNS = (
    "iso_code",
    "continent",
    "location",
    "date",
    "population",
    "total_cases",
    "total_deaths",
    "new_cases",
    "new_deaths",
    "total_cases_per_million",
    "total_deaths_per_million",
)
PROGRAM_COLUMNS = (
    "iso_code",
    "continent",
    "location",
    "date",
    "people_vaccinated",
    "people_fully_vaccinated",
    "total_boosters",
    "total_vaccinations",
    "new_vaccinations",
    "total_tests_per_thousand",
    "positive_rate",
    "gdp_per_capita",
    "human_development_index",
    "median_age",
    "hospital_beds_per_thousand",
    "life_expectancy",
    "tests_units",
)

# Default thresholds, sizes and entities of the questions.
RATE_MIN_POPULATION = 1_000_000
COVERAGE_MIN_POPULATION = 10_000_000
FATALITY_MIN_CASES = 1_000_000
RANKING_SIZE = 15
COVERAGE_SIZE = 20
PEAK_DAYS = 10
MISSINGNESS_SIZE = 12
TRAILING_ROWS = 7
FOCUS_ENTITY = "India"
COMPARED_ENTITIES = ("India", "United States", "Brazil", "United Kingdom", "China")
CORRELATED_COLUMNS = (
    "infected_population_pct",
    "deaths_per_100k",
    "case_fatality_pct",
    "fully_vaccinated_pct",
    "booster_pct",
    "gdp_per_capita",
    "human_development_index",
    "median_age",
    "hospital_beds_per_thousand",
    "life_expectancy",
)
