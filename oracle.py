"""SQL for DuckDB that answers each registered query independently of Spark.

Rounding goes through DECIMAL because DuckDB rounds binary doubles (0.285 -> 0.28) where Spark rounds their shortest
decimal form (0.29); NULL order is always written out; integer sums are cast back to BIGINT.
"""

from __future__ import annotations

# The outcomes and program panels as views over the raw tables; money is summed in whole cents.
PANELS = """
nations AS (
  SELECT n_nationkey AS nk, n_name AS location, r_name AS continent
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
order_days AS (
  SELECT c_nationkey AS nk, CAST(o_orderdate AS DATE) AS date,
    CASE WHEN max(o_orderpriority) <> '1-URGENT'
      THEN floor(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100000) END AS new_cases,
    CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS new_deaths
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY ALL
),
order_panel AS (
  SELECT concat('ISO_', nk) AS iso_code, continent, location, date,
    CASE nk WHEN 5 THEN 0.0E0 WHEN 6 THEN NULL ELSE nk * nk * 60000.0E0 + 300000.0E0 END AS population,
    new_cases, new_deaths,
    sum(new_cases) OVER so_far AS total_cases, sum(new_deaths) OVER so_far AS total_deaths
  FROM order_days JOIN nations USING (nk)
  WINDOW so_far AS (PARTITION BY nk ORDER BY date ROWS UNBOUNDED PRECEDING)
),
outcomes AS (
  SELECT *, total_cases * 1000000.0E0 / nullif(population, 0) AS total_cases_per_million,
    total_deaths * 1000000.0E0 / nullif(population, 0) AS total_deaths_per_million
  FROM order_panel
  UNION ALL BY NAME
  SELECT concat('AGG_', continent) AS iso_code, NULL AS continent, continent AS location, date,
    5.0E7 AS population, sum(new_cases) AS new_cases, sum(new_deaths) AS new_deaths,
    9.0E6 AS total_cases, 9.0E4 AS total_deaths
  FROM order_panel GROUP BY order_panel.continent, date
),
ship_days AS (
  SELECT s_nationkey AS nk, CAST(l_shipdate AS DATE) AS date,
    CASE WHEN max(l_linenumber) <> 1 THEN sum(l_quantity) END AS new_vaccinations,
    max(l_discount) FILTER (l_returnflag <> 'R') AS positive_rate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY ALL
),
supplier_nations AS (
  SELECT s_nationkey AS nk, floor(sum(CAST(round(s_acctbal * 100) AS BIGINT)) / (count(*) * 100)) AS gdp_per_capita,
    CAST(count(*) AS DOUBLE) AS hospital_beds_per_thousand
  FROM supplier GROUP BY ALL
),
ship_panel AS (
  SELECT ship_days.*, continent, location, gdp_per_capita, hospital_beds_per_thousand,
    sum(new_vaccinations) OVER (PARTITION BY nk ORDER BY date ROWS UNBOUNDED PRECEDING) AS total_vaccinations
  FROM ship_days JOIN nations USING (nk) JOIN supplier_nations USING (nk)
),
program AS (
  SELECT concat('ISO_', nk) AS iso_code, continent, location, date, new_vaccinations, positive_rate,
    total_vaccinations, floor(total_vaccinations * 0.6E0) AS people_vaccinated,
    CASE WHEN nk <> 20 THEN floor(total_vaccinations * 0.5E0) END AS people_fully_vaccinated,
    floor(total_vaccinations * 0.1E0) AS total_boosters, total_vaccinations / 8.0E0 AS total_tests_per_thousand,
    gdp_per_capita, CASE WHEN nk % 7 <> 3 THEN nk / 32.0E0 END AS human_development_index,
    20.0E0 + (nk * 7) % 25 AS median_age, hospital_beds_per_thousand, 60.0E0 + (nk * 11) % 25 AS life_expectancy,
    CASE WHEN nk % 2 = 0 THEN 'tests performed' END AS tests_units
  FROM ship_panel
  UNION ALL BY NAME
  SELECT concat('AGG_', continent) AS iso_code, NULL AS continent, continent AS location, date,
    sum(new_vaccinations) AS new_vaccinations, 0.5E0 AS positive_rate, 8.0E6 AS total_vaccinations,
    5.0E6 AS people_vaccinated, 4.0E6 AS people_fully_vaccinated, 5.0E5 AS total_boosters
  FROM ship_panel GROUP BY ship_panel.continent, date
)"""

RANKED = ("population", "total_cases", "total_deaths")
ATTRIBUTES = (
    "gdp_per_capita",
    "human_development_index",
    "median_age",
    "hospital_beds_per_thousand",
    "life_expectancy",
)
CORRELATED = (
    "infected_population_pct",
    "deaths_per_100k",
    "case_fatality_pct",
    "fully_vaccinated_pct",
    "booster_pct",
    *ATTRIBUTES,
)


def rounded(expression: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def share(part: str, whole: str, name: str, per: str = "100.0E0", digits: int = 2) -> str:
    return f"{rounded(f'{part} * {per} / nullif({whole}, 0)', digits)} AS {name}"


INFECTED = share("total_cases", "population", "infected_population_pct")
FATALITY = share("total_deaths", "total_cases", "case_fatality_pct")
PER_100K = share("total_deaths", "population", "deaths_per_100k", "100000.0E0")
VACCINATED = share("people_vaccinated", "population", "vaccinated_pct")
FULLY = share("people_fully_vaccinated", "population", "fully_vaccinated_pct")
BOOSTED = share("total_boosters", "population", "booster_pct")


#: Before the query itself, so that it can be asked again in another.
MARK = "\n\n"


def with_panels(query: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([PANELS, *ctes]) + MARK + query


def peaks(columns, source: str, keys: str = "continent, location") -> str:
    return f"SELECT {keys}, {', '.join(f'max({c}) AS {c}' for c in columns)} FROM {source} GROUP BY {keys}"


def ranking(select: str, source: str, order: str, k: int, where: str = "true") -> str:
    return f"SELECT {select} FROM ({source}) WHERE {where} ORDER BY {order}, location LIMIT {k}"


COUNTRIES = peaks(RANKED, "outcomes WHERE continent IS NOT NULL")
MATCHED = """matched AS (
  SELECT o.*, p.* EXCLUDE (iso_code, date, continent, location)
  FROM outcomes o JOIN program p USING (iso_code, date)
  WHERE o.continent IS NOT NULL
)"""
DOSES = ("people_vaccinated", "people_fully_vaccinated", "total_boosters")
DAYS = """days AS (
  SELECT date, sum(new_cases) AS new_cases, sum(new_deaths) AS new_deaths
  FROM outcomes WHERE continent IS NOT NULL GROUP BY date
)"""


def trailing(column: str, name: str, order: str = "date", part: str = "", n: int = 7) -> str:
    window = f"({f'PARTITION BY {part} ' if part else ''}ORDER BY {order} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({column}) OVER {window} = {n} THEN avg({column}) OVER {window} END AS {name}"


SMOOTH = f"{trailing('new_cases', 'new_cases_7d')}, {trailing('new_deaths', 'new_deaths_7d')}"
SMOOTH_DAYS = f"smooth AS (SELECT *, {SMOOTH} FROM days)"
COVERAGE = ranking(
    f"location, continent, population, {', '.join(DOSES)}, {VACCINATED}, {FULLY}, {BOOSTED}",
    peaks(("population", *DOSES), "matched"),
    "fully_vaccinated_pct DESC NULLS LAST",
    20,
    "population >= 1e7 AND people_fully_vaccinated IS NOT NULL",
)


def running(where: str) -> str:
    return f"""running AS (
  SELECT continent, location, date, population, new_vaccinations, rolling_vaccination_doses,
    {share("rolling_vaccination_doses", "population", "rolling_doses_per_100_people")}
  FROM (SELECT *, sum(coalesce(new_vaccinations, 0)) OVER
          (PARTITION BY location ORDER BY date, iso_code ROWS UNBOUNDED PRECEDING) AS rolling_vaccination_doses
        FROM matched WHERE {where})
)"""


FOUR = "location IN ('NATION_1', 'NATION_5', 'NATION_15', 'NATION_20')"
MODEL = f"""model AS (
  SELECT continent, location, population, {INFECTED}, {PER_100K}, {FATALITY}, {FULLY}, {BOOSTED}, {', '.join(ATTRIBUTES)}
  FROM ({peaks((*RANKED, 'people_fully_vaccinated', 'total_boosters', *ATTRIBUTES), 'matched')})
  WHERE population >= 1e6
)"""


def pearson(x: str, y: str, source: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    r = f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"
    return f"SELECT '{x}' AS x, '{y}' AS y, {rounded(r, 6)} AS corr FROM {source} WHERE {both}"


def correlations(columns, source: str, square: bool = False) -> str:
    return "\nUNION ALL ".join(
        pearson(x, y, source) for i, x in enumerate(columns) for j, y in enumerate(columns) if square or i <= j
    )


def missing(columns, source: str, k: int = 12) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column, (count(*) - count({c})) * 100.0E0 / nullif(count(*), 0) AS missing_pct FROM {source}"
        for c in columns
    )
    return f'SELECT * FROM ({rows}) ORDER BY missing_pct DESC NULLS LAST, "column" LIMIT {k}'


# Columns of the two panels.
OUTCOMES_COLUMNS = (
    "iso_code",
    "continent",
    "location",
    "date",
    "population",
    "new_cases",
    "new_deaths",
    "total_cases",
    "total_deaths",
    "total_cases_per_million",
    "total_deaths_per_million",
)
PROGRAM_COLUMNS = (
    "iso_code",
    "continent",
    "location",
    "date",
    "new_vaccinations",
    "positive_rate",
    "total_vaccinations",
    "people_vaccinated",
    "people_fully_vaccinated",
    "total_boosters",
    "total_tests_per_thousand",
    "gdp_per_capita",
    "human_development_index",
    "median_age",
    "hospital_beds_per_thousand",
    "life_expectancy",
    "tests_units",
)


def profile(name: str, source: str, columns: int, entity="location", group="continent", time="date", code="iso_code"):
    return f"""SELECT '{name}' AS "table", count(*) AS rows, CAST({columns} AS BIGINT) AS columns,
  count(DISTINCT {entity}) AS unique_locations,
  count(DISTINCT {entity}) FILTER ({group} IS NOT NULL) AS country_locations,
  min({time}) AS start_date, max({time}) AS end_date,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT {code}, {time} FROM {source})) AS duplicate_iso_date_rows
FROM {source}"""


SUPPLIER_DAYS = """supplier_days AS (
  SELECT l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS quantity,
    sum(l_quantity) FILTER (l_returnflag <> 'R') AS kept_quantity, count(*) AS lines
  FROM lineitem GROUP BY ALL
)"""


def entity_series(where: str) -> str:
    return f"SELECT date, new_cases, new_deaths FROM outcomes WHERE {where}"


FOCUS = "location = 'NATION_15'"
FOCUS_SMOOTH = f"focus AS (SELECT date, new_cases, new_deaths, {SMOOTH} FROM outcomes WHERE {FOCUS})"


def unpivoted(source: str) -> str:
    return (
        f"SELECT 'new_cases_7d' AS series, date AS x, new_cases_7d AS y FROM {source} "
        f"UNION ALL SELECT 'new_deaths_7d', date, new_deaths_7d FROM {source}"
    )


def catalogue() -> dict[str, str]:
    coverage_low = ranking(
        f"location, continent, population, people_vaccinated, people_fully_vaccinated, {VACCINATED}, {FULLY}",
        peaks(("population", "people_vaccinated", "people_fully_vaccinated"), "matched"),
        "fully_vaccinated_pct ASC NULLS FIRST",
        20,
        "population >= 1e7 AND people_fully_vaccinated IS NOT NULL",
    )
    tests = f"""SELECT location, continent, population, total_tests_per_thousand,
      {rounded('mean_rate * 100')} AS avg_positive_rate_pct, {rounded('top_rate * 100')} AS max_positive_rate_pct
    FROM (SELECT continent, location, max(population) AS population,
            max(total_tests_per_thousand) AS total_tests_per_thousand,
            avg(positive_rate) AS mean_rate, max(positive_rate) AS top_rate
          FROM matched GROUP BY continent, location)
    WHERE population >= 1e7 AND mean_rate IS NOT NULL
    ORDER BY avg_positive_rate_pct DESC, location LIMIT 20"""
    summary = f"""SELECT location, population, total_cases, total_deaths, {INFECTED}, {FATALITY},
      people_vaccinated, people_fully_vaccinated, total_boosters, total_vaccinations, {VACCINATED}, {FULLY}, {BOOSTED}
    FROM ({peaks(RANKED, f'outcomes WHERE {FOCUS}', 'location')})
    JOIN ({peaks((*DOSES, 'total_vaccinations'), f'program WHERE {FOCUS}', 'location')}) USING (location)"""
    by_day = "ORDER BY {0} DESC NULLS LAST, date LIMIT 10"
    return {
        "q01_coverage": with_panels(
            """SELECT count(*) AS rows, count(DISTINCT iso_code) AS iso_codes, count(DISTINCT location) AS locations,
              min(date) AS start_date, max(date) AS end_date,
              CAST(sum(CAST(continent IS NULL AS INTEGER)) AS BIGINT) AS aggregate_rows FROM outcomes"""
        ),
        "q02_global_totals": with_panels(
            f"""SELECT round(sum(new_cases)) AS total_cases, round(sum(new_deaths)) AS total_deaths,
              {share("sum(new_deaths)", "sum(new_cases)", "death_percentage", digits=3)}
            FROM outcomes WHERE continent IS NOT NULL"""
        ),
        "q03_top_cases": with_panels(
            ranking(
                f"location, continent, {', '.join(RANKED)}, {INFECTED}, {FATALITY}",
                COUNTRIES,
                "total_cases DESC NULLS LAST",
                15,
            )
        ),
        "q04_top_infection_rate": with_panels(
            ranking(
                f"location, continent, population, total_cases, {INFECTED}, {FATALITY}",
                COUNTRIES,
                "infected_population_pct DESC NULLS LAST",
                15,
                "population >= 1e6",
            )
        ),
        "q05_top_deaths": with_panels(
            ranking(
                f"location, continent, {', '.join(RANKED)}, {PER_100K}, {FATALITY}",
                COUNTRIES,
                "total_deaths DESC NULLS LAST",
                15,
            )
        ),
        "q06_by_group": with_panels(
            f"""SELECT continent, round(sum(new_cases)) AS total_cases, round(sum(new_deaths)) AS total_deaths,
              {share("sum(new_deaths)", "sum(new_cases)", "case_fatality_pct")}
            FROM outcomes WHERE continent IS NOT NULL GROUP BY continent
            ORDER BY total_deaths DESC NULLS LAST, continent"""
        ),
        "q07_top_fatality": with_panels(
            ranking(
                f"location, continent, {', '.join(RANKED)}, {FATALITY}",
                COUNTRIES,
                "case_fatality_pct DESC NULLS LAST",
                15,
                "total_cases >= 150000",
            )
        ),
        "q08_daily": with_panels("SELECT * FROM days ORDER BY date", DAYS),
        "q09_top_coverage": with_panels(COVERAGE, MATCHED),
        "q10_bottom_coverage": with_panels(coverage_low, MATCHED),
        "q11_running_doses": with_panels("SELECT * FROM running ORDER BY location, date", MATCHED, running(FOUR)),
        "q11_running_doses_all": with_panels(
            "SELECT * FROM running ORDER BY location, date", MATCHED, running("true")
        ),
        "q12_positive_rate": with_panels(tests, MATCHED),
        "q13_entity_summary": with_panels(summary),
        "q14_entity_peaks": with_panels(f"{entity_series(FOCUS)} {by_day.format('new_cases')}"),
        "q15_model_table": with_panels("SELECT * FROM model", MATCHED, MODEL),
        "q15_model_table_any_keys": with_panels("SELECT * FROM model", MATCHED, MODEL),
        "q16_entity_daily": with_panels(f"{entity_series(FOCUS)} ORDER BY date"),
        "d01_profile": with_panels(
            profile("covid_deaths", "outcomes", len(OUTCOMES_COLUMNS))
            + " UNION ALL "
            + profile("covid_vaccinations", "program", len(PROGRAM_COLUMNS))
        ),
        "d02_rollup_labels": with_panels(
            "SELECT DISTINCT location FROM outcomes WHERE continent IS NULL AND location IS NOT NULL ORDER BY location"
        ),
        "d03_missing_outcomes": with_panels(missing(OUTCOMES_COLUMNS, "outcomes")),
        "d04_missing_program": with_panels(missing(PROGRAM_COLUMNS, "program")),
        "d05_daily_7d": with_panels("SELECT * FROM smooth ORDER BY date", DAYS, SMOOTH_DAYS),
        "d06_peak_case_days": with_panels(f"SELECT * FROM smooth {by_day.format('new_cases')}", DAYS, SMOOTH_DAYS),
        "d07_peak_death_days": with_panels(f"SELECT * FROM smooth {by_day.format('new_deaths')}", DAYS, SMOOTH_DAYS),
        "d08_coverage_chart": with_panels(
            f"SELECT * FROM ({COVERAGE}) ORDER BY fully_vaccinated_pct NULLS LAST, location", MATCHED
        ),
        "d09_entity_7d": with_panels("SELECT * FROM focus ORDER BY date", FOCUS_SMOOTH),
        "d09_all_entities_7d": with_panels(
            f"""SELECT iso_code, location, date, new_cases, new_deaths,
              {trailing("new_cases", "new_cases_7d", "date, iso_code", "location")},
              {trailing("new_deaths", "new_deaths_7d", "date, iso_code", "location")}
            FROM outcomes"""
        ),
        "d10_corr_long": with_panels(correlations(CORRELATED, "model"), MATCHED, MODEL),
        "d10_corr_matrix": with_panels(
            'SELECT x AS "column", '
            + ", ".join(f"max(corr) FILTER (y = '{c}') AS {c}" for c in CORRELATED)
            + f" FROM ({correlations(CORRELATED, 'model', square=True)}) GROUP BY x",
            MATCHED,
            MODEL,
        ),
        "d11_running_tail": with_panels(
            "SELECT * FROM (SELECT * FROM running ORDER BY location DESC, date DESC LIMIT 10) ORDER BY location, date",
            MATCHED,
            running(FOUR),
        ),
        "d12_daily_lines": with_panels(unpivoted("smooth"), DAYS, SMOOTH_DAYS),
        "d12_entity_lines": with_panels(unpivoted("focus"), FOCUS_SMOOTH),
        "d12_coverage_bars": with_panels(
            f"SELECT continent AS series, location AS x, fully_vaccinated_pct AS y FROM ({COVERAGE})", MATCHED
        ),
        "d12_running_lines": with_panels(
            "SELECT location AS series, date AS x, rolling_doses_per_100_people AS y FROM running",
            MATCHED,
            running(FOUR),
        ),
        "d12_corr_cells": with_panels(
            "SELECT y AS series, x, corr AS y FROM (" + correlations(CORRELATED, "model", square=True) + ")",
            MATCHED,
            MODEL,
        ),
    }


BY_LOCATION = """SELECT location, count(*) AS days, max(total_cases) AS total_cases, sum(new_cases) AS new_cases
  FROM outcomes WHERE continent IS NOT NULL GROUP BY location"""


def operators() -> dict[str, str]:
    texts = catalogue()
    line_measures = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return {
        "source_csv_panel": with_panels(f"SELECT {', '.join(OUTCOMES_COLUMNS)} FROM outcomes"),
        "source_sql_view": with_panels(BY_LOCATION),
        "source_show_sql": with_panels(BY_LOCATION),
        "running_doses_repeated": with_panels(
            "SELECT * FROM running ORDER BY location, date, rolling_vaccination_doses",
            MATCHED.replace("FROM outcomes o", "FROM (SELECT * FROM outcomes UNION ALL SELECT * FROM outcomes) o"),
            running("true"),
        ),
        "running_doses_folded": with_panels(
            "SELECT * FROM running ORDER BY location, date",
            MATCHED.replace("FROM outcomes o", "FROM (SELECT * FROM outcomes UNION ALL SELECT * FROM outcomes) o").replace(
                "JOIN program p", "JOIN (SELECT program.* FROM program, range(3)) p"
            ),
            """folded AS (SELECT iso_code, date, continent, location, max(population) AS population,
              sum(new_vaccinations) AS new_vaccinations FROM matched GROUP BY ALL)""",
            running("true").replace("FROM matched", "FROM folded"),
        ),
        "joined_bucketed_panels": with_panels(
            """SELECT o.continent, o.location, count(*) AS days, max(total_cases) AS total_cases,
              max(people_vaccinated) AS people_vaccinated, sum(new_vaccinations) AS new_vaccinations
            FROM outcomes o JOIN program p USING (iso_code, date) GROUP BY o.continent, o.location"""
        ),
        "shared_summary_reports": with_panels(
            " UNION ALL ".join(
                f"SELECT '{name}' AS report, location, CAST({by} AS DOUBLE) AS value FROM ({texts[question].rpartition(MARK)[2]})"
                for name, question, by in (
                    ("top_cases", "q03_top_cases", "total_cases"),
                    ("top_infection_rate", "q04_top_infection_rate", "infected_population_pct"),
                    ("top_deaths", "q05_top_deaths", "total_deaths"),
                    ("top_coverage", "q09_top_coverage", "fully_vaccinated_pct"),
                    ("bottom_coverage", "q10_bottom_coverage", "fully_vaccinated_pct"),
                    ("top_positive_rate", "q12_positive_rate", "avg_positive_rate_pct"),
                )
            ),
            MATCHED,
        ),
        "source_shapes": " UNION ALL ".join(
            f"SELECT '{name}' AS \"table\", count(*) AS rows, CAST({width} AS BIGINT) AS columns FROM {name}"
            for name, width in {"orders": 6, "lineitem": 11, "events": 6}.items()
        ),
        "sink_model_export": with_panels("SELECT * FROM model", MATCHED, MODEL),
        "clean_order_texts": """SELECT o_orderkey,
            CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_orderdate AS DATE) END AS date,
            CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 5 <> 0 THEN o_totalprice END AS price,
            CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END AS tests_units
          FROM orders""",
        "clean_iso_dates": """SELECT CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m-%d') AS text,
            count(*) AS orders FROM orders GROUP BY ALL""",
        "profile_lines": "WITH typed AS (SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate, "
        "nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem) "
        + profile("lineitem", "typed", 11, "l_suppkey", "l_returnflag", "l_shipdate", "l_partkey"),
        "duplicate_line_keys": """SELECT (SELECT count(*) FROM lineitem) - count(*) AS duplicate_rows FROM
            (SELECT DISTINCT l_suppkey, CASE WHEN l_returnflag <> 'R' THEN l_shipdate END FROM lineitem)""",
        "coverage_orders": """SELECT count(*) AS rows, count(DISTINCT o_custkey) AS iso_codes,
            count(DISTINCT o_orderpriority) AS locations, min(CAST(o_orderdate AS DATE)) AS start_date,
            max(CAST(o_orderdate AS DATE)) AS end_date, count(*) FILTER (o_orderstatus = 'P') AS aggregate_rows
          FROM orders""",
        "missing_supplier_days": f"WITH {SUPPLIER_DAYS} "
        + missing(("supplier", "date", "quantity", "kept_quantity", "lines"), "supplier_days"),
        "peaks_by_customer": """SELECT o_custkey, max(o_totalprice) AS o_totalprice, max(o_orderdate) AS o_orderdate,
            avg(CAST(round(o_totalprice * 100) AS BIGINT)) AS avg_cents FROM orders GROUP BY o_custkey""",
        "top_customers": """SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
          FROM orders GROUP BY o_custkey ORDER BY cents DESC, o_custkey LIMIT 20""",
        "joined_supplier_days": f"""SELECT supplier, max(k.quantity) AS kept, max(r.quantity) AS returned,
            count(*) AS days, {share("sum(r.quantity)", "sum(k.quantity)", "returned_pct")}
          FROM (SELECT l_suppkey AS supplier, l_shipdate AS date, sum(l_quantity) AS quantity FROM lineitem
                WHERE l_returnflag <> 'R' GROUP BY ALL) k
          JOIN (SELECT l_suppkey AS supplier, l_shipdate AS date, sum(l_quantity) AS quantity FROM lineitem
                WHERE l_returnflag = 'R' GROUP BY ALL) r USING (supplier, date)
          GROUP BY supplier""",
        "joined_line_peaks": """SELECT k.l_suppkey AS supplier, max(k.l_quantity) AS l_quantity,
            max(CAST(round(r.l_extendedprice * 100) AS BIGINT)) AS cents, avg(r.l_linenumber) AS avg_line
          FROM lineitem k JOIN lineitem r ON r.l_partkey = k.l_partkey AND r.l_shipdate = k.l_shipdate
          WHERE k.l_returnflag <> 'R' AND r.l_returnflag = 'R' GROUP BY k.l_suppkey""",
        "running_quantity_by_supplier": f"""WITH {SUPPLIER_DAYS} SELECT supplier, date, kept_quantity,
            sum(coalesce(kept_quantity, 0)) OVER (PARTITION BY supplier ORDER BY date ROWS UNBOUNDED PRECEDING)
              AS running_quantity FROM supplier_days""",
        "running_value_by_event_type": """SELECT event_id, event_type, ts, round(value * 100) AS cents,
            sum(round(value * 100)) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
              AS running_cents FROM events""",
        "trailing_quantity_by_supplier": f"""WITH {SUPPLIER_DAYS} SELECT supplier, date, kept_quantity, quantity,
            {trailing("kept_quantity", "kept_quantity_7d", "date", "supplier")},
            {trailing("quantity", "quantity_7d", "date", "supplier")} FROM supplier_days""",
        "trailing_value_by_event_type": f"""SELECT event_id, event_type, ts, cents,
            {trailing("cents", "cents_7d", "ts, event_id", "event_type")}
          FROM (SELECT *, round(value * 100) AS cents FROM events)""",
        "correlation_line_measures": correlations(line_measures, "lineitem"),
        "clean_date_layouts": """SELECT o_orderkey, CASE WHEN o_orderkey % 12 < 11 THEN CAST(o_orderdate AS DATE) END AS date,
            CASE WHEN o_orderkey % 12 = 11 THEN concat('day ', o_orderkey) END AS unread FROM orders""",
        "correlation_with_infinities": "WITH odd AS (SELECT l_discount, "
        "CASE WHEN l_orderkey % 7 <> 0 AND l_orderkey % 11 <> 0 AND l_orderkey % 13 <> 0 THEN l_quantity END AS l_quantity, "
        "CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS l_extendedprice FROM lineitem) "
        + correlations(("l_quantity", "l_extendedprice", "l_discount"), "odd"),
    }


def oracle_sql() -> dict[str, str]:
    texts = {**catalogue(), **operators()}
    for name in ("running_value", "trailing_value"):
        texts[f"{name}_over_ranges"] = texts[f"{name}_by_event_type"]
    return texts
