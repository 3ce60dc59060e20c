"""SQL texts a user would run on the two registered tables, against the DataFrame answers."""

from __future__ import annotations

import pytest

from panelytics.contract import OUTCOMES_TABLE, PROGRAM_TABLE
from panelytics.plans import questions as q
from panelytics.sources import register, run_sql

TEXTS = {
    "totals": (
        """
        select round(sum(new_cases)) as total_cases, round(sum(new_deaths)) as total_deaths,
               round(100.0 * sum(new_deaths) / nullif(sum(new_cases), 0), 3) as death_percentage
        from covid_deaths where continent is not null;
        """,
        lambda o, p: q.global_totals(o),
    ),
    "ranking": (
        """
        with t as (select location, continent, max(population) as population, max(total_cases) as total_cases,
                          max(total_deaths) as total_deaths
                   from covid_deaths where continent is not null group by location, continent)
        select t.*, round(total_cases * 100.0 / nullif(population, 0), 2) as infected_population_pct,
               round(total_deaths * 100.0 / nullif(total_cases, 0), 2) as case_fatality_pct
        from t order by total_cases desc, location limit 15
        """,
        lambda o, p: q.top_cases(q.country_peaks(o)),
    ),
    "running": (
        """
        select *, round(rolling_vaccination_doses * 100.0 / nullif(population, 0), 2) as rolling_doses_per_100_people
        from (select o.continent, o.location, o.date, o.population, p.new_vaccinations,
                     sum(coalesce(p.new_vaccinations, 0)) over (partition by o.location order by o.date
                       rows between unbounded preceding and current row) as rolling_vaccination_doses
              from covid_deaths o join covid_vaccinations p on p.iso_code = o.iso_code and p.date = o.date
              where o.continent is not null and o.location in ('NATION_1', 'NATION_7')) t
        order by location, date;
        """,
        lambda o, p: q.running_doses(o, p, ["NATION_1", "NATION_7"]),
    ),
    "summary": (
        """
        with a as (select location, max(population) as population, max(total_cases) as total_cases,
                          max(total_deaths) as total_deaths
                   from covid_deaths where location = 'NATION_15' group by location),
             b as (select location, max(people_vaccinated) as people_vaccinated,
                          max(people_fully_vaccinated) as people_fully_vaccinated,
                          max(total_boosters) as total_boosters, max(total_vaccinations) as total_vaccinations
                   from covid_vaccinations where location = 'NATION_15' group by location)
        select a.location, population, total_cases, total_deaths,
               round(total_cases * 100.0 / nullif(population, 0), 2),
               round(total_deaths * 100.0 / nullif(total_cases, 0), 2),
               people_vaccinated, people_fully_vaccinated, total_boosters, total_vaccinations,
               round(people_vaccinated * 100.0 / nullif(population, 0), 2),
               round(people_fully_vaccinated * 100.0 / nullif(population, 0), 2),
               round(total_boosters * 100.0 / nullif(population, 0), 2)
        from a join b on a.location = b.location
        """,
        lambda o, p: q.entity_summary(o, p, "NATION_15"),
    ),
    "text dates": (
        "select date, new_cases, new_deaths from covid_deaths "
        "where location = 'NATION_15' and date >= '1990-01-01' order by date",
        lambda o, p: q.entity_daily(o, "NATION_15"),
    ),
}


@pytest.mark.parametrize("name", list(TEXTS))
def test_same_answer_in_sql(spark, panels, name):
    register(panels.outcomes, OUTCOMES_TABLE)
    register(panels.program, PROGRAM_TABLE)
    text, question = TEXTS[name]
    assert [tuple(r) for r in run_sql(spark, text).collect()] == [tuple(r) for r in question(*panels).collect()]
