"""DuckDB-dialect building blocks for the oracle texts.

The prepared panel is re-stated in DuckDB SQL (the Spark side is the
DataFrame code in ``panelwise.operators.prepare``); the raw panel view is the
very same text Spark runs.
"""

from __future__ import annotations

from panelwise.functions.rounding import stable_round_sql
from panelwise.sources.driver_views import EVENTS_VIEW_TEMPLATE, PANEL_VIEW_TEMPLATE, duckdb_text

RAW_CTE = f"raw AS ({duckdb_text(PANEL_VIEW_TEMPLATE)})"
EVENTS_CTE = f"ev AS ({duckdb_text(EVENTS_VIEW_TEMPLATE)})"

PREPARED_CTES = RAW_CTE + """,
clean AS (
  SELECT row_id, country, iso_code, CAST(date AS DATE) AS date,
    coalesce(total_vaccinations, CAST(0 AS DOUBLE)) AS total_vaccinations,
    coalesce(people_vaccinated, CAST(0 AS DOUBLE)) AS people_vaccinated,
    coalesce(people_fully_vaccinated, CAST(0 AS DOUBLE)) AS people_fully_vaccinated,
    coalesce(New_deaths, CAST(0 AS DOUBLE)) AS New_deaths,
    TRY_CAST(population AS DOUBLE) AS population,
    coalesce(ratio, CAST(0 AS DOUBLE)) AS ratio
  FROM raw WHERE TRY_CAST(population AS DOUBLE) > 0
),
feat AS (
  SELECT *,
    coalesce(people_fully_vaccinated / nullif(population, 0), CAST(0 AS DOUBLE)) AS vaccination_coverage,
    New_deaths / nullif(population, 0) * 1000000.0::DOUBLE AS new_deaths_per_million,
    total_vaccinations / nullif(population, 0) * 100.0::DOUBLE AS total_vaccinations_per_hundred,
    CASE WHEN country IS NULL THEN CAST(0 AS DOUBLE)
         ELSE greatest(CAST(0 AS DOUBLE), coalesce(total_vaccinations - lag(total_vaccinations) OVER w, CAST(0 AS DOUBLE))) END
      AS daily_vaccinations,
    CASE WHEN country IS NULL THEN CAST(0 AS DOUBLE)
         ELSE coalesce(New_deaths / nullif(lag(New_deaths) OVER w, 0) - 1, CAST(0 AS DOUBLE)) END
      AS daily_deaths_growth_rate
  FROM clean
  WINDOW w AS (PARTITION BY country ORDER BY date, row_id)
),
prepared AS (
  SELECT row_id, country, iso_code, date, total_vaccinations, people_vaccinated,
    people_fully_vaccinated, New_deaths, population, ratio,
    vaccination_coverage, new_deaths_per_million, total_vaccinations_per_hundred,
    daily_vaccinations,
    coalesce(daily_vaccinations / nullif(population, 0) * 1000000.0::DOUBLE, CAST(0 AS DOUBLE)) AS daily_vaccinated_per_million,
    daily_deaths_growth_rate,
    CASE WHEN country IS NULL THEN CAST(0 AS DOUBLE)
         ELSE coalesce(daily_vaccinations / nullif(lag(daily_vaccinations) OVER w, 0) - 1, CAST(0 AS DOUBLE)) END
      AS daily_vaccinations_growth_rate,
    CAST(date - (SELECT min(date) FROM clean) AS INTEGER) AS days_since_start
  FROM feat
  WINDOW w AS (PARTITION BY country ORDER BY date, row_id)
)"""


def with_prepared(body: str) -> str:
    return f"WITH {PREPARED_CTES}\n{body}"


def with_raw(body: str) -> str:
    return f"WITH {RAW_CTE}\n{body}"


def with_events(body: str) -> str:
    return f"WITH {EVENTS_CTE}\n{body}"


def finalize(sql: str, doubles) -> str:
    """Publish double columns with the engine-independent rounding."""
    if not doubles:
        return sql
    repl = ", ".join(f"CAST({stable_round_sql(_q(c), dialect='duckdb')} AS DOUBLE) AS {_q(c)}" for c in doubles)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) q_final"


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
