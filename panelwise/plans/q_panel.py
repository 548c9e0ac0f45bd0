"""Queries over the prepared panel: sources, filters, aggregates, rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelwise.operators import aggregate as agg
from panelwise.operators import filters as flt
from panelwise.operators.prepare import prepare_panel
from panelwise.plans.oracle_base import with_prepared, with_raw
from panelwise.plans.registry import PREPARED_DOUBLES, RAW_DOUBLES, panel_view, prepared, register
from panelwise.sources import read_panel_csv
from panelwise.sources.scratch import scratch_root


# ------------------------------------------------------------------ sources / prepare
@register("panel_view", with_raw("SELECT * FROM raw"), RAW_DOUBLES, ("S1",))
def q_panel_view(spark, sf_dir):
    """The raw panel built from orders x customer x nation (fixture F-C)."""
    return panel_view(spark, sf_dir)


@register("prepare_panel", with_prepared("SELECT * FROM prepared"), PREPARED_DOUBLES,
          ("F1", "C1", "C2", "C3", "C4", "C5", "C6", "C7", "C8", "C9", "W1", "W2", "W3", "J3"))
def q_prepare_panel(spark, sf_dir):
    """cleaned, typed panel with the eight derived features (derived anew, not read from the kept table)."""
    return prepare_panel(panel_view(spark, sf_dir))


# ------------------------------------------------------------------ filters
_DEFAULT_FILTER_SQL = """
, names AS (SELECT DISTINCT country FROM prepared WHERE country IS NOT NULL)
, sel AS (
  SELECT country FROM names
  WHERE CASE WHEN EXISTS (SELECT 1 FROM names WHERE country = 'United States')
             THEN country IN ('United States', 'India', 'Brazil') ELSE TRUE END
  ORDER BY country LIMIT 3)
SELECT * FROM prepared
WHERE country IN (SELECT country FROM sel)
  AND date BETWEEN (SELECT min(date) FROM prepared) AND (SELECT max(date) FROM prepared)
"""


@register("default_filter", with_prepared(_DEFAULT_FILTER_SQL), PREPARED_DOUBLES, ("P1", "P2"))
def q_default_filter(spark, sf_dir):
    """P1 with P2's defaults (first three entities, full date range)."""
    return flt.apply_default_filter(prepared(spark, sf_dir))


def _preferred_sql(preferred, n=3) -> str:
    names = ", ".join(f"'{x}'" for x in preferred)
    return f"""
, names AS (SELECT DISTINCT country FROM prepared WHERE country IS NOT NULL)
, sel AS (
  SELECT country FROM names
  WHERE country IN ({names}) AND EXISTS (SELECT 1 FROM names WHERE country = '{preferred[0]}')
  UNION ALL
  SELECT * FROM (SELECT country FROM names WHERE NOT EXISTS (SELECT 1 FROM names WHERE country = '{preferred[0]}') ORDER BY country LIMIT {n}))
SELECT * FROM prepared WHERE country IN (SELECT country FROM sel) AND date IS NOT NULL"""


#: The last one isn't in the data, as a preferred entity may not be.
_PREFERRED = ("NATION_7", "NATION_20", "NATION_99")


@register("default_filter_preferred", with_prepared(_preferred_sql(_PREFERRED)), PREPARED_DOUBLES, ("P1", "P2"))
def q_default_filter_preferred(spark, sf_dir):
    """P2's other branch: the preferred entities, where their first one exists."""
    return flt.apply_default_filter(prepared(spark, sf_dir), preferred=_PREFERRED)


@register("csv_panel", with_prepared("SELECT * FROM prepared"), PREPARED_DOUBLES, ("S1", "C1", "C3"))
def q_csv_panel(spark, sf_dir):
    """S1 + C1 + C3: the view written as CSV, its columns in another order and bad populations among them, read by its header and prepared."""
    raw = panel_view(spark, sf_dir)
    text = raw.withColumn("population", F.when(F.col("population") == 0, F.lit("not known")).otherwise(F.col("population").cast("string")))
    text = text.select("row_id", "ratio", "population", "date", "New_deaths", "iso_code", "country", "people_fully_vaccinated", "total_vaccinations", "people_vaccinated")
    path = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    text.write.option("header", True).option("nullValue", "NA").csv(path)
    return prepare_panel(read_panel_csv(spark, path))


# ------------------------------------------------------------------ aggregates
@register("kpi_summary", with_prepared("""
SELECT coalesce(sum(New_deaths), 0) AS total_new_deaths,
  max(total_vaccinations) AS max_total_vaccinations,
  avg(vaccination_coverage) AS avg_vaccination_coverage,
  CAST(count(DISTINCT country) + max(CASE WHEN country IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS entity_count,
  avg(New_deaths) AS avg_daily_deaths,
  avg(new_deaths_per_million) AS avg_deaths_per_million,
  max(New_deaths) AS max_daily_deaths,
  max(daily_vaccinations) AS max_daily_vaccinations,
  avg(daily_vaccinations) AS avg_daily_vaccinations,
  avg(daily_vaccinated_per_million) AS avg_daily_vaccinated_per_million
FROM prepared"""), ("total_new_deaths", "max_total_vaccinations", "avg_vaccination_coverage", "avg_daily_deaths",
                    "avg_deaths_per_million", "max_daily_deaths", "max_daily_vaccinations",
                    "avg_daily_vaccinations", "avg_daily_vaccinated_per_million"), ("A1", "A11"))
def q_kpi_summary(spark, sf_dir):
    """A1: headline figures."""
    return agg.kpi_summary(prepared(spark, sf_dir))


_CMP_DOUBLES = ("Total_New_Deaths", "Max_Total_Vaccinations", "Avg_Daily_New_Deaths", "Avg_Vaccination_Coverage",
                "Max_Population", "Avg_New_Deaths_Per_Million", "Max_Total_Vaccinations_Per_Hundred",
                "Avg_Daily_Vaccinations", "Avg_Daily_Vaccinated_Per_Million")
_CMP_SQL = """
SELECT country,
  coalesce(sum(New_deaths), 0) AS Total_New_Deaths,
  max(total_vaccinations) AS Max_Total_Vaccinations,
  avg(New_deaths) AS Avg_Daily_New_Deaths,
  avg(vaccination_coverage) AS Avg_Vaccination_Coverage,
  max(population) AS Max_Population,
  avg(new_deaths_per_million) AS Avg_New_Deaths_Per_Million,
  max(total_vaccinations_per_hundred) AS Max_Total_Vaccinations_Per_Hundred,
  avg(daily_vaccinations) AS Avg_Daily_Vaccinations,
  avg(daily_vaccinated_per_million) AS Avg_Daily_Vaccinated_Per_Million
FROM prepared WHERE country IS NOT NULL GROUP BY country"""


@register("entity_comparison", with_prepared(_CMP_SQL), _CMP_DOUBLES, ("A2", "P4"))
def q_entity_comparison(spark, sf_dir):
    """A2: per-entity comparison table."""
    return agg.entity_comparison(prepared(spark, sf_dir))


@register("entity_comparison_formatted", with_prepared(f"""
, cmp AS ({_CMP_SQL})
SELECT country,
  format('{{:,}}', CAST(trunc(Total_New_Deaths) AS BIGINT)) AS Total_New_Deaths,
  format('{{:,}}', CAST(trunc(Max_Total_Vaccinations) AS BIGINT)) AS Max_Total_Vaccinations,
  format('{{:,}}', CAST(trunc(Max_Population) AS BIGINT)) AS Max_Population,
  format('{{:,}}', CAST(trunc(Avg_Daily_Vaccinations) AS BIGINT)) AS Avg_Daily_Vaccinations,
  printf('%.2f', Avg_Daily_New_Deaths) AS Avg_Daily_New_Deaths,
  printf('%.2f', Avg_New_Deaths_Per_Million) AS Avg_New_Deaths_Per_Million,
  printf('%.2f', Max_Total_Vaccinations_Per_Hundred) AS Max_Total_Vaccinations_Per_Hundred,
  printf('%.2f', Avg_Daily_Vaccinated_Per_Million) AS Avg_Daily_Vaccinated_Per_Million,
  printf('%.2f%%', Avg_Vaccination_Coverage * 100) AS Avg_Vaccination_Coverage
FROM cmp"""), (), ("C15", "A2"))
def q_entity_comparison_formatted(spark, sf_dir):
    """The comparison table as display strings."""
    return agg.format_entity_comparison(agg.entity_comparison(prepared(spark, sf_dir)))


def _last_sql(col: str, alias: str | None = None) -> str:
    return (f"arg_max({col}, struct_pack(d := date, r := row_id)) FILTER (WHERE {col} IS NOT NULL)"
            f" AS {alias or col}")


@register("latest_stats", with_prepared(
    "SELECT country, "
    + ", ".join(_last_sql(src, name) for name, src in agg.LATEST_STATS)
    + " FROM prepared WHERE country IS NOT NULL GROUP BY country"),
    tuple(n for n, _ in agg.LATEST_STATS), ("A3",))
def q_latest_stats(spark, sf_dir):
    """A3: latest non-null value per entity and metric."""
    return agg.latest_stats(prepared(spark, sf_dir))


@register("period_summary", with_prepared("""
SELECT country,
  coalesce(sum(New_deaths), 0) AS Total_New_Deaths,
  max(total_vaccinations) AS Highest_Total_Vaccinations_Reached,
  max(vaccination_coverage) AS Latest_Vaccination_Coverage,
  avg(new_deaths_per_million) AS Avg_New_Deaths_Per_Million,
  avg(daily_vaccinations) AS Avg_Daily_Vaccinations
FROM prepared WHERE country IS NOT NULL GROUP BY country"""), agg.PERIOD_SUMMARY_MEASURES, ("A4",))
def q_period_summary(spark, sf_dir):
    """A4: period summary per entity."""
    return agg.period_summary(prepared(spark, sf_dir))


_RANKINGS = "\nUNION ALL ".join(
    f"SELECT '{m}' AS measure, country, {m} AS value, row_number() OVER (ORDER BY {m} DESC NULLS LAST, country) AS position FROM ps" for m in agg.PERIOD_SUMMARY_MEASURES)


@register("period_rankings", with_prepared(f"""
, ps AS (SELECT country,
  coalesce(sum(New_deaths), 0) AS Total_New_Deaths,
  max(total_vaccinations) AS Highest_Total_Vaccinations_Reached,
  max(vaccination_coverage) AS Latest_Vaccination_Coverage,
  avg(new_deaths_per_million) AS Avg_New_Deaths_Per_Million,
  avg(daily_vaccinations) AS Avg_Daily_Vaccinations
FROM prepared WHERE country IS NOT NULL GROUP BY country)
{_RANKINGS}"""), ("value",), ("A4",))
def q_period_rankings(spark, sf_dir):
    """A4: the five rankings of the period summary, with positions."""
    return agg.period_rankings(prepared(spark, sf_dir))


@register("monthly_totals", with_prepared("""
SELECT strftime(date, '%Y-%m') AS time_period, country,
  coalesce(sum(New_deaths), 0) AS New_deaths
FROM prepared WHERE country IS NOT NULL GROUP BY 1, 2"""), ("New_deaths",), ("A5", "C17"))
def q_monthly_totals(spark, sf_dir):
    """A5 (month): deaths per month and entity."""
    return agg.period_totals(prepared(spark, sf_dir), "New_deaths", "month")


@register("yearly_totals", with_prepared("""
SELECT CAST(year(date) AS INTEGER) AS time_period, country,
  coalesce(sum(total_vaccinations), 0) AS total_vaccinations
FROM prepared WHERE country IS NOT NULL GROUP BY 1, 2"""), ("total_vaccinations",), ("A5", "C17"))
def q_yearly_totals(spark, sf_dir):
    """A5 (year): summed cumulative counter per year and entity (kept as is)."""
    return agg.period_totals(prepared(spark, sf_dir), "total_vaccinations", "year")


@register("entity_list", with_prepared("SELECT DISTINCT country FROM prepared WHERE country IS NOT NULL"),
          (), ("A11",))
def q_entity_list(spark, sf_dir):
    """Distinct entities."""
    return agg.entity_list(prepared(spark, sf_dir))


@register("date_bounds", with_prepared("""
SELECT count(DISTINCT country) AS n_entities, min(date) AS first_date, max(date) AS last_date,
  count(*) AS n_rows FROM prepared"""), (), ("A11", "A12"))
def q_date_bounds(spark, sf_dir):
    """Date range, entity and row counts."""
    return agg.date_bounds(prepared(spark, sf_dir))


def _mean_default_sql() -> str:
    return ", ".join(
        f"CAST(CASE WHEN sum({c}) > 0 THEN avg({c}) ELSE {float(v)!r} END AS DOUBLE) AS {c}"
        for c, v in agg.FORM_FALLBACKS.items())


@register("mean_defaults", with_prepared(f"SELECT {_mean_default_sql()} FROM prepared"),
          tuple(agg.FORM_FALLBACKS), ("A13",))
def q_mean_defaults(spark, sf_dir):
    """Prediction-form defaults (mean if the column sums to > 0)."""
    return agg.mean_defaults(prepared(spark, sf_dir))


def _median_default_sql() -> str:
    parts = [f"CAST(coalesce(median({c}), {float(v)!r}) AS DOUBLE) AS {c}"
             for c, v in agg.SCENARIO_FALLBACKS.items() if c != "days_since_start"]
    parts.append("CAST(coalesce(CAST(max(date) - (SELECT min(date) FROM prepared) AS DOUBLE), 365.0)"
                 " AS DOUBLE) AS days_since_start")
    return ", ".join(parts)


@register("median_defaults", with_prepared(f"SELECT {_median_default_sql()} FROM prepared"),
          tuple(agg.SCENARIO_FALLBACKS), ("A14",))
def q_median_defaults(spark, sf_dir):
    """Scenario defaults (exact medians, else fallbacks)."""
    return agg.median_defaults(prepared(spark, sf_dir))


@register("cumulative_by_iso", with_prepared("""
SELECT iso_code, country, coalesce(sum(New_deaths), 0) AS Cumulative_New_Deaths
FROM prepared WHERE iso_code IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2"""),
          ("Cumulative_New_Deaths",), ("A15", "P6", "C21"))
def q_cumulative_by_iso(spark, sf_dir):
    """Cumulative deaths per (iso code, entity)."""
    return agg.cumulative_by_iso(prepared(spark, sf_dir))


_GEO_COLS = ("row_id", "country", "date") + PREPARED_DOUBLES + ("days_since_start",)


@register("geo_snapshot", with_prepared(
    ", base AS (SELECT iso_code, "
    + ", ".join(_last_sql(c) for c in _GEO_COLS)
    + " FROM prepared WHERE iso_code IS NOT NULL GROUP BY iso_code)"
    + """
, cum AS (SELECT iso_code, country, coalesce(sum(New_deaths), 0) AS Cumulative_New_Deaths
          FROM prepared WHERE iso_code IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2)
SELECT base.*, coalesce(cum.Cumulative_New_Deaths, 0) AS Cumulative_New_Deaths
FROM base LEFT JOIN cum ON base.iso_code = cum.iso_code"""),
    PREPARED_DOUBLES + ("Cumulative_New_Deaths",), ("A16", "J2", "A15", "C18"))
def q_geo_snapshot(spark, sf_dir):
    """Latest snapshot per iso code with cumulative deaths (unfiltered table)."""
    return agg.geo_snapshot(prepared(spark, sf_dir))


@register("vaccination_status", with_prepared("""
, lr AS (SELECT * FROM prepared WHERE country IS NOT NULL
         QUALIFY date = max(date) OVER (PARTITION BY country))
, s AS (SELECT coalesce(sum(people_vaccinated), 0) AS v, coalesce(sum(people_fully_vaccinated), 0) AS f,
               coalesce(sum(population), 0) AS p FROM lr)
, parts AS (SELECT f AS full_, greatest(CAST(0 AS DOUBLE), greatest(v, f) - f) AS partial_,
                   greatest(CAST(0 AS DOUBLE), p - greatest(v, f)) AS none_ FROM s)
, st AS (
  SELECT 'Fully Vaccinated' AS status, full_ AS "count", 1 AS k FROM parts
  UNION ALL SELECT 'Partially Vaccinated', partial_, 2 FROM parts
  UNION ALL SELECT 'Unvaccinated', none_, 3 FROM parts)
SELECT status, "count", "count" / (SELECT sum("count") FROM st WHERE "count" > 0) AS share
FROM st WHERE "count" > 0"""), ("count", "share"), ("A17", "J1", "P6"))
def q_vaccination_status(spark, sf_dir):
    """Latest vaccination status split."""
    return agg.vaccination_status(prepared(spark, sf_dir))


@register("trend_series", with_prepared("""
SELECT country, date, avg(vaccination_coverage) AS vaccination_coverage
FROM prepared WHERE country IS NOT NULL GROUP BY 1, 2"""), ("vaccination_coverage",), ("A18",))
def q_trend_series(spark, sf_dir):
    """Mean metric per (entity, date)."""
    return agg.trend_series(prepared(spark, sf_dir), "vaccination_coverage")


def _top_bottom_sql(metric: str) -> str:
    return with_prepared(f"""
, m AS (SELECT country, avg({metric}) AS avg_metric FROM prepared WHERE country IS NOT NULL GROUP BY country)
, lim AS (SELECT least(5, count(*)) AS n FROM m)
, t AS (SELECT 'top' AS side, CAST(row_number() OVER (ORDER BY avg_metric DESC NULLS LAST, country ASC) AS INTEGER)
               AS position, country, avg_metric FROM m)
, b0 AS (SELECT country, avg_metric,
                row_number() OVER (ORDER BY avg_metric ASC NULLS FIRST, country DESC) AS p0 FROM m)
, b AS (SELECT 'bottom' AS side,
               CAST(row_number() OVER (ORDER BY avg_metric DESC NULLS LAST, country ASC) AS INTEGER) AS position,
               country, avg_metric
        FROM b0 WHERE p0 <= (SELECT n FROM lim))
SELECT * FROM t WHERE position <= (SELECT n FROM lim)
UNION ALL SELECT * FROM b""")


for _metric in ("New_deaths", "total_vaccinations", "daily_deaths_growth_rate", "daily_vaccinations_growth_rate"):
    def _mk(metric):
        @register(f"top_bottom_{metric.lower()}", _top_bottom_sql(metric), ("avg_metric",), ("K2",))
        def _q(spark, sf_dir):
            return agg.top_bottom(prepared(spark, sf_dir), metric)
        _q.__doc__ = f"K2: top/bottom entities by mean {metric}."
    _mk(_metric)


@register("head_sample", with_prepared("""
SELECT *, (SELECT count(*) FROM prepared) AS total_rows FROM prepared
ORDER BY country NULLS FIRST, date, row_id LIMIT 10"""), PREPARED_DOUBLES, ("K3", "K1"))
def q_head_sample(spark, sf_dir):
    """K3: first ten rows in (entity, date) order plus the row count."""
    return agg.head_sample(prepared(spark, sf_dir))


@register("rank_on_latest_date", with_prepared("""
SELECT country, date, row_id, daily_vaccinations,
  row_number() OVER (ORDER BY daily_vaccinations DESC NULLS LAST, country NULLS FIRST, row_id) AS position FROM prepared
WHERE date = (SELECT max(date) FROM prepared)"""), ("daily_vaccinations",), ("K4", "P3"))
def q_rank_on_latest_date(spark, sf_dir):
    """K4: rows of the latest date with their positions by daily vaccinations."""
    return agg.rank_on_date(prepared(spark, sf_dir), "daily_vaccinations")


@register("geo_snapshot_coverage", with_prepared(
    ", base AS (SELECT iso_code, "
    + ", ".join(_last_sql(c) for c in _GEO_COLS)
    + " FROM prepared WHERE iso_code IS NOT NULL GROUP BY iso_code)"
    + """
, cum AS (SELECT iso_code, country, coalesce(sum(New_deaths), 0) AS Cumulative_New_Deaths
          FROM prepared WHERE iso_code IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2)
SELECT base.* REPLACE (coalesce(base.vaccination_coverage, 0) AS vaccination_coverage),
  cum.Cumulative_New_Deaths,
  coalesce(base.vaccination_coverage, 0) * 100.0::DOUBLE AS vaccination_coverage_for_color
FROM base LEFT JOIN cum ON base.iso_code = cum.iso_code"""),
    PREPARED_DOUBLES + ("Cumulative_New_Deaths", "vaccination_coverage_for_color"), ("A16", "C20", "J2"))
def q_geo_snapshot_coverage(spark, sf_dir):
    """A16 + C20: the map snapshot coloured by coverage in percent."""
    return agg.geo_snapshot(prepared(spark, sf_dir), metric="vaccination_coverage")
