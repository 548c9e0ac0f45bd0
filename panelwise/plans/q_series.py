"""Queries over per-entity series: windows (W4-W8) and time series (TS1-TS3)."""

from __future__ import annotations

from panelwise.operators import timeseries as ts
from panelwise.operators import windows as win
from panelwise.plans.oracle_base import with_events, with_prepared
from panelwise.plans.registry import PREPARED_DOUBLES, prepared, prepared_table, register
from panelwise.sources.driver_views import events_view
from panelwise.spec import PanelSpec

_W = "PARTITION BY country ORDER BY date, row_id"

_ROLLING_SQL = f"""
SELECT country, date, row_id,
  CASE WHEN country IS NULL OR New_deaths IS NULL THEN NULL
       ELSE sum(New_deaths) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS Cumulative_New_Deaths,
  CASE WHEN country IS NULL THEN NULL
       ELSE avg(New_deaths) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS Rolling_Avg_Deaths,
  CASE WHEN country IS NULL OR daily_vaccinations IS NULL THEN NULL
       ELSE sum(daily_vaccinations) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END
    AS Cumulative_Daily_Vaccinations,
  CASE WHEN country IS NULL THEN NULL
       ELSE avg(daily_vaccinations) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END
    AS Rolling_Avg_Daily_Vaccinations
FROM """
_ROLLING_DOUBLES = ("Cumulative_New_Deaths", "Rolling_Avg_Deaths", "Cumulative_Daily_Vaccinations",
                    "Rolling_Avg_Daily_Vaccinations")

@register("cumulative_rolling", with_prepared(_ROLLING_SQL + "prepared"), _ROLLING_DOUBLES, ("W4", "W5", "K1"))
def q_cumulative_rolling(spark, sf_dir):
    """W4 + W5: running totals and 7-row trailing means per entity."""
    return win.cumulative_and_rolling(prepared(spark, sf_dir))


#: A selection as a page makes it: some entities, a range of dates inside the panel's.
_ENTITIES, _START, _END = ("NATION_0", "NATION_10", "NATION_12", "NATION_15"), "1996-03-01", "1999-10-31"
_FILTERED = f"""
, filtered AS (SELECT * FROM prepared WHERE country IN {_ENTITIES}
               AND date BETWEEN DATE '{_START}' AND DATE '{_END}')"""


def _filtered(spark, sf_dir):
    return prepared_table(spark, sf_dir).read(_ENTITIES, _START, _END)


#: Multiples of 2^-64 add up exactly as HUGEINT; the sum is rounded once, from a 63-bit head and the rest.
_EXACT = 64
_FRACTIONS_SQL = f"""
, s AS (SELECT country, date, row_id, new_deaths_per_million AS m,
          sum(CAST(new_deaths_per_million * {2.0 ** _EXACT!r}::DOUBLE AS HUGEINT)) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t
        FROM prepared)
, h AS (SELECT *, CAST(t // {2 ** 24} AS DOUBLE) AS head FROM s)
SELECT country, date, row_id, CASE WHEN country IS NULL OR m IS NULL THEN NULL
  ELSE (head * {2.0 ** 24!r}::DOUBLE + CAST(t - CAST(head AS HUGEINT) * {2 ** 24} AS DOUBLE)) / {2.0 ** _EXACT!r}::DOUBLE END AS running_deaths_per_million
FROM h"""


@register("running_fractions", with_prepared(_FRACTIONS_SQL), ("running_deaths_per_million",), ("W4",), exact=True)
def q_running_fractions(spark, sf_dir):
    """W4 of a fractional metric: each total is the double nearest to the true sum, bit for bit."""
    return win.running_totals(prepared(spark, sf_dir), {"new_deaths_per_million": "running_deaths_per_million"})


@register("filtered_panel", with_prepared(_FILTERED + "\nSELECT * FROM filtered"), PREPARED_DOUBLES, ("P1", "S3"))
def q_filtered_panel(spark, sf_dir):
    """P1 on S3's kept table, whose other years aren't opened: chosen entities and dates; features come from the whole panel, so the first kept day has its difference."""
    return _filtered(spark, sf_dir)


@register("filtered_cumulative_rolling", with_prepared(_FILTERED + _ROLLING_SQL + "filtered"), _ROLLING_DOUBLES,
          ("P1", "W4", "W5"))
def q_filtered_cumulative_rolling(spark, sf_dir):
    """W4 + W5 on P1's rows: running totals restart at the selection's first day."""
    return win.cumulative_and_rolling(_filtered(spark, sf_dir))


_LAG_SQL = f"""
, pairs AS (
  SELECT * FROM (
    SELECT country, date, row_id, New_deaths,
      CASE WHEN country IS NULL THEN NULL ELSE lag(New_deaths, 7) OVER ({_W}) END AS lagged_metric
    FROM prepared) t
  WHERE New_deaths IS NOT NULL AND lagged_metric IS NOT NULL)"""


@register("lag_pairs", with_prepared(_LAG_SQL + "\nSELECT * FROM pairs"), ("New_deaths", "lagged_metric"),
          ("W6", "P7"))
def q_lag_pairs(spark, sf_dir):
    """7-row lag pairs of daily deaths."""
    return win.lag_pairs(prepared(spark, sf_dir), "New_deaths", 7)


@register("filtered_lag_pairs", with_prepared(
    _FILTERED + _LAG_SQL.replace("FROM prepared", "FROM filtered") + "\nSELECT * FROM pairs"),
          ("New_deaths", "lagged_metric"), ("P1", "W6", "P7"))
def q_filtered_lag_pairs(spark, sf_dir):
    """W6 on P1's rows: lags reach back to the selection's first day only."""
    return win.lag_pairs(_filtered(spark, sf_dir), "New_deaths", 7)


@register("lag_correlation", with_prepared(_LAG_SQL + """
SELECT country, count(*) AS n_pairs,
  covar_samp(lagged_metric, New_deaths) / nullif(stddev_samp(lagged_metric) * stddev_samp(New_deaths), 0) AS lag_corr
FROM pairs GROUP BY country"""), ("lag_corr",), ("W6",))
def q_lag_correlation(spark, sf_dir):
    """W6 summary: lag-7 autocorrelation per entity."""
    return win.lag_correlation(win.lag_pairs(prepared(spark, sf_dir), "New_deaths", 7), "New_deaths")


@register("daily_change", with_prepared(f"""
SELECT country, date, row_id,
  CASE WHEN country IS NULL THEN CAST(0 AS DOUBLE)
       ELSE coalesce(people_vaccinated - lag(people_vaccinated) OVER ({_W}), CAST(0 AS DOUBLE)) END
    AS people_vaccinated_calculated_daily_change
FROM prepared"""), ("people_vaccinated_calculated_daily_change",), ("W7",))
def q_daily_change(spark, sf_dir):
    """Unclamped day-over-day change of a cumulative counter."""
    return win.daily_change(prepared(spark, sf_dir), "people_vaccinated")


@register("forecast_level", with_prepared("""
SELECT country, avg(New_deaths) AS level FROM (
  SELECT country, New_deaths,
    row_number() OVER (PARTITION BY country ORDER BY date DESC, row_id DESC) AS rn
  FROM prepared WHERE country IS NOT NULL AND New_deaths IS NOT NULL) t
WHERE rn <= 7 GROUP BY country"""), ("level",), ("W8",))
def q_forecast_level(spark, sf_dir):
    """Mean of each entity's last seven rows."""
    return win.last_rows_mean(prepared(spark, sf_dir), "New_deaths", 7)


@register("daily_grid", with_prepared("""
, s AS (SELECT country, date, sum(New_deaths) AS New_deaths FROM prepared
        WHERE country IS NOT NULL AND New_deaths IS NOT NULL GROUP BY country, date)
, b AS (SELECT country, min(date) AS lo, max(date) AS hi FROM s GROUP BY country)
, g AS (SELECT country, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY))
                             AS DATE) AS date FROM b)
SELECT g.country, g.date, CAST(coalesce(s.New_deaths, 0) AS DOUBLE) AS New_deaths
FROM g LEFT JOIN s ON g.country = s.country AND g.date = s.date"""), ("New_deaths",), ("TS1",))
def q_daily_grid(spark, sf_dir):
    """TS1: daily deaths per entity on a gap-free calendar (missing days = 0)."""
    return ts.daily_grid(prepared(spark, sf_dir), "New_deaths")


_FORECAST_SQL = """
, hist AS (SELECT country, date, row_id, New_deaths FROM {panel}
           WHERE country IS NOT NULL AND New_deaths IS NOT NULL)
, qual AS (SELECT country FROM {panel} WHERE country IS NOT NULL GROUP BY country
           HAVING count(DISTINCT date) >= 7 AND count(New_deaths) > 7)
, lvl AS (SELECT country, avg(New_deaths) AS level, max(date) AS last_d FROM (
            SELECT *, row_number() OVER (PARTITION BY country ORDER BY date DESC, row_id DESC) AS rn FROM hist) t
          WHERE rn <= 7 GROUP BY country)
SELECT country, date, CAST(New_deaths AS DOUBLE) AS value, 'history' AS kind
FROM hist WHERE country IN (SELECT country FROM qual)
UNION ALL
SELECT country, CAST(last_d + CAST(i + 1 AS INTEGER) AS DATE) AS date, level AS value, 'forecast' AS kind
FROM lvl, range(0, {days}) r(i) WHERE country IN (SELECT country FROM qual)"""


@register("ma_forecast", with_prepared(_FORECAST_SQL.format(panel="prepared", days=7)), ("value",), ("TS3", "W8", "C10"))
def q_ma_forecast(spark, sf_dir):
    """TS3: history + 7-day moving-average forecast per entity."""
    return ts.moving_average_forecast(prepared(spark, sf_dir), "New_deaths", 7)


@register("filtered_forecast", with_prepared(_FILTERED + _FORECAST_SQL.format(panel="filtered", days=14)), ("value",), ("TS3", "P1", "C10"))
def q_filtered_forecast(spark, sf_dir):
    """TS3 on P1's rows: the forecast starts after the selection's last day."""
    return ts.moving_average_forecast(_filtered(spark, sf_dir), "New_deaths", 14)


_EVENTS = PanelSpec(entity="event_type", date="date", row_id="date")


@register("events_forecast", with_events("""
, hist AS (SELECT event_type, date, n_events FROM ev WHERE event_type IS NOT NULL AND n_events IS NOT NULL)
, qual AS (SELECT event_type FROM ev WHERE event_type IS NOT NULL GROUP BY event_type
           HAVING count(DISTINCT date) >= 7 AND count(n_events) > 7)
, lvl AS (SELECT event_type, avg(n_events) AS level, max(date) AS last_d FROM (
            SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date DESC) AS rn FROM hist) t
          WHERE rn <= 7 GROUP BY event_type)
SELECT event_type, date, CAST(n_events AS DOUBLE) AS value, 'history' AS kind
FROM hist WHERE event_type IN (SELECT event_type FROM qual)
UNION ALL
SELECT event_type, CAST(last_d + CAST(i + 1 AS INTEGER) AS DATE) AS date, level AS value, 'forecast' AS kind
FROM lvl, range(0, 7) r(i) WHERE event_type IN (SELECT event_type FROM qual)"""), ("value",), ("TS3",))
def q_events_forecast(spark, sf_dir):
    """TS3 on the events view (daily event counts per type)."""
    return ts.moving_average_forecast(events_view(spark, sf_dir), "n_events", 7, spec=_EVENTS)


@register("stl_events", None, (), ("TS2", "TS1"))
def q_stl_events(spark, sf_dir):
    """TS2: robust STL (weekly) of daily event counts per event type (rows-only)."""
    return ts.stl_by_entity(events_view(spark, sf_dir), "n_events", spec=_EVENTS)


@register("stl_decomposition", None, (), ("TS2", "TS1"))
def q_stl_decomposition(spark, sf_dir):
    """TS2: robust STL (weekly) of every entity's daily deaths (rows-only)."""
    return ts.stl_by_entity(prepared(spark, sf_dir), "New_deaths")
