"""Panel and events views built from the driver's TPC-H-like tables.

The panel view is ONE SQL text used verbatim by Spark (DataFrames bound as
``{orders}``/``{customer}``/``{nation}`` parameters, no temp views) and by
DuckDB (plain table names), so both engines start from identical inputs.

orders x customer x nation collapse to one row per (nation, day):
  row_id                  nation * 1e8 + yyyymmdd
  country / iso_code      n_name / 'N' || 2-digit key; iso NULL for nation 3
  total_vaccinations      running sum of the day's order value per (nation, year)
                          -- restarts every year, so day-over-day diffs go negative
  people_vaccinated       running order count per nation
  people_fully_vaccinated running count of status 'F' orders per nation
  New_deaths              orders that day; NULL when day-of-month % 11 = 0
  population              customers of the nation * 1e6; nation 1 -> 0, nation 2 -> NULL
  ratio                   people_vaccinated / population * 100
Money is summed in whole units (floor of the price, BIGINT): every counter is
then an integer-valued double, whose sums are exact in any order, so the two
engines agree bit for bit on every total built from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

PANEL_VIEW_TEMPLATE = """
SELECT
  CAST(r.nk AS BIGINT) * 100000000 + year(r.d) * 10000 + month(r.d) * 100 + day(r.d) AS row_id,
  n.n_name AS country,
  CASE WHEN n.n_nationkey = 3 THEN NULL
       ELSE concat('N', lpad(CAST(n.n_nationkey AS STRING), 2, '0')) END AS iso_code,
  r.d AS date,
  CAST(r.tv AS DOUBLE) AS total_vaccinations,
  CAST(r.pv AS DOUBLE) AS people_vaccinated,
  CAST(r.pfv AS DOUBLE) AS people_fully_vaccinated,
  CASE WHEN day(r.d) % 11 = 0 THEN NULL ELSE CAST(r.n_orders AS DOUBLE) END AS New_deaths,
  CASE WHEN n.n_nationkey = 1 THEN CAST(0 AS DOUBLE)
       WHEN n.n_nationkey = 2 THEN CAST(NULL AS DOUBLE)
       ELSE CAST(cu.n_cust AS DOUBLE) * 1000000 END AS population,
  CASE WHEN n.n_nationkey IN (1, 2) THEN CAST(NULL AS DOUBLE)
       ELSE CAST(r.pv AS DOUBLE) / (CAST(cu.n_cust AS DOUBLE) * 1000000) * 100 END AS ratio
FROM (
  SELECT nk, d, n_orders,
    sum(price_sum) OVER (PARTITION BY nk, year(d) ORDER BY d
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tv,
    sum(n_orders) OVER (PARTITION BY nk ORDER BY d
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    sum(n_fulfilled) OVER (PARTITION BY nk ORDER BY d
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pfv
  FROM (
    SELECT c.c_nationkey AS nk,
           CAST(o.o_orderdate AS DATE) AS d,
           count(*) AS n_orders,
           sum(CAST(floor(o.o_totalprice) AS BIGINT)) AS price_sum,
           sum(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_fulfilled
    FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
    GROUP BY c.c_nationkey, CAST(o.o_orderdate AS DATE)
  ) daily
) r
JOIN {nation} n ON r.nk = n.n_nationkey
JOIN (SELECT c_nationkey AS nk, count(*) AS n_cust FROM {customer} GROUP BY c_nationkey) cu
  ON cu.nk = r.nk
"""

# events -> one row per (event_type, day): the F-D view for the time-series
# operators.  Values are summed as DECIMAL(38, 6) so both engines agree.
EVENTS_VIEW_TEMPLATE = """
SELECT
  event_type,
  CAST(ts AS DATE) AS date,
  count(*) AS n_events,
  CAST(sum(CAST(value AS DECIMAL(38, 6))) AS DOUBLE) AS value_sum
FROM {events}
GROUP BY event_type, CAST(ts AS DATE)
"""


def load_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def panel_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw panel (FIXTURES F-C) from orders, customer and nation."""
    t = load_tables(spark, sf_dir, ("orders", "customer", "nation"))
    return spark.sql(PANEL_VIEW_TEMPLATE, **t)


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events per type (FIXTURES F-D)."""
    return spark.sql(EVENTS_VIEW_TEMPLATE, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def duckdb_text(template: str) -> str:
    """The same view text with plain table names, for DuckDB."""
    return template.format(**{n: n for n in TABLES})
