"""Queries for profiling (A6-A10) and distributions."""

from __future__ import annotations

from itertools import combinations

from panelwise.operators import distribution as dist
from panelwise.operators import profile as prof
from panelwise.plans.oracle_base import with_prepared, with_raw
from panelwise.plans.registry import panel_view, prepared, register
from panelwise.spec import CORRELATION_COLUMNS, DERIVED_COLUMNS, RAW_COLUMNS

DESCRIBE_COLUMNS = [c for c in RAW_COLUMNS + DERIVED_COLUMNS if c not in ("row_id", "country", "iso_code", "date")]
PREPARED_TYPES = {"row_id": "bigint", "country": "string", "iso_code": "string", "date": "date",
                  "days_since_start": "int"}


def _describe_sql() -> str:
    parts = []
    for c in DESCRIBE_COLUMNS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count({x}) AS DOUBLE) AS \"count\", avg({x}) AS mean, "
            f"stddev_samp({x}) AS std, min({x}) AS \"min\", quantile_cont({x}, 0.25) AS q25, "
            f"quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75, max({x}) AS \"max\" FROM prepared")
    return "\n" + "\nUNION ALL ".join(parts)


@register("describe", with_prepared(_describe_sql()),
          ("count", "mean", "std", "min", "q25", "q50", "q75", "max"), ("A6", "C19"))
def q_describe(spark, sf_dir):
    """A6 + C19: descriptive statistics of every numeric column of the schema."""
    return prof.describe(prepared(spark, sf_dir))


def _corr_sql() -> str:
    cols = list(CORRELATION_COLUMNS)
    aggs = []
    for a, b in combinations(cols, 2):
        f = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        aggs.append(f"covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) {f} / nullif("
                    f"stddev_samp(CAST({a} AS DOUBLE)) {f} * stddev_samp(CAST({b} AS DOUBLE)) {f}, 0) AS \"{a}__{b}\"")
    for a in cols:
        aggs.append(f"CASE WHEN var_samp(CAST({a} AS DOUBLE)) > 0 THEN CAST(1 AS DOUBLE) END AS \"{a}__{a}\"")
    sel = []
    for a in cols:
        for b in cols:
            src = f"{a}__{b}" if (a == b or cols.index(a) < cols.index(b)) else f"{b}__{a}"
            sel.append(f"SELECT '{a}' AS x, '{b}' AS y, \"{src}\" AS r FROM w")
    return f"\n, w AS (SELECT {', '.join(aggs)} FROM prepared)\n" + "\nUNION ALL ".join(sel)


@register("correlation_matrix", with_prepared(_corr_sql()), ("r",), ("A7",))
def q_correlation_matrix(spark, sf_dir):
    """Pearson correlation matrix (long form) of the 14 key columns."""
    return prof.correlation_matrix(prepared(spark, sf_dir))


def _profile_sql() -> str:
    cols = list(RAW_COLUMNS + DERIVED_COLUMNS)
    return "\n" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{PREPARED_TYPES.get(c, 'double')}' AS dtype, count({c}) AS non_null, "
        f"count(DISTINCT {c}) AS \"unique\" FROM prepared" for c in cols)


@register("column_profile", with_prepared(_profile_sql()), (), ("A8",))
def q_column_profile(spark, sf_dir):
    """Type, non-null and distinct counts per column."""
    return prof.column_profile(prepared(spark, sf_dir))


@register("null_counts", with_raw("\nSELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing FROM raw" for c in RAW_COLUMNS)
    + ") t WHERE missing > 0"), (), ("A9",))
def q_null_counts(spark, sf_dir):
    """Missing values per raw column (only columns with some)."""
    return prof.null_counts(panel_view(spark, sf_dir))


_MISS_COLS = [c for c in RAW_COLUMNS if c not in ("country", "date")]


@register("missingness", with_raw(
    "\n, m AS (SELECT country, strftime(date, '%Y-%m') AS month, count(*) AS \"rows\", "
    + ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::DOUBLE AS {c}" for c in _MISS_COLS)
    + " FROM raw GROUP BY 1, 2)\n"
    + "\nUNION ALL ".join(f"SELECT country, month, \"rows\", '{c}' AS \"column\", {c} AS missing_share FROM m"
                          for c in _MISS_COLS)), ("missing_share",), ("A10",))
def q_missingness(spark, sf_dir):
    """A10: missing share per (entity, month, column) of the raw panel."""
    return prof.missingness(panel_view(spark, sf_dir))


_CELLS = [c for c in RAW_COLUMNS if c != "row_id"]


@register("missing_cells", with_raw("\nSELECT row_id, " + ", ".join(f"{c} IS NULL AS {c}" for c in _CELLS) + " FROM raw"), (), ("A10",))
def q_missing_cells(spark, sf_dir):
    """A10 at full resolution: the row-by-column missingness matrix of the raw panel."""
    return prof.missing_cells(panel_view(spark, sf_dir))


def _bin_sql(x: str, lo: str, hi: str, k: str) -> str:
    step = f"(({hi} - {lo}) / {k})"
    i0 = f"least(floor(({x} - {lo}) * ({k} / ({hi} - {lo}))), {k} - 1)"
    i1 = f"(CASE WHEN {x} < {lo} + {i0} * {step} THEN {i0} - 1 ELSE {i0} END)"
    i2 = f"(CASE WHEN {x} >= {lo} + ({i1} + 1) * {step} AND {i1} <> {k} - 1 THEN {i1} + 1 ELSE {i1} END)"
    return f"CAST({i2} AS INTEGER)"


@register("histogram", with_prepared(f"""
, st0 AS (SELECT min(CAST(New_deaths AS DOUBLE)) AS lo0, max(CAST(New_deaths AS DOUBLE)) AS hi0, count(*) AS n
          FROM prepared)
, st AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi,
                CAST(least(30, n) AS INTEGER) AS k FROM st0 WHERE lo0 IS NOT NULL)
, c AS (SELECT {_bin_sql('CAST(New_deaths AS DOUBLE)', 'st.lo', 'st.hi', 'st.k')} AS bin, count(*) AS "count"
        FROM prepared, st WHERE New_deaths IS NOT NULL GROUP BY 1)
, b AS (SELECT CAST(i AS INTEGER) AS bin, lo, hi, k FROM st, range(0, 30) r(i) WHERE i < k)
SELECT b.bin, b.lo + b.bin * ((b.hi - b.lo) / b.k) AS lower,
  CASE WHEN b.bin = b.k - 1 THEN b.hi ELSE b.lo + (b.bin + 1) * ((b.hi - b.lo) / b.k) END AS upper,
  CAST(coalesce(c."count", 0) AS BIGINT) AS "count"
FROM b LEFT JOIN c ON b.bin = c.bin"""), ("lower", "upper"), ("A19",))
def q_histogram(spark, sf_dir):
    """30-bin histogram of daily deaths."""
    return dist.histogram(prepared(spark, sf_dir), "New_deaths", 30)


def _kde_sql(col: str, by: str | None, cut: float, grid: int = 200) -> str:
    grp = by if by else "'all'"
    out = by if by else "\"group\""
    return with_prepared(f"""
, base AS (SELECT {grp} AS grp, CAST({col} AS DOUBLE) AS x FROM prepared
           WHERE {col} IS NOT NULL AND {grp} IS NOT NULL)
, st AS (SELECT grp, count(*) AS n, stddev_samp(x) AS sd, min(x) AS xmin, max(x) AS xmax FROM base GROUP BY grp
         HAVING count(*) >= 2 AND stddev_samp(x) > 0)
, st2 AS (SELECT grp, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, xmin, xmax FROM st)
, st3 AS (SELECT grp, n, bw, xmin - bw * {cut!r}::DOUBLE AS g_lo, xmax + bw * {cut!r}::DOUBLE AS g_hi FROM st2)
, vals AS (SELECT grp, x, count(*) AS mult FROM base GROUP BY grp, x)
, grid AS (SELECT grp, n, bw, i,
             CASE WHEN i = {grid - 1} THEN g_hi ELSE g_lo + i * ((g_hi - g_lo) / {grid - 1}) END AS gx
           FROM st3, range(0, {grid}) r(i))
SELECT grid.grp AS {out}, CAST(i AS INTEGER) AS grid_index, gx AS x,
  sum(mult * exp(-0.5 * ((gx - vals.x) / bw) * ((gx - vals.x) / bw))) / (n * bw * 2.5066282746310002::DOUBLE)
    AS density
FROM grid JOIN vals ON grid.grp = vals.grp
GROUP BY grid.grp, i, gx, n, bw""")


@register("kde_by_entity", _kde_sql("New_deaths", "country", 3.0), ("x", "density"), ("A20", "P4"))
def q_kde_by_entity(spark, sf_dir):
    """Per-entity Gaussian KDE of daily deaths (200-point grid, cut 3)."""
    return dist.kde(prepared(spark, sf_dir), "New_deaths", by="country", cut=3.0)


@register("kde_overall", _kde_sql("vaccination_coverage", None, 0.0), ("x", "density"), ("A20",))
def q_kde_overall(spark, sf_dir):
    """KDE overlay of the coverage histogram (no cut beyond the data)."""
    return dist.kde(prepared(spark, sf_dir), "vaccination_coverage", by=None, cut=0.0)


def _nan_null(e: str) -> str:
    return f"CASE WHEN isnan({e}) THEN NULL ELSE {e} END"


_REG = ("CAST(regr_count(New_deaths, vaccination_coverage) AS BIGINT) AS n, "
        + _nan_null("regr_slope(New_deaths, vaccination_coverage)") + " AS slope, "
        + _nan_null("regr_intercept(New_deaths, vaccination_coverage)") + " AS intercept, "
        + _nan_null("regr_r2(New_deaths, vaccination_coverage)") + " AS r2")


@register("regression_lines", with_prepared(f"""
SELECT country, {_REG} FROM prepared WHERE country IS NOT NULL GROUP BY country
UNION ALL SELECT CAST(NULL AS VARCHAR) AS country, {_REG} FROM prepared"""), ("slope", "intercept", "r2"),
          ("A21", "G1"))
def q_regression_lines(spark, sf_dir):
    """Least-squares line deaths ~ coverage per entity and overall."""
    return dist.regression_lines(prepared(spark, sf_dir), "vaccination_coverage", "New_deaths")


_BOX_CTE = """
, d AS (SELECT country, CAST(daily_vaccinations AS DOUBLE) AS v FROM prepared
        WHERE country IS NOT NULL AND daily_vaccinations IS NOT NULL)
, q AS (SELECT country, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
               quantile_cont(v, 0.75) AS q3 FROM d GROUP BY country)
, q2 AS (SELECT country, n, q1, median, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence,
                q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)"""


@register("box_stats", with_prepared(_BOX_CTE + """
SELECT q2.*, w.whisker_low, w.whisker_high, w.n_outliers FROM q2 JOIN (
  SELECT d.country,
    min(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END) AS whisker_low,
    max(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END) AS whisker_high,
    count(*) FILTER (WHERE NOT (v BETWEEN lower_fence AND upper_fence)) AS n_outliers
  FROM d JOIN q2 ON d.country = q2.country GROUP BY d.country) w ON q2.country = w.country"""),
          ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high"), ("A22",))
def q_box_stats(spark, sf_dir):
    """Box-plot statistics of daily vaccinations per entity."""
    return dist.box_stats(prepared(spark, sf_dir), "daily_vaccinations")


@register("box_outliers", with_prepared(_BOX_CTE + """
SELECT p.country, p.date, p.row_id, p.daily_vaccinations FROM prepared p JOIN q2 ON p.country = q2.country
WHERE p.daily_vaccinations < q2.lower_fence OR p.daily_vaccinations > q2.upper_fence"""),
          ("daily_vaccinations",), ("A22",))
def q_box_outliers(spark, sf_dir):
    """The outlier rows of daily vaccinations."""
    return dist.box_outliers(prepared(spark, sf_dir), "daily_vaccinations")


def _axis_sql(cols, bins: int) -> tuple[str, dict]:
    aggs = ", ".join(f"min(CAST({c} AS DOUBLE)) AS {c}__lo0, max(CAST({c} AS DOUBLE)) AS {c}__hi0" for c in cols)
    fix = ", ".join(f"CASE WHEN {c}__lo0 = {c}__hi0 THEN {c}__lo0 - 0.5 ELSE {c}__lo0 END AS {c}__lo, "
                    f"CASE WHEN {c}__lo0 = {c}__hi0 THEN {c}__hi0 + 0.5 ELSE {c}__hi0 END AS {c}__hi" for c in cols)
    idx = {c: _bin_sql(f"CAST({c} AS DOUBLE)", f"st.{c}__lo", f"st.{c}__hi", str(bins)) for c in cols}
    return aggs, fix, idx


def _scatter_sql(x: str, y: str, bins: int) -> str:
    aggs, fix, idx = _axis_sql([x, y], bins)
    return with_prepared(f"""
, d AS (SELECT * FROM prepared WHERE {x} IS NOT NULL AND {y} IS NOT NULL)
, st AS (SELECT {fix} FROM (SELECT {aggs} FROM d) t)
SELECT {idx[x]} AS x_bin, {idx[y]} AS y_bin, count(*) AS "count" FROM d, st GROUP BY 1, 2""")


@register("scatter_bins", _scatter_sql("vaccination_coverage", "New_deaths", 50), (), ("G1",))
def q_scatter_bins(spark, sf_dir):
    """G1: deaths vs coverage scatter as 50x50 bin counts."""
    return dist.scatter_bins(prepared(spark, sf_dir), "vaccination_coverage", "New_deaths", 50)


PAIR_COLUMNS = ["New_deaths", "daily_vaccinations", "vaccination_coverage", "population"]


def _pair_sql(cols, bins: int, by: str = "") -> str:
    aggs, fix, idx = _axis_sql(cols, bins)
    nn = " AND ".join(f"{c} IS NOT NULL" for c in [*cols, *([by] if by else [])])
    keys = f"{by}, " if by else ""
    sel = "\nUNION ALL ".join(
        f"SELECT {keys}'{a}' AS x, '{b}' AS y, {idx[a]} AS x_bin, {idx[b]} AS y_bin, count(*) AS \"count\" "
        f"FROM d, st GROUP BY ALL" for a, b in combinations(cols, 2))
    return with_prepared(f"""
, d AS (SELECT * FROM prepared WHERE {nn})
, st AS (SELECT {fix} FROM (SELECT {aggs} FROM d) t)
{sel}""")


@register("pair_bins", _pair_sql(PAIR_COLUMNS, 20), (), ("G2",))
def q_pair_bins(spark, sf_dir):
    """Pair-plot clouds of four metrics as 20x20 bin counts per pair."""
    return dist.pair_bins(prepared(spark, sf_dir), PAIR_COLUMNS, 20)


@register("pair_bins_by_entity", _pair_sql(PAIR_COLUMNS, 20, "country"), (), ("G2",))
def q_pair_bins_by_entity(spark, sf_dir):
    """G2 with the entity as its colour: 20x20 bin counts per pair and entity."""
    return dist.pair_bins(prepared(spark, sf_dir), PAIR_COLUMNS, 20, by="country")


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in [*PAIR_COLUMNS, "country"])


@register("pair_diagonal", _kde_sql("New_deaths", "country", 3.0).replace("FROM prepared\n           WHERE", f"FROM prepared\n           WHERE {_COMPLETE} AND"),
          ("x", "density"), ("G2", "A20"))
def q_pair_diagonal(spark, sf_dir):
    """G2's diagonal: per entity, the density of one metric over the rows that have all of them."""
    return dist.pair_diagonal(prepared(spark, sf_dir), PAIR_COLUMNS, "New_deaths", by="country")


_TITLE = ("array_to_string(list_transform(string_split(replace(\"column\", '_', ' '), ' '), "
          "lambda w: upper(w[1]) || lower(w[2:])), ' ')")


@register("describe_labeled", with_prepared(f"""
, d AS ({_describe_sql()})
SELECT {_TITLE} AS label, d.* FROM d"""), ("count", "mean", "std", "min", "q25", "q50", "q75", "max"),
          ("A6", "C16"))
def q_describe_labeled(spark, sf_dir):
    """A6 + C16: descriptive statistics with display labels ('New Deaths Per Million')."""
    from pyspark.sql import functions as F

    from panelwise.functions.columns import label_from_name

    d = prof.describe(prepared(spark, sf_dir), DESCRIBE_COLUMNS)
    return d.select(label_from_name(F.col("column")).alias("label"), "*")
