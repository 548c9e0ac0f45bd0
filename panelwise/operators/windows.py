"""Per-entity series windows (ROWS frames, ordered by date then row id).

The series are cut into blocks by sampled range boundaries
(:mod:`panelwise.operators.blocks`), so an entity of any size spreads over as
many tasks as its rows need.  Frames that look back get a halo of the rows
before the block; running totals get the exact sums of the earlier blocks
(:mod:`panelwise.operators.exact_sums`), so they don't depend on where the
blocks begin.  ``blocks`` bounds their number, for tests.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.operators.blocks import BLOCK, HALO, block_window, in_blocks, pieces, with_halo, with_prefix
from panelwise.operators.exact_sums import limbs_of
from panelwise.spec import DEFAULT_SPEC, PanelSpec

DAILY_METRICS = ("New_deaths", "daily_vaccinations")


def _null_entity_is_null(spec: PanelSpec, value: Column) -> Column:
    # pandas drops NULL group keys: a row without entity gets NaN.
    return F.when(F.col(spec.entity).isNull(), F.lit(None)).otherwise(value)


def _series(spec: PanelSpec):
    return [spec.entity], spec.order(), [spec.entity, spec.date, spec.row_id]


def _with_running_totals(rows: DataFrame, blocked: DataFrame, totals: Mapping[str, str], spec: PanelSpec) -> DataFrame:
    """Adds W4's totals to ``rows``, the blocks with or without a halo."""
    key, order, _ = _series(spec)
    own = ~F.col(HALO) if HALO in rows.columns else F.lit(True)
    w = block_window(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = limbs_of(blocked, totals)
    sums, running = {}, {}
    for i, metric in enumerate(totals):
        for j, limb in enumerate([*cut[metric].of_value(), cut[metric].not_finite()]):
            sums[f"_before_{i}_{j}"] = F.sum(limb)
            running[f"_here_{i}_{j}"] = F.sum(F.when(own, limb)).over(w)
    out = with_prefix(rows.select("*", *[c.alias(n) for n, c in running.items()]), pieces(blocked, key, **sums), key, *sums)
    out = out.withColumns({n: F.when(F.coalesce(n, n.replace("here", "before")).isNotNull(), F.coalesce(n, F.lit(0)) + F.coalesce(n.replace("here", "before"), F.lit(0)))
                           for n in running})
    found = {}
    for i, (metric, name) in enumerate(totals.items()):
        *limbs, beyond = [n for n in running if n.startswith(f"_here_{i}_")]
        value = F.when(F.col(metric).isNull(), F.lit(None)).otherwise(cut[metric].total(limbs, beyond))
        found[name] = _null_entity_is_null(spec, value)
    return out.withColumns(found).drop(*running, *sums, "_rows_before")


def running_totals(df: DataFrame, totals: Mapping[str, str], spec: PanelSpec = DEFAULT_SPEC, blocks: int | None = None) -> DataFrame:
    """Per entity, the running total of each metric (a NULL value stays NULL, like cumsum).

    ``totals`` maps a metric to the name of its total.  Each is the double
    nearest to the true sum, whatever the order in which rows are added.
    """
    key, order, names = _series(spec)
    blocked = in_blocks(df.select(*names, *totals), key, order, blocks)
    return _with_running_totals(blocked, blocked, totals, spec).select(*names, *totals.values())


def cumulative_and_rolling(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, rows: int = 7, blocks: int | None = None) -> DataFrame:
    """W4 + W5 for deaths and daily vaccinations: running totals, and means of the
    last ``rows`` rows (rows, not days; at the start of fewer)."""
    key, order, names = _series(spec)
    blocked = in_blocks(df.select(*names, spec.new_deaths, "daily_vaccinations"), key, order, blocks)
    x = with_halo(blocked, key, order, rows - 1)
    trailing = block_window(key, order).rowsBetween(-(rows - 1), Window.currentRow)
    x = x.withColumns({"Rolling_Avg_Deaths": _null_entity_is_null(spec, F.avg(spec.new_deaths).over(trailing)),
                       "Rolling_Avg_Daily_Vaccinations": _null_entity_is_null(spec, F.avg("daily_vaccinations").over(trailing))})
    totals = {spec.new_deaths: "Cumulative_New_Deaths", "daily_vaccinations": "Cumulative_Daily_Vaccinations"}
    x = _with_running_totals(x, blocked, totals, spec).where(~F.col(HALO))
    return x.select(*names, "Cumulative_New_Deaths", "Rolling_Avg_Deaths", "Cumulative_Daily_Vaccinations", "Rolling_Avg_Daily_Vaccinations")


def lag_pairs(df: DataFrame, metric: str, lag: int = 7, spec: PanelSpec = DEFAULT_SPEC, blocks: int | None = None) -> DataFrame:
    """(value at t, value ``lag`` rows earlier) per entity; incomplete pairs dropped."""
    if not 1 <= lag <= 30:
        raise ValueError("lag must be between 1 and 30")
    key, order, names = _series(spec)
    x = with_halo(in_blocks(df.select(*names, metric), key, order, blocks), key, order, lag)
    lagged = _null_entity_is_null(spec, F.lag(metric, lag).over(block_window(key, order)))
    return x.withColumn("lagged_metric", lagged).where(~F.col(HALO)).drop(BLOCK, HALO).dropna(subset=[metric, "lagged_metric"])


def lag_correlation(pairs: DataFrame, metric: str, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """W6 summary: Pearson r of each entity's lag pairs (NULL when a side is constant)."""
    x, y = F.col("lagged_metric"), F.col(metric)
    return pairs.groupBy(spec.entity).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias("lag_corr"),
    )


def daily_change(df: DataFrame, metric: str, spec: PanelSpec = DEFAULT_SPEC, blocks: int | None = None) -> DataFrame:
    """Day-over-day change of a cumulative metric (first row 0, not clamped);
    daily metrics are already changes and pass through."""
    key, order, names = _series(spec)
    if metric in DAILY_METRICS:
        return df.select(*names, F.col(metric).alias(metric))
    out_col = f"{metric}_calculated_daily_change"
    x = with_halo(in_blocks(df.select(*names, metric), key, order, blocks), key, order, 1)
    diff = F.coalesce(F.col(metric) - F.lag(metric).over(block_window(key, order)), F.lit(0.0))
    diff = F.when(F.col(spec.entity).isNull(), F.lit(0.0)).otherwise(diff)
    return x.withColumn(out_col, diff).where(~F.col(HALO)).select(*names, out_col)


def last_rows_mean(df: DataFrame, metric: str, rows: int = 7, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Mean of each entity's last ``rows`` non-null values.

    The rank limit is applied in every task before the shuffle, so at most
    ``rows`` rows a task and entity are moved.
    """
    w = Window.partitionBy(spec.entity).orderBy(F.desc(spec.date), F.desc(spec.row_id))
    return (
        df.where(F.col(spec.entity).isNotNull() & F.col(metric).isNotNull())
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= rows)
        .groupBy(spec.entity)
        .agg(F.avg(metric).alias("level"))
    )
