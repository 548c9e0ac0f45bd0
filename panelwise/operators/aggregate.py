"""Aggregations, latest snapshots, joins and rankings on a prepared panel.

All per-entity aggregates are hash aggregates with map-side partial
aggregation (``groupBy().agg()``), so a hot entity is pre-combined in every
task before the shuffle.  NULL entities are dropped from every group-by, as
pandas does.  Sums of all-NULL groups are 0 (pandas), not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.columns import clamp_zero, year_month
from panelwise.operators.blocks import with_position
from panelwise.spec import DEFAULT_SPEC, PanelSpec


def _sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _keyed(df: DataFrame, *keys: str) -> DataFrame:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)


# --------------------------------------------------------------------- A1
def kpi_summary(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """A1: the ten headline figures in one row (one pass, partial aggregation)."""
    e = spec.entity
    return df.agg(
        _sum0(spec.new_deaths).alias("total_new_deaths"),
        F.max(spec.total_vaccinations).alias("max_total_vaccinations"),
        F.avg("vaccination_coverage").alias("avg_vaccination_coverage"),
        # len(unique()) counts a missing entity as one more value
        (F.count_distinct(e) + F.max(F.when(F.col(e).isNull(), 1).otherwise(0))).cast("bigint").alias("entity_count"),
        F.avg(spec.new_deaths).alias("avg_daily_deaths"),
        F.avg("new_deaths_per_million").alias("avg_deaths_per_million"),
        F.max(spec.new_deaths).alias("max_daily_deaths"),
        F.max("daily_vaccinations").alias("max_daily_vaccinations"),
        F.avg("daily_vaccinations").alias("avg_daily_vaccinations"),
        F.avg("daily_vaccinated_per_million").alias("avg_daily_vaccinated_per_million"),
    )


# --------------------------------------------------------------------- A2
def entity_comparison(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """A2: nine named aggregates per entity."""
    return (
        _keyed(df, spec.entity)
        .groupBy(spec.entity)
        .agg(
            _sum0(spec.new_deaths).alias("Total_New_Deaths"),
            F.max(spec.total_vaccinations).alias("Max_Total_Vaccinations"),
            F.avg(spec.new_deaths).alias("Avg_Daily_New_Deaths"),
            F.avg("vaccination_coverage").alias("Avg_Vaccination_Coverage"),
            F.max(spec.population).alias("Max_Population"),
            F.avg("new_deaths_per_million").alias("Avg_New_Deaths_Per_Million"),
            F.max("total_vaccinations_per_hundred").alias("Max_Total_Vaccinations_Per_Hundred"),
            F.avg("daily_vaccinations").alias("Avg_Daily_Vaccinations"),
            F.avg("daily_vaccinated_per_million").alias("Avg_Daily_Vaccinated_Per_Million"),
        )
    )


def format_entity_comparison(cmp: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """The comparison table's display strings."""
    from panelwise.functions.columns import int_with_commas, percent_two_decimals, two_decimals

    ints = ["Total_New_Deaths", "Max_Total_Vaccinations", "Max_Population", "Avg_Daily_Vaccinations"]
    decs = ["Avg_Daily_New_Deaths", "Avg_New_Deaths_Per_Million", "Max_Total_Vaccinations_Per_Hundred",
            "Avg_Daily_Vaccinated_Per_Million"]
    cols = [F.col(spec.entity)]
    cols += [int_with_commas(c).alias(c) for c in ints]
    cols += [two_decimals(c).alias(c) for c in decs]
    cols.append(percent_two_decimals("Avg_Vaccination_Coverage").alias("Avg_Vaccination_Coverage"))
    return cmp.select(*cols)


# --------------------------------------------------------------------- A3
# The figures of the latest-status table and their columns.
LATEST_STATS = (
    ("Latest_Population", "population"),
    ("Latest_Total_Vaccinations", "total_vaccinations"),
    ("Latest_People_Fully_Vaccinated", "people_fully_vaccinated"),
    ("Latest_Vaccination_Coverage", "vaccination_coverage"),
    ("Latest_New_Deaths", "New_deaths"),
    ("Latest_New_Deaths_Per_Million", "new_deaths_per_million"),
    ("Latest_Total_Vaccinations_Per_Hundred", "total_vaccinations_per_hundred"),
    ("Latest_Daily_Vaccinations", "daily_vaccinations"),
    ("Latest_Daily_Vaccinated_Per_Million", "daily_vaccinated_per_million"),
)


def order_key_sql(spec: PanelSpec = DEFAULT_SPEC) -> str:
    """(date, row id) packed into one exact, order-preserving DECIMAL(38,0):
    days * 10^19 + (row id + 2^63).  A fixed-width key keeps ``max_by`` in a
    hash aggregate (a struct key forces a sort-based aggregate)."""
    return (f"(CAST(unix_date(`{spec.date}`) AS DECIMAL(38,0)) * CAST(10000000000000000000 AS DECIMAL(38,0)) "
            f"+ (CAST(`{spec.row_id}` AS DECIMAL(38,0)) + CAST(9223372036854775808 AS DECIMAL(38,0))))")


def last_non_null(col: str, spec: PanelSpec = DEFAULT_SPEC) -> Column:
    """pandas ``groupby().last()``: the latest non-null value of one column,
    independently of the other columns (ties on date broken by row id)."""
    return F.expr(f"max_by(`{col}`, {order_key_sql(spec)}) FILTER (WHERE `{col}` IS NOT NULL)")


def latest_stats(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """A3: latest value per entity for nine metrics (partial aggregation)."""
    return (
        _keyed(df, spec.entity)
        .groupBy(spec.entity)
        .agg(*[last_non_null(src, spec).alias(name) for name, src in LATEST_STATS])
    )


# --------------------------------------------------------------------- A4
PERIOD_SUMMARY_MEASURES = (
    "Total_New_Deaths",
    "Highest_Total_Vaccinations_Reached",
    "Latest_Vaccination_Coverage",
    "Avg_New_Deaths_Per_Million",
    "Avg_Daily_Vaccinations",
)


def period_summary(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """A4: five per-entity figures for the period ("Latest" coverage is the max)."""
    return (
        _keyed(df, spec.entity)
        .groupBy(spec.entity)
        .agg(
            _sum0(spec.new_deaths).alias("Total_New_Deaths"),
            F.max(spec.total_vaccinations).alias("Highest_Total_Vaccinations_Reached"),
            F.max("vaccination_coverage").alias("Latest_Vaccination_Coverage"),
            F.avg("new_deaths_per_million").alias("Avg_New_Deaths_Per_Million"),
            F.avg("daily_vaccinations").alias("Avg_Daily_Vaccinations"),
        )
    )


def period_rankings(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, blocks: int | None = None) -> DataFrame:
    """A4's five rankings: per measure, every entity with its position (largest first, ties by name)."""
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in PERIOD_SUMMARY_MEASURES])
    long = period_summary(df, spec).select(spec.entity, F.explode(cells).alias("c")).select("c.measure", spec.entity, "c.value")
    return with_position(long, [F.desc_nulls_last("value"), F.asc(spec.entity)], ["measure"], blocks=blocks)


# --------------------------------------------------------------------- A5
def period_totals(df: DataFrame, metric: str, level: str = "month", spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """A5: per (month or year, entity) sum of ``metric`` (cumulative ones too, as is)."""
    if level == "month":
        period = year_month(spec.date)
    elif level == "year":
        period = F.year(spec.date)
    else:
        raise ValueError("level must be 'month' or 'year'")
    return (
        _keyed(df, spec.entity)
        .groupBy(period.alias("time_period"), F.col(spec.entity))
        .agg(_sum0(metric).alias(metric))
    )


# --------------------------------------------------------------------- A11/A12
def entity_list(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Distinct entities (a missing entity is dropped)."""
    return _keyed(df, spec.entity).select(spec.entity).distinct()


def date_bounds(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Entity count, first and last date, row count in one pass."""
    return df.agg(
        F.count_distinct(spec.entity).alias("n_entities"),
        F.min(spec.date).alias("first_date"),
        F.max(spec.date).alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"),
    )


# --------------------------------------------------------------------- A13/A14
# Fallbacks of the single-prediction form (mean-based defaults).
FORM_FALLBACKS = {
    "total_vaccinations": 100000.0,
    "people_vaccinated": 50000.0,
    "people_fully_vaccinated": 25000.0,
    "population": 10000000.0,
    "ratio": 0.05,
    "vaccination_coverage": 0.025,
    "New_deaths": 10.0,
}

# Fallbacks of the scenario analysis (median-based defaults).
SCENARIO_FALLBACKS = {
    "total_vaccinations": 1_000_000.0,
    "people_vaccinated": 500_000.0,
    "people_fully_vaccinated": 250_000.0,
    "population": 10_000_000.0,
    "ratio": 0.1,
    "vaccination_coverage": 0.05,
    "New_deaths": 50.0,
    "days_since_start": 365.0,
}


def mean_defaults(df: DataFrame, fallbacks: dict | None = None) -> DataFrame:
    """Per feature, the mean when the column sums to > 0, else the fallback.

    One row, one column per feature.
    """
    fb = FORM_FALLBACKS if fallbacks is None else fallbacks
    return df.agg(
        *[
            F.when(F.sum(c) > 0, F.avg(c)).otherwise(F.lit(float(v))).cast("double").alias(c)
            for c, v in fb.items()
            if c in df.columns
        ]
    )


def median_defaults(df: DataFrame, fallbacks: dict | None = None, full: DataFrame | None = None,
                    spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Per feature, the exact median (NULL-skipping) else the fallback.

    ``days_since_start`` defaults to the days between the full table's first
    date and the selection's last date.  One row.  The medians come back as a
    number per feature (:func:`~panelwise.operators.quantiles.column_quantiles`).
    """
    from panelwise.operators.quantiles import column_quantiles

    fb = SCENARIO_FALLBACKS if fallbacks is None else fallbacks
    medians = column_quantiles(df, [c for c in fb if c != "days_since_start" and c in df.columns], [0.5])
    found = {c: (medians.get(c) or [float(v)])[0] for c, v in fb.items() if c != "days_since_start"}
    last, first = df.agg(F.max(spec.date)).first()[0], (full if full is not None else df).agg(F.min(spec.date)).first()[0]
    span = float((last - first).days) if last is not None and first is not None else float(fb.get("days_since_start", 365.0))
    schema = ", ".join(f"`{c}` double" for c in [*found, "days_since_start"])
    return df.sparkSession.createDataFrame([(*found.values(), span)], schema)


# --------------------------------------------------------------------- A15/A16/J2
def cumulative_by_iso(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Total deaths per (iso code, entity); rows missing either key dropped."""
    return (
        _keyed(df, spec.iso, spec.entity)
        .groupBy(spec.iso, spec.entity)
        .agg(_sum0(spec.new_deaths).alias("Cumulative_New_Deaths"))
    )


def geo_snapshot(full: DataFrame, metric: str = "Cumulative_New_Deaths", spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Latest non-null value of every column per iso code, with (left join,
    fan-out when an iso code has several entities) A15's totals, and NULL -> 0
    on the chosen map metric.

    One scan in two levels of the same mergeable state, "last non-null value
    and its key": first per (iso code, entity), with A15's sum, then folded to
    the iso code over those few rows.  An iso code's rows of no entity add to
    its state; they make a row only where it has no entity at all.
    """
    e, iso, key = spec.entity, spec.iso, order_key_sql(spec)
    cols = [c for c in full.columns if c != iso]
    state = []
    for c in cols:
        if c != e:
            state.append(last_non_null(c, spec).alias(c))
        state.append(F.expr(f"max({key}) FILTER (WHERE `{c}` IS NOT NULL)").alias(f"_key_{c}"))
    parts = full.where(F.col(iso).isNotNull()).groupBy(iso, e).agg(*state, _sum0(spec.new_deaths).alias("_sum"))
    code = Window.partitionBy(iso)
    folded = parts.select(iso, F.col(e).alias("_entity"), F.count(e).over(code).alias("_entities"), *[F.max_by(c, f"_key_{c}").over(code).alias(c) for c in cols],
                          F.when(F.col(e).isNotNull(), F.col("_sum")).alias("Cumulative_New_Deaths"))
    out = folded.where(F.col("_entity").isNotNull() | (F.col("_entities") == 0)).select(iso, *cols, "Cumulative_New_Deaths")
    out = out.withColumn(metric, F.coalesce(F.col(metric), F.lit(0).cast(out.schema[metric].dataType)))
    if metric == "vaccination_coverage":
        # C20: percentage scale for the colour axis
        out = out.withColumn("vaccination_coverage_for_color", F.col("vaccination_coverage") * F.lit(100.0))
    return out


# --------------------------------------------------------------------- A17/J1
def latest_rows(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Every row at its entity's latest date (ties kept).

    The latest date per entity is a partial-aggregated group-by (one row per
    entity), joined back on (entity, date): AQE broadcasts it when small, so
    the panel itself is not shuffled -- unlike a window over each entity.
    """
    keyed = _keyed(df, spec.entity)
    latest = keyed.groupBy(spec.entity).agg(F.max(spec.date).alias(spec.date))
    return keyed.join(latest, on=[spec.entity, spec.date], how="left_semi")


def vaccination_status(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Fully / partially / not vaccinated over the entities' latest rows.

    Sums are one global aggregate (a single row); shares are computed in that
    row before it is stacked, so no unpartitioned window is needed.
    """
    sums = latest_rows(df, spec).agg(
        _sum0(spec.people_vaccinated).alias("v"),
        _sum0(spec.people_fully_vaccinated).alias("f"),
        _sum0(spec.population).alias("p"),
    )
    adj = F.greatest(F.col("v"), F.col("f"))
    parts = sums.select(
        F.col("f").alias("full"),
        clamp_zero(adj - F.col("f")).alias("partial"),
        clamp_zero(F.col("p") - adj).alias("none"),
    )
    pos = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(0.0))
    total = pos("full") + pos("partial") + pos("none")
    stacked = parts.select(
        F.expr(
            "stack(3, 'Fully Vaccinated', full, 'Partially Vaccinated', partial, 'Unvaccinated', none)"
        ).alias("status", "count"),
        total.alias("_total"),
    )
    return stacked.where(F.col("count") > 0).select(
        "status", "count", (F.col("count") / F.col("_total")).alias("share")
    )


# --------------------------------------------------------------------- A18
def trend_series(df: DataFrame, metric: str, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Mean of ``metric`` per (entity, date) -- the points of a trend line."""
    return (
        _keyed(df, spec.entity)
        .groupBy(spec.entity, spec.date)
        .agg(F.avg(metric).alias(metric))
    )


# --------------------------------------------------------------------- K2
def top_bottom(df: DataFrame, metric: str, n: int | None = None, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """K2: the ``n`` entities with the highest and the lowest mean ``metric``.

    Default ``n`` = 5; with fewer entities both lists hold all of them.
    Both lists are sorted descending (the bottom list is the tail of the
    descending ranking).  Each side is a TakeOrderedAndProject: a per-task
    top-n, then one merge of n rows per task.
    """
    e, n = spec.entity, 5 if n is None else int(n)
    means = _keyed(df, e).groupBy(e).agg(F.avg(metric).alias("avg_metric"))
    descending = Window.orderBy(F.desc_nulls_last("avg_metric"), F.asc(e))
    top = means.orderBy(F.desc_nulls_last("avg_metric"), F.asc(e)).limit(n)
    bottom = means.orderBy(F.asc_nulls_first("avg_metric"), F.desc(e)).limit(n)
    top, bottom = (x.withColumn("position", F.row_number().over(descending)) for x in (top, bottom))
    return top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom"))).select(
        "side", "position", e, "avg_metric"
    )


# --------------------------------------------------------------------- K3/K4
def head_sample(df: DataFrame, n: int = 10, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """K3: the first ``n`` rows in (entity, date, row id) order, with the total
    row count attached (a scalar subquery)."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (
        df.orderBy(F.asc_nulls_first(spec.entity), spec.date, spec.row_id)
        .limit(n)
        .withColumn("total_rows", total)
    )


def rank_on_date(df: DataFrame, metric: str, day=None, spec: PanelSpec = DEFAULT_SPEC, blocks: int | None = None) -> DataFrame:
    """K4: the rows of one date (default: latest) with their positions by ``metric``, largest first.

    Positions come from blocks of the sorted rows, not from one window: the
    number of entities on a date is not bounded.
    """
    from panelwise.operators.filters import on_date

    rows = on_date(df, day, spec).select(spec.entity, spec.date, spec.row_id, metric)
    return with_position(rows, [F.desc_nulls_last(metric), F.asc(spec.entity), F.asc(spec.row_id)], blocks=blocks)
