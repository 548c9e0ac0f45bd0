"""F1 prepare_panel = C1-C9 + W1-W3.

Plan shape: one projection (typing, null filling, ratios), the rows cut into
blocks of whole or part series by sampled range boundaries
(:mod:`panelwise.operators.blocks`), one sort per block shared by both window
stages (lag of a lag), and the global first date as a scalar subquery
(evaluated once, no cross join and no unpartitioned window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, TimestampNTZType, TimestampType

from panelwise.functions.columns import clamp_zero, nan_to_null, safe_div
from panelwise.operators.blocks import BLOCK, HALO, block_window, in_blocks, with_halo
from panelwise.spec import DEFAULT_SPEC, FILL_ZERO_COLUMNS, PanelSpec


def _as_date(df: DataFrame, name: str) -> Column:
    """Strict date typing (ANSI: a malformed string raises, NULL stays NULL)."""
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, DateType):
        return c
    if isinstance(dt, (TimestampType, TimestampNTZType)):
        return c.cast("date")
    if isinstance(dt, StringType):
        return F.to_date(c)
    return c.cast("date")


def _as_double(df: DataFrame, name: str, lenient: bool) -> Column:
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, DoubleType):
        return nan_to_null(c)
    if lenient:
        # Pd.to_numeric(errors='coerce') -> try_cast (bad token -> NULL)
        return nan_to_null(F.expr(f"try_cast(`{name}` AS DOUBLE)"))
    return nan_to_null(c.cast("double"))


def clean_panel(raw: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Type dates and numbers, NULL -> 0 on the counters, keep population > 0."""
    cols = []
    for f in raw.schema.fields:
        n = f.name
        if n == spec.date:
            cols.append(_as_date(raw, n).alias(n))
        elif n == spec.population:
            cols.append(_as_double(raw, n, lenient=True).alias(n))
        elif n in FILL_ZERO_COLUMNS:
            # fillna(0); a bad token fails the load
            cols.append(F.coalesce(_as_double(raw, n, lenient=False), F.lit(0.0)).alias(n))
        else:
            cols.append(F.col(f"`{n}`"))
    # C4: dropna(population) and population > 0 (a NULL comparison rejects the row)
    return raw.select(*cols).filter(F.col(spec.population) > 0)


def add_ratio_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Coverage (NULL -> 0) and per-million / per-hundred scalings."""
    pop = F.col(spec.population)
    return (
        df.withColumn("vaccination_coverage", safe_div(spec.people_fully_vaccinated, pop, 0.0))
        .withColumn("new_deaths_per_million", safe_div(spec.new_deaths, pop) * F.lit(1_000_000.0))
        .withColumn("total_vaccinations_per_hundred", safe_div(spec.total_vaccinations, pop) * F.lit(100.0))
    )


def _per_entity(spec: PanelSpec, value: Column) -> Column:
    # pandas drops NULL group keys: a row without entity gets NaN -> 0.
    return F.when(F.col(spec.entity).isNull(), F.lit(0.0)).otherwise(value)


def growth_rate(col: str, w) -> Column:
    """pct_change with first row, 0/0 and x/0 mapped to 0."""
    return F.coalesce(safe_div(F.col(col), F.lag(col).over(w)) - F.lit(1.0), F.lit(0.0))


def add_window_features(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, blocks: int | None = None) -> DataFrame:
    """W1-W3 in blocks with a halo of two rows (the difference, and the rate of the differences)."""
    key, order = [spec.entity], spec.order()
    x = with_halo(in_blocks(df, key, order, blocks), key, order, 2)
    return _window_columns(x, spec, block_window(key, order)).where(~F.col(HALO)).drop(BLOCK, HALO)


def _window_columns(df: DataFrame, spec: PanelSpec, w) -> DataFrame:
    tv = spec.total_vaccinations
    out = df.withColumn(
        # Diff of a cumulative counter, first row 0, clamped at 0
        "daily_vaccinations",
        _per_entity(spec, clamp_zero(F.coalesce(F.col(tv) - F.lag(tv).over(w), F.lit(0.0)))),
    ).withColumn(
        "daily_vaccinated_per_million",
        F.coalesce(safe_div("daily_vaccinations", spec.population) * F.lit(1_000_000.0), F.lit(0.0)),
    ).withColumn(
        "daily_deaths_growth_rate", _per_entity(spec, growth_rate(spec.new_deaths, w))
    ).withColumn(
        # A window over the previous window's output (same spec: no new exchange)
        "daily_vaccinations_growth_rate", _per_entity(spec, growth_rate("daily_vaccinations", w))
    )
    return out


def add_days_since_start(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, origin: DataFrame | None = None) -> DataFrame:
    """Days from the global first date (scalar subquery, evaluated once)."""
    base = df if origin is None else origin
    first_day = base.select(F.min(spec.date)).scalar()
    return df.withColumn("days_since_start", F.datediff(F.col(spec.date), first_day).cast("int"))


def prepare_panel(raw: DataFrame, spec: PanelSpec = DEFAULT_SPEC, blocks: int | None = None) -> DataFrame:
    """the prepared panel every analysis starts from.

    ``blocks`` bounds the number of blocks (for tests); it never changes a row.
    """
    feats = add_window_features(add_ratio_features(clean_panel(raw, spec), spec), spec, blocks)
    return add_days_since_start(feats, spec)
