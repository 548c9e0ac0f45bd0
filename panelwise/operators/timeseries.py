"""TS1-TS3: daily regularisation, seasonal-trend decomposition, moving-average forecast."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from panelwise.sources.scratch import written
from panelwise.spec import DEFAULT_SPEC, PanelSpec

# The STL kernel runs inside Python workers: ship this module's functions with
# the task (by value) so executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: package must be on executors
    pass


# ---------------------------------------------------------------------- TS1
def daily_grid(df: DataFrame, metric: str, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """TS1: one row per entity and calendar day between its first and last
    non-null observation; missing days get 0.

    Duplicate dates (which make the reference fail) are summed first.  The
    grid is generated per entity from a two-row-per-entity aggregate, then
    joined to the (entity, date) series on both keys.
    """
    e, d = spec.entity, spec.date
    series = (
        df.where(F.col(e).isNotNull() & F.col(metric).isNotNull())
        .groupBy(e, d)
        .agg(F.sum(metric).alias(metric))
    )
    bounds = series.groupBy(e).agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"))
    grid = bounds.select(e, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias(d))
    return grid.join(series, on=[e, d], how="left").select(
        e, d, F.coalesce(F.col(metric), F.lit(0.0)).cast("double").alias(metric)
    )


# ---------------------------------------------------------------------- TS2
def _loess_fit(y: np.ndarray, xs: np.ndarray, span: int, degree: int, rw: np.ndarray) -> np.ndarray:
    """Local (degree 0/1) tricube-weighted fits of y (observed at 0..n-1) evaluated at xs.

    The LOESS step of Cleveland et al. (1990): each fit uses the ``span``
    nearest observations (the window slides inside the series at the ends,
    which also gives the one-step extrapolations), half-width widened when
    ``span`` exceeds n.  Vectorised over all evaluation points: one
    (points x span) gather per call.
    """
    y = np.asarray(y, dtype=float)
    xs = np.asarray(xs, dtype=float)
    n = len(y)
    q = min(span, n)
    left = np.clip(np.floor(xs).astype(np.int64) - (q - 1) // 2, 0, n - q)
    idx = left[:, None] + np.arange(q)[None, :]
    pos = idx.astype(float)
    h = np.maximum(xs - left, left + q - 1 - xs)
    if span > n:
        h = h + (span - n) // 2
    hh = h[:, None]
    r = np.abs(pos - xs[:, None])
    safe_h = np.where(hh > 0, hh, 1.0)
    w = np.where(r <= 0.999 * hh, (1.0 - (r / safe_h) ** 3) ** 3, 0.0)
    w = np.where(r <= 0.001 * hh, 1.0, w)
    w = np.where(hh > 0, w, 1.0) * rw[idx]
    total = w.sum(axis=1)
    ok = total > 0
    w = w / np.where(ok, total, 1.0)[:, None]
    if degree > 0:
        b = (w * pos).sum(axis=1)
        c = (w * (pos - b[:, None]) ** 2).sum(axis=1)
        use = np.sqrt(c) > 0.001 * (n - 1)
        slope = (xs - b)[:, None] * (pos - b[:, None]) / np.where(c > 0, c, 1.0)[:, None] + 1.0
        w = np.where(use[:, None], w * slope, w)
    out = (w * y[idx]).sum(axis=1)
    if not ok.all():
        # all weights zero: fall back to the nearest observation
        near = np.clip(np.rint(xs), 0, n - 1).astype(np.int64)
        out = np.where(ok, out, y[near])
    return out


def _moving_average(x: np.ndarray, length: int) -> np.ndarray:
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[length:] - c[:-length]) / length


def stl_decompose(y: np.ndarray, period: int = 7, seasonal: int = 7, trend: int | None = None,
                  low_pass: int | None = None, robust: bool = True) -> tuple:
    """Seasonal-trend decomposition by LOESS (Cleveland et al. 1990), degree 1
    smoothers, jump 1.  Returns (trend, seasonal, resid)."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    if trend is None:
        trend = int(np.ceil(1.5 * period / (1.0 - 1.5 / seasonal)))
        trend += (trend % 2) == 0
    if low_pass is None:
        low_pass = period + 1
        low_pass += (low_pass % 2) == 0
    inner, outer = (2, 15) if robust else (5, 0)
    rw = np.ones(n)
    t = np.zeros(n)
    s = np.zeros(n)
    for it in range(outer + 1):
        for _ in range(inner):
            detr = y - t
            # cycle-subseries smoothing, extended one period at each end
            c = np.zeros(n + 2 * period)
            for j in range(period):
                sub = detr[j::period]
                m = len(sub)
                if m == 0:
                    continue
                xs = np.arange(-1, m + 1, dtype=float)
                fit = _loess_fit(sub, xs, seasonal, 1, rw[j::period])
                c[j::period][: m + 2] = fit
            # low-pass filter of the cycle-subseries
            lp = _moving_average(_moving_average(_moving_average(c, period), period), 3)
            lp = _loess_fit(lp, np.arange(n, dtype=float), low_pass, 1, np.ones(n))
            s = c[period: period + n] - lp
            t = _loess_fit(y - s, np.arange(n, dtype=float), trend, 1, rw)
        if it == outer:
            break
        resid = np.abs(y - t - s)
        h = 6.0 * np.median(resid)
        if h <= 0:
            rw = np.ones(n)
        else:
            u = np.clip(resid / h, 0.0, 1.0)
            rw = (1.0 - u ** 2) ** 2
    return t, s, y - t - s


STL_MIN_POINTS = 14


def stl_by_entity(df: DataFrame, metric: str, period: int = 7, seasonal: int = 7,
                  spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """TS2: robust STL of every entity's daily series at once.

    TS1 regularises the series in Spark; ``applyInPandas`` then runs the
    decomposition per entity (one series -- bounded by the number of days --
    per group, Arrow batches in and out).  Entities with fewer than two
    periods of days are skipped, as the reference refuses them.
    """
    e, d = spec.entity, spec.date
    grid = daily_grid(df, metric, spec).select(F.col(e).cast("string").alias("entity"), d,
                                               F.col(metric).alias("observed"))
    schema = StructType([
        StructField("entity", StringType()), StructField(d, DateType()),
        StructField("observed", DoubleType()), StructField("trend", DoubleType()),
        StructField("seasonal", DoubleType()), StructField("resid", DoubleType()),
    ])

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(d)
        if len(pdf) < max(STL_MIN_POINTS, 2 * period):
            return pd.DataFrame(columns=[f.name for f in schema.fields])
        tr, se, re = stl_decompose(pdf["observed"].to_numpy(), period, seasonal)
        return pd.DataFrame({"entity": pdf["entity"].to_numpy(), d: pdf[d].to_numpy(),
                             "observed": pdf["observed"].to_numpy(), "trend": tr, "seasonal": se,
                             "resid": re})

    # An explicit hash repartition (not coalesced by AQE) keeps the Python
    # work spread over all tasks; the grouped map reuses this partitioning.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        grid.repartition(n, "entity")
        .groupBy("entity")
        .applyInPandas(decompose, schema=schema)
        .withColumnRenamed("entity", e)
    )


# ---------------------------------------------------------------------- TS3
def moving_average_forecast(df: DataFrame, metric: str, horizon: int = 7, window: int = 7,
                            spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """TS3: history plus a flat forecast (mean of the last ``window`` rows) for
    the next ``horizon`` days, per entity.

    Entities qualify with at least ``window`` distinct dates and more than
    ``window`` non-null values.  Output: entity, date, value, kind.
    """
    if not 1 <= horizon <= 30:
        raise ValueError("horizon must be between 1 and 30")
    e, d = spec.entity, spec.date
    hist = df.where(F.col(e).isNotNull() & F.col(metric).isNotNull()).select(e, d, spec.row_id, metric)
    # the last rows of each entity: every task sends at most as many as are asked for
    latest = Window.partitionBy(e).orderBy(F.desc(d), F.desc(spec.row_id))
    last = hist.withColumn("_place", F.row_number().over(latest)).where(F.col("_place") <= window + 1)
    level = last.groupBy(e).agg(F.avg(F.when(F.col("_place") <= window, F.col(metric))).alias("_level"), F.max(d).alias("_last"), F.max("_place").alias("_rows"))
    level = level.where(F.col("_rows") > window)
    # distinct dates: (entity, date) pairs are told apart in every task first
    days = df.where(F.col(e).isNotNull() & F.col(d).isNotNull()).groupBy(e).agg(F.count_distinct(d).alias("_days")).where(F.col("_days") >= window)
    level = written(level.join(days.select(e), on=e, how="left_semi"), "forecast-levels")
    future = level.select(
        e,
        F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", horizon))).alias(d),
        F.col("_level").alias("value"),
        F.lit("forecast").alias("kind"),
    )
    history = hist.join(level.select(e), on=e, how="left_semi").select(
        e, d, F.col(metric).cast("double").alias("value"), F.lit("history").alias("kind"))
    return history.unionByName(future)
