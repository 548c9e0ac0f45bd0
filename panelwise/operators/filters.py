"""Selections on the prepared panel."""

from __future__ import annotations

import datetime as _dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwise.spec import DEFAULT_SPEC, PanelSpec

# The reference's preferred default selection.
PREFERRED_DEFAULT_ENTITIES = ("United States", "India", "Brazil")


def filter_panel(
    df: DataFrame,
    entities: Iterable | DataFrame | None = None,
    start=None,
    end=None,
    spec: PanelSpec = DEFAULT_SPEC,
) -> DataFrame:
    """Entity in the selection AND start <= date <= end (both inclusive).

    ``entities`` may be a Python list (an IN list) or a one-column DataFrame
    of selected keys; the latter becomes a left-semi join that AQE turns into
    a broadcast only when the selection is small at run time.
    """
    out = df
    if isinstance(entities, DataFrame):
        key = entities.columns[0]
        sel = entities.select(F.col(key).alias(spec.entity)).distinct()
        out = out.join(sel, on=spec.entity, how="left_semi")
    elif entities is not None:
        out = out.filter(F.col(spec.entity).isin(list(entities)))
    if start is not None:
        out = out.filter(F.col(spec.date) >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col(spec.date) <= F.lit(end).cast("date"))
    return out


def default_selection(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, n: int = 3,
                      preferred: Sequence[str] = PREFERRED_DEFAULT_ENTITIES) -> DataFrame:
    """P2 as a DataFrame: those of ``preferred`` that exist when its first one does,
    else the first ``n`` entities in (entity) order; plus the full date range.

    Columns: entity, start, end.  At most ``n`` rows, or as many as ``preferred``.
    """
    e = spec.entity
    names = df.select(e).where(F.col(e).isNotNull()).distinct()
    has_preferred = names.where(F.col(e) == preferred[0]).exists()
    chosen = names.where(F.when(has_preferred, F.col(e).isin(list(preferred))).otherwise(F.lit(True))).orderBy(e).limit(max(n, len(preferred)))
    # without the preferred ones, the first n only
    chosen = chosen.withColumn("_place", F.row_number().over(Window.orderBy(e))).where(has_preferred | (F.col("_place") <= n)).drop("_place")
    bounds = df.select(F.struct(F.min(spec.date).alias("start"), F.max(spec.date).alias("end"))).scalar()
    return chosen.select(e, bounds.getField("start").alias("start"), bounds.getField("end").alias("end"))


def default_filters(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, n: int = 3, preferred: Sequence[str] = PREFERRED_DEFAULT_ENTITIES):
    """P2 as Python values (a few names and two dates reach the driver)."""
    rows = default_selection(df, spec, n, preferred).collect()
    if not rows:
        return [], (None, None)
    return [r[spec.entity] for r in rows], (rows[0]["start"], rows[0]["end"])


def apply_default_filter(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC, n: int = 3, preferred: Sequence[str] = PREFERRED_DEFAULT_ENTITIES) -> DataFrame:
    """P1 with P2's defaults, inside one plan.

    The default range runs from the table's first date to its last, so it
    holds every dated row: it is applied as that, without a pass for the bounds.
    """
    sel = default_selection(df, spec, n, preferred).select(spec.entity)  # a few rows
    return df.where(F.col(spec.date).isNotNull()).join(F.broadcast(sel), on=spec.entity, how="left_semi")


def on_date(df: DataFrame, day: _dt.date | str | None = None, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """Rows of one date (default: the latest date present)."""
    if day is None:
        target = df.select(F.max(spec.date)).scalar()
    else:
        target = F.lit(day).cast("date")
    return df.filter(F.col(spec.date) == target)


def is_empty(df: DataFrame) -> bool:
    """P5: the empty-result guard, evaluated only at the API edge."""
    return df.isEmpty()


def non_null_keys(df: DataFrame, *cols: str) -> DataFrame:
    """Rows whose key columns are all present."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return df.filter(cond)


def positive(df: DataFrame, col: str) -> DataFrame:
    """Rows with a positive count."""
    return df.filter(F.col(col) > 0)


def pairwise_complete(df: DataFrame, *cols: str) -> DataFrame:
    """Rows where every listed column is non-null."""
    return df.dropna(subset=list(cols))
