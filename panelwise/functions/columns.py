"""Scalar expressions shared by the operators.

Spark 4 runs with ANSI mode on: ``x / 0`` and bad casts raise.  Every ratio
therefore goes through ``try_divide`` and every lenient parse through
``try_cast``; no expression here ever creates NaN or +-inf.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num, den, default=None) -> Column:
    """``num / den`` with NULL (or ``default``) when ``den`` is 0 or NULL."""
    q = F.try_divide(_c(num), _c(den))
    return q if default is None else F.coalesce(q, F.lit(default))


def clamp_zero(x) -> Column:
    """``max(0, x)`` keeping NULL as NULL."""
    return F.greatest(F.lit(0.0), _c(x))


def nan_to_null(x) -> Column:
    """Map NaN to NULL so that Spark aggregates behave like pandas ones."""
    c = _c(x)
    return F.when(F.isnan(c), F.lit(None).cast(DoubleType())).otherwise(c)


def half_even_int(x) -> Column:
    """``max(0, round(x))`` with Python's half-to-even rounding, as BIGINT."""
    return F.greatest(F.lit(0), F.bround(_c(x), 0).cast("bigint"))


def int_with_commas(x) -> Column:
    """``f"{int(x):,}"``: truncate toward zero, thousands separators."""
    return F.format_number(_c(x).cast("bigint"), 0)


def two_decimals(x) -> Column:
    """``f"{x:.2f}"`` (half-even on the binary value, no separators)."""
    return F.expr(f"format_number({_sql(x)}, '0.00')")


def percent_two_decimals(x) -> Column:
    """``f"{x:.2%}"``."""
    return F.expr(f"format_number({_sql(x)}, '0.00%')")


def label_from_name(x) -> Column:
    """``name.replace('_', ' ').title()`` for snake_case column names."""
    return F.initcap(F.regexp_replace(_c(x), "_", " "))


def year_month(d) -> Column:
    """Calendar month of a date as ``yyyy-MM`` text."""
    return F.date_format(_c(d), "yyyy-MM")


def _sql(x) -> str:
    if isinstance(x, str):
        return f"`{x}`"
    raise TypeError("format helpers take a column name")
