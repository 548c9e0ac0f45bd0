"""Column-expression helpers (all JVM-side, no Python UDFs)."""

from panelwise.functions.columns import (  # noqa: F401
    safe_div,
    clamp_zero,
    nan_to_null,
    half_even_int,
    int_with_commas,
    two_decimals,
    percent_two_decimals,
    label_from_name,
    year_month,
)
from panelwise.functions.rounding import stable_round_sql, stable_round_doubles  # noqa: F401
