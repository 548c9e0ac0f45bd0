"""Engine-independent rounding of floating-point results.

Aggregates over doubles (sums, means, deviations) depend on the order in
which rows are added, so two engines -- or two Spark runs with different
partitioning -- can differ in the last bits.  Results are therefore
published with 9 significant digits.  The rounding is spelled out as
IEEE arithmetic -- ``round(x * 1e{d}, 0) / 1e{d}`` -- rather than
``round(x, d)``: the built-in rounds the shortest decimal string in Spark but
the binary value in DuckDB, which disagree on exact decimal ties.  Scaling by
an exact power of ten, rounding to an integer and scaling back is the same
sequence of operations in both engines, so the two dialect spellings below
give bit-identical outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

SIGNIFICANT_DIGITS = 9
_TOP_EXP = 18
_BOTTOM_EXP = -30


def stable_round_sql(col: str, digits: int = SIGNIFICANT_DIGITS, dialect: str = "spark") -> str:
    """SQL text rounding ``col`` to ``digits`` significant digits.

    The decimal exponent k = floor(log10|x|) picks an exact power of ten from
    a literal array; then x is scaled, rounded to an integer and scaled back
    with plain IEEE operations.  (Where log10 could differ in the last bit
    between engines, x is within ~1e-15 of a power of ten and both possible
    k round it to that same power.)  Whole
    numbers below 2^53 are published as they are; |x| < 1e-30 publishes +0.0.
    """
    k = f"CAST(least(greatest(floor(log10(abs({col}))), {_BOTTOM_EXP}), {_TOP_EXP}) AS INT)"
    top_small = digits - 1  # k <= digits-1: multiply by 10**(digits-1-k)
    ups = ", ".join(f"1e{d}" for d in range(0, digits - 1 - _BOTTOM_EXP + 1))
    downs = ", ".join(f"1e{e}" for e in range(1, _TOP_EXP - (digits - 1) + 1))
    if dialect == "spark":
        up = f"element_at(array({ups}), {digits - 1} - {k} + 1)"
        down = f"element_at(array({downs}), {k} - {digits - 1})"
    else:
        up = f"list_extract([{ups}]::DOUBLE[], {digits - 1} - {k} + 1)"
        down = f"list_extract([{downs}]::DOUBLE[], {k} - {digits - 1})"
    return (
        f"CASE WHEN {col} IS NULL THEN NULL "
        f"WHEN {col} = floor({col}) AND abs({col}) < 9007199254740992 THEN CAST({col} AS DOUBLE) "
        f"WHEN abs({col}) < 1e{_BOTTOM_EXP} THEN CAST(0 AS DOUBLE) "
        f"WHEN {k} <= {top_small} THEN round({col} * {up}, 0) / {up} "
        f"ELSE round({col} / {down}, 0) * {down} END"
    )


def stable_round_doubles(df: DataFrame, digits: int = SIGNIFICANT_DIGITS) -> DataFrame:
    """Apply :func:`stable_round_sql` to every floating-point column."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(F.expr(stable_round_sql(f"`{f.name}`", digits, "spark")).cast("double").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)
