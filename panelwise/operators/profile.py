"""Column statistics, correlations, profiles and missingness.

Statistics over many columns are computed as wide aggregates (partial
aggregation in every task) and stacked to long form afterwards.  Only exact
distinct counts take the rows apart, into (column number, value) pairs that
each task counts before the shuffle.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, FractionalType, IntegralType, NumericType

from panelwise.functions.columns import nan_to_null, year_month
from panelwise.operators.quantiles import column_quantiles
from panelwise.spec import CORRELATION_COLUMNS, DEFAULT_SPEC, PanelSpec


def numeric_columns(df: DataFrame, exclude=("row_id",)) -> list[str]:
    """Numeric columns from the schema (the row id is an index, not data)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


# ---------------------------------------------------------------------- A6
def describe(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, std (ddof 1), min, quartiles (linear interpolation), max
    per numeric column, one row per column.

    Moments come from one wide aggregate, the quartiles from
    :func:`column_quantiles`; what comes back is a few numbers per column.
    ``exact=False`` takes the quartiles of ``percentile_approx`` instead.
    """
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = nan_to_null(F.col(f"`{c}`").cast("double"))
        aggs += [F.count(x).cast("double"), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)]
        aggs += [] if exact else [F.percentile_approx(x, [0.25, 0.5, 0.75], 100000)]
    row, width = df.agg(*aggs).first(), 5 if exact else 6
    quarts = column_quantiles(df, cols, [0.25, 0.5, 0.75]) if exact else {c: row[width * i + 5] for i, c in enumerate(cols)}
    rows = []
    for i, c in enumerate(cols):
        n, mean, std, least, most = row[width * i:width * i + 5]
        rows.append((c, n, mean, std, least, *(quarts[c] or (None,) * 3), most))
    return df.sparkSession.createDataFrame(rows, "column string, count double, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


# ---------------------------------------------------------------------- A7
def correlation_matrix(df: DataFrame, cols=CORRELATION_COLUMNS) -> DataFrame:
    """Pairwise-complete Pearson r for every ordered column pair, long form
    (x, y, r).  A column that is constant where both are present gives NULL
    (not an error, not NaN), and so does a pair never seen together; the
    diagonal is 1.0 when the column varies.

    One wide aggregate finds each column's mean, range and missing values; a
    second adds up, about those means, one product per pair and one square per
    column.  A pair needs sums of its own only where one of its columns has
    missing values.  The sums of tasks merge by addition; nothing is expanded
    by pair, and one row is shuffled a task.
    """
    cols = list(cols)
    n = len(cols)
    x = [nan_to_null(F.col(f"`{c}`").cast("double")) for c in cols]
    first = df.agg(F.count(F.lit(1)), *[e for v in x for e in (F.count(v), F.avg(v), F.min(v), F.max(v))]).first()
    rows = first[0]
    full = [first[1 + 4 * i] == rows for i in range(n)]
    varies = [first[3 + 4 * i] is not None and first[3 + 4 * i] < first[4 + 4 * i] for i in range(n)]
    src = df.select(*[(v - F.lit(first[2 + 4 * i] or 0.0)).alias(f"d{i}") for i, v in enumerate(x)])
    d = [F.col(f"d{i}") for i in range(n)]
    sums = {(i,): (F.sum(d[i]), F.sum(d[i] * d[i])) for i in range(n)}
    for i, j in combinations(range(n), 2):
        both = d[i].isNotNull() & d[j].isNotNull()
        sums[i, j] = (F.sum(d[i] * d[j]),)
        if not (full[i] and full[j]):
            a, b = F.when(both, d[i]), F.when(both, d[j])
            sums[i, j] += (F.count_if(both), F.sum(a), F.sum(b), F.sum(a * a), F.sum(b * b), F.min(a) < F.max(a), F.min(b) < F.max(b))
    row = src.agg(*[e.alias(f"s{k}") for k, e in enumerate(e for es in sums.values() for e in es)])
    got = iter(row.first())
    value = {k: [next(got) for _ in es] for k, es in sums.items()}
    found = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                found.append((a, b, 1.0 if varies[i] else None))
                continue
            lo, hi = min(i, j), max(i, j)
            own = value[lo, hi][1:]
            count, sa, sb, qa, qb, va, vb = own or (rows, value[(lo,)][0], value[(hi,)][0], value[(lo,)][1], value[(hi,)][1], varies[lo], varies[hi])
            if not count or not va or not vb:
                found.append((a, b, None))
                continue
            spread = (qa - sa * sa / count) * (qb - sb * sb / count)
            found.append((a, b, (value[lo, hi][0] - sa * sb / count) / math.sqrt(spread) if spread > 0 else None))
    return df.sparkSession.createDataFrame(found, "x string, y string, r double")


# ---------------------------------------------------------------------- A8
def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Type, non-null count and distinct count for every column.

    Exact distinct counts are found in two stages: (column number, value)
    pairs are counted, in every task and again after a shuffle by the pair, so
    that a common value or a column of few values is no hot key; the pairs of
    a column are then counted.  ``approx=True`` uses HyperLogLog sketches
    (fixed-size buffers, no value shuffle) for very large tables.
    """
    cols, types = df.columns, {f.name: f.dataType for f in df.schema.fields}
    if approx:
        wide = df.agg(*[e for c in cols for e in (F.count(F.col(f"`{c}`")).alias(f"{c}__non_null"),
                                                 F.approx_count_distinct(F.col(f"`{c}`"), rsd=0.01).alias(f"{c}__unique"))])
    else:
        # a value in the one of three slots that holds its type exactly
        slots = {"l": (IntegralType, DateType, BooleanType), "d": (FractionalType,)}
        cells = []
        for i, c in enumerate(cols):
            at = next((s for s, kinds in slots.items() if isinstance(types[c], kinds) and not isinstance(types[c], DecimalType)), "s")
            v = F.unix_date(F.col(f"`{c}`")) if isinstance(types[c], DateType) else F.col(f"`{c}`")
            values = [(v if s == at else F.lit(None)).cast(k).alias(s) for s, k in (("l", "bigint"), ("d", "double"), ("s", "string"))]
            cells.append(F.struct(F.lit(i).alias("i"), *values))
        pairs = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("l IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL")
        pairs = pairs.groupBy("i", "l", "d", "s").agg(F.count("*").alias("n"))
        per = pairs.groupBy("i").agg(F.sum("n").alias("non_null"), F.count("*").alias("unique"))
        wide = per.agg(*[e for i, c in enumerate(cols) for e in (F.coalesce(F.max(F.when(F.col("i") == i, F.col("non_null"))), F.lit(0)).alias(f"{c}__non_null"),
                                                              F.coalesce(F.max(F.when(F.col("i") == i, F.col("unique"))), F.lit(0)).alias(f"{c}__unique"))])
    items = ", ".join(f"'{c}', '{types[c].simpleString()}', `{c}__non_null`, `{c}__unique`" for c in cols)
    return wide.select(F.expr(f"stack({len(cols)}, {items})").alias("column", "dtype", "non_null", "unique"))


# ---------------------------------------------------------------------- A9
def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, only columns with some, most first."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    items = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = wide.select(F.expr(f"stack({len(cols)}, {items})").alias("column", "missing"))
    return long.where(F.col("missing") > 0).orderBy(F.desc("missing"), "column")


# ---------------------------------------------------------------------- A10
def missingness(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """A10: share of missing values per (entity, month, column) -- the
    row-by-column missingness matrix summarised at a size that does not grow
    with the row count."""
    cols = [c for c in df.columns if c not in (spec.entity, spec.date)]
    wide = df.groupBy(F.col(spec.entity), year_month(spec.date).alias("month")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in cols],
    )
    items = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select(spec.entity, "month", "rows",
                       F.expr(f"stack({len(cols)}, {items})").alias("column", "missing_share"))


def missing_cells(df: DataFrame, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """A10 at full resolution: the boolean matrix itself (row id x column)."""
    cols = [c for c in df.columns if c != spec.row_id]
    return df.select(spec.row_id, *[F.col(f"`{c}`").isNull().alias(c) for c in cols])
