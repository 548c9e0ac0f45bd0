"""Exact quantiles (linear interpolation) that no task has to hold a column or a group for.

*Whole columns* (``column_quantiles``): the order statistics of all columns
are narrowed together.  Each pass is one wide aggregate without a key: for
every order statistic sought it counts the rows below and up to two pivots and
sketches what lies between them; a handful of numbers comes back.  A pivot
that the sought rank falls on is the answer, however many rows are equal to
it.  Pivots come from the sketches, which narrow the rows between them manyfold
a pass, until they are few enough to be sorted; when a sketch doesn't help,
the pivot is the middle of the bracket in the ordered bits of a double, which
halves the 64 bits left.

*Per group* (``group_quantiles``): each group's distinct values, counted once
in every task and once after the shuffle, are sorted into blocks
(:mod:`panelwise.operators.blocks`); a value's rank is its place in its block
after the counts of the group's earlier blocks.  A hot group spreads over the
blocks that its distinct values need.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from panelwise.functions.columns import nan_to_null
from panelwise.operators.blocks import BLOCK, block_window, in_blocks

#: Steps of the first sketch's grid (one a column) and of later ones (one an order statistic).
GRID = 400
INNER_GRID = 32
#: Rank error of a sketch: one part in so many, none up to that many rows.
ACCURACY = 2000
#: Once at most so many values lie between the pivots, they are sorted.
SORTED_VALUES = 1000


# ---------------------------------------------------------------------- ordered bits
def to_bits(x: float) -> int:
    """A double's place in the order of all doubles, as a signed 64-bit number."""
    n = struct.unpack("<q", struct.pack("<d", x))[0]
    return n if n >= 0 else -(n & 0x7FFFFFFFFFFFFFFF)


def from_bits(n: int) -> float:
    return struct.unpack("<d", struct.pack("<q", n))[0] if n >= 0 else -struct.unpack("<d", struct.pack("<q", -n))[0]


# ---------------------------------------------------------------------- whole columns
@dataclass
class _Sought:
    """One order statistic: ``below`` rows lie up to ``lo``, ``inside`` between ``lo`` and ``hi`` (both exclusive)."""

    column: str
    rank: int
    lo: float
    hi: float
    below: int
    inside: int
    #: quantiles of ``grid_rows`` rows that come after ``grid_below`` others
    grid: list[float] | None
    grid_below: int
    grid_rows: int
    halve: bool = False
    found: float | None = None

    def pivots(self) -> tuple[float, float]:
        if self.grid and not self.halve:
            steps = len(self.grid) - 1
            at = (self.rank - self.grid_below + 1) / self.grid_rows * steps
            slack = 0 if self.grid_rows <= ACCURACY else 1
            pair = [self.grid[min(max(i, 0), steps)] for i in (math.floor(at) - slack, math.ceil(at) + slack)]
            pair = [p for p in pair if self.lo < p < self.hi]
            if pair:
                return pair[0], pair[-1]
        middle = from_bits((to_bits(self.lo) + to_bits(self.hi)) // 2)
        return middle, middle

    def narrowed(self, p: float, q: float, counts: Sequence[int], grid: list[float] | None) -> None:
        """Take the counts of rows below p, up to p, below q and up to q."""
        before, (lt_p, le_p, lt_q, le_q) = self.inside, counts
        if lt_p <= self.rank < le_p:
            self.found = p
        elif lt_q <= self.rank < le_q:
            self.found = q
        elif self.rank < lt_p:
            self.hi, self.inside = p, lt_p - self.below
        elif self.rank >= le_q:
            self.inside -= le_q - self.below
            self.lo, self.below = q, le_q
        else:
            self.lo, self.hi, self.below, self.inside = p, q, le_p, lt_q - le_p
            self.grid, self.grid_below, self.grid_rows = grid, le_p, lt_q - le_p
        self.halve = self.found is None and 2 * self.inside > before


def _value(column: str) -> str:
    x = f"CAST(`{column}` AS DOUBLE)"
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


def _sketch(x: str, steps: int) -> str:
    return f"percentile_approx({x}, array({', '.join(f'{k / steps!r}D' for k in range(steps + 1))}), {ACCURACY})"


def _number(x: float) -> str:
    return f"double('{x!r}')" if math.isinf(x) else f"({x!r}D)"


def column_quantiles(df: DataFrame, cols: Iterable[str], probs: Sequence[float]) -> dict[str, list[float] | None]:
    """Per column, its exact quantiles; None for a column without values (NULL and NaN are skipped).

    What comes back to the driver a pass is a few numbers and a sketch's grid
    for each (column, quantile).  ``df`` is read once a pass, three times for
    some 100,000 rows, six for 10^9: keep it as a table if it is dear.
    """
    cols = list(cols)
    row = df.agg(*[F.expr(e) for c in cols for e in (f"count({_value(c)})", _sketch(_value(c), GRID))]).first() if cols else []
    state: dict[tuple[str, int], _Sought] = {}
    sizes = {}
    for i, c in enumerate(cols):
        n, grid = row[2 * i], row[2 * i + 1]
        sizes[c] = n
        # the infinities are values like others, but no pivot lies beyond them
        lo, hi = from_bits(to_bits(-math.inf) - 1), from_bits(to_bits(math.inf) + 1)
        if n and not math.isinf(grid[0]) and not math.isinf(grid[-1]):
            lo, hi = -math.inf, math.inf
        for p in probs if n else []:
            for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                state.setdefault((c, rank), _Sought(c, rank, lo, hi, 0, n, list(grid), 0, n))
    while open_ := [s for s in state.values() if s.found is None]:
        aggs: dict[tuple, str] = {}
        asked = []
        for s in open_:
            v = _value(s.column)
            if s.inside <= SORTED_VALUES and math.isfinite(s.lo) and math.isfinite(s.hi):
                key = (s.column, "sorted", s.lo, s.hi)
                aggs[key] = f"sort_array(collect_list(CASE WHEN {v} > {_number(s.lo)} AND {v} < {_number(s.hi)} THEN {v} END))"
                asked.append((s, key))
                continue
            p, q = s.pivots()
            keys = [(s.column, op, at) for at in (p, q) for op in ("<", "<=")]
            aggs |= {key: f"count_if({v} {key[1]} {_number(key[2])})" for key in keys}
            if p < q:
                aggs[s.column, "in", p, q] = _sketch(f"CASE WHEN {v} > {_number(p)} AND {v} < {_number(q)} THEN {v} END", INNER_GRID)
            asked.append((s, p, q, keys))
        got = dict(zip(aggs, df.agg(*[F.expr(e) for e in aggs.values()]).first()))
        for s, *rest in asked:
            if len(rest) == 1:
                s.found = got[rest[0]][s.rank - s.below]
                continue
            p, q, keys = rest
            grid = got.get((s.column, "in", p, q))
            s.narrowed(p, q, [got[k] for k in keys], list(grid) if grid else None)
    found = {}
    for c in cols:
        values = []
        for p in probs if sizes[c] else []:
            place = p * (sizes[c] - 1)
            a, b = state[c, math.floor(place)].found, state[c, math.ceil(place)].found
            values.append(a if a == b else a + (b - a) * (place - math.floor(place)))
        found[c] = values or None
    return found


# ---------------------------------------------------------------------- per group
def value_counts_in_blocks(df: DataFrame, group: str, value: str, blocks: int | None = None) -> DataFrame:
    """(group, value, n) of all rows with both, sorted into blocks; a table that is read more than once."""
    d = df.select(F.col(group).alias(group), nan_to_null(F.col(f"`{value}`").cast("double")).alias("v"))
    counts = d.where(F.col(group).isNotNull() & F.col("v").isNotNull()).groupBy(group, "v").agg(F.count("*").alias("n"))
    return in_blocks(counts, [group], [F.asc("v")], blocks)


def group_quantiles(counts: DataFrame, group: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Per group of ``value_counts_in_blocks``: ``n`` and its exact quantiles, one column each."""
    whole = Window.partitionBy(group)
    before = whole.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(group, BLOCK).agg(F.sum("n").alias("_part")).select(
        group, BLOCK, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_before"), F.sum("_part").over(whole).alias("_all"))
    # the join and the ranks share one shuffle by (group, block)
    here = block_window([group], [F.asc("v")]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.join(parts, [group, BLOCK]).withColumn("_upto", F.col("_before") + F.sum("n").over(here))
    aggs = [F.max("_all").alias("n")]
    for i, p in enumerate(probs):
        place = F.lit(float(p)) * (F.col("_all") - 1).cast("double")
        aggs += [F.min(F.when(F.col("_upto") > F.floor(place), F.col("v"))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("_upto") > F.ceil(place), F.col("v"))).alias(f"_hi{i}")]
    picked = ranked.groupBy(group).agg(*aggs)
    values = []
    for i, (p, name) in enumerate(zip(probs, names)):
        place = F.lit(float(p)) * (F.col("n") - 1).cast("double")
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        values.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return picked.select(group, "n", *values)
