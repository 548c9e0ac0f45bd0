"""Sums of doubles that don't depend on the order of the rows.

A double is a whole multiple of a power of two.  Over a column whose smallest
and largest magnitudes are known, each value is cut into limbs of 20 bits,
whole numbers that BIGINT sums add exactly in any order, in any number of
blocks; the limbs of a sum are then put together and rounded once, to the
double nearest to the true sum.  A column of whole numbers needs a limb or
two, one of fractions about five; every range of doubles works.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

#: Bits of a limb: the sums of 2^42 rows stay within a BIGINT.
BITS = 20
MASK = (1 << BITS) - 1


@dataclass(frozen=True)
class Limbs:
    """How the values of a column are cut: ``count`` limbs, the lowest worth ``2 ** low``."""

    column: str
    low: int
    count: int

    def _scaled(self, limb: int) -> str:
        e = -(self.low + BITS * limb)
        return f"rint({_x(self.column)} * {_pow2(e // 2)} * {_pow2(e - e // 2)})"

    def of_value(self) -> list[Column]:
        """The limbs of a row's value; null where it is null or not finite."""
        found = []
        for i in range(self.count):
            whole = self._scaled(i)
            if i + 1 < self.count:
                whole = f"({whole} - {float(1 << BITS)!r}D * {self._scaled(i + 1)})"
                # a value this large is a multiple of the next limb
                top = self.low + BITS * (i + 1) + 53
                if top < 1024:
                    whole = f"CASE WHEN abs({_x(self.column)}) >= {_pow2(top)} THEN 0D ELSE {whole} END"
            found.append(F.expr(f"CASE WHEN {_finite(self.column)} THEN CAST({whole} AS BIGINT) END"))
        return found

    def not_finite(self) -> Column:
        return F.expr(f"CASE WHEN NOT {_finite(self.column)} THEN {_x(self.column)} END")

    def total(self, sums: list[str], beyond: str) -> Column:
        """The double nearest to the sum with these limb sums; ``beyond`` sums what isn't finite."""
        limbs = ", ".join([f"coalesce({s}, 0L)" for s in sums] + ["0L"] * 3)
        carried = ("aggregate({limbs}, named_struct('c', 0L, 'd', CAST(array() AS ARRAY<BIGINT>)), "
                   f"(a, t) -> named_struct('c', shiftright(a.c + t, {BITS}), 'd', concat(a.d, array((a.c + t) & {MASK}L))))")
        plus, minus = carried.format(limbs=f"array({limbs})"), carried.format(limbs=f"transform(array({limbs}), t -> -t)")
        # from the top: three digits, the next one, and whether anything is left below
        step = ("named_struct('i', q.i - 1, 'n', CASE WHEN q.n = 0 AND d = 0 THEN 0 ELSE least(q.n + 1, 4) END, "
                f"'a', CASE WHEN q.n < 3 THEN q.a * {1 << BITS}L + d ELSE q.a END, "
                "'b', CASE WHEN q.n = 3 THEN d ELSE q.b END, 'x', CASE WHEN q.n = 3 THEN q.i - 1 ELSE q.x END, "
                "'s', CASE WHEN q.n = 4 AND d <> 0 THEN 1L ELSE q.s END)")
        size = self.count + 3
        halves = [(self.low + BITS * x - 1) for x in range(size)]
        first, second = (", ".join(_pow2(e) for e in es) for es in ([h // 2 for h in halves], [h - h // 2 for h in halves]))
        # one rounding: both summands are exact, and a one below them stands for all that is left
        value = (f"CASE WHEN r.n < 4 THEN CAST(r.a AS DOUBLE) * 2D ELSE CAST(r.a AS DOUBLE) * {float(1 << BITS + 1)!r}D + "
                 f"CAST(2L * ((r.a - CAST(CAST(r.a AS DOUBLE) AS BIGINT)) * {1 << BITS}L + r.b) + r.s AS DOUBLE) END "
                 f"* element_at(array({first}), r.x + 1) * element_at(array({second}), r.x + 1)")
        magnitude = (f"aggregate(reverse({{digits}}), named_struct('i', {size}, 'n', 0, 'a', 0L, 'b', 0L, 'x', 0, 's', 0L), "
                     f"(q, d) -> {step}, r -> {value})")
        signed = (f"CASE WHEN p.c < 0 THEN -({magnitude.format(digits=f'({minus}).d')}) ELSE {magnitude.format(digits='p.d')} END")
        # p: the digits with their sign, worked out once
        return F.expr(f"CASE WHEN {beyond} IS NOT NULL THEN {beyond} ELSE transform(array({plus}), p -> {signed})[0] END")


def _x(column: str) -> str:
    return f"CAST(`{column}` AS DOUBLE)"


def _finite(column: str) -> str:
    return f"(abs({_x(column)}) < double('Infinity'))"


def _pow2(e: int) -> str:
    return f"{math.ldexp(1.0, e)!r}D"


def limbs_of(df: DataFrame, columns: Iterable[str]) -> dict[str, Limbs]:
    """How to cut each column: one aggregate of the magnitudes, three numbers a column."""
    columns, aggs = list(columns), []
    for c in columns:
        size = f"CASE WHEN {_finite(c)} AND {_x(c)} <> 0D THEN abs({_x(c)}) END"
        aggs += [F.expr(f"max({size})"), F.expr(f"min({size})"), F.expr(f"coalesce(max(CASE WHEN {_finite(c)} THEN {_x(c)} <> rint({_x(c)}) END), false)")]
    row, found = df.agg(*aggs).first(), {}
    for i, c in enumerate(columns):
        largest, smallest, fractions = row[3 * i:3 * i + 3]
        if largest is None:
            found[c] = Limbs(c, 0, 1)
            continue
        low = max(math.frexp(smallest)[1] - 53, -1074)
        low = low if fractions else max(low, 0)
        found[c] = Limbs(c, low, max(1, -(-(math.frexp(largest)[1] - low) // BITS)))
    return found
