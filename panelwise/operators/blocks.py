"""Series cut into blocks by sampled range boundaries.

A series is the rows of one key in a given order.  The rows of all series are
sorted by (key, order) into range partitions, whose boundaries Spark samples
from the rows themselves, and each partition is a block: a hot key, or a hot
date within it, spreads over as many blocks as its rows need, and small keys
share one.  What a window function needs from outside its block is carried:

* a *halo*, the last ``k`` rows before a block, copied into it (frames that
  look back ``k`` rows);
* a *prefix state*, what the key's earlier blocks add up to (running totals,
  positions).

Only a block's first key can have rows in earlier blocks, and only its last
key in later ones, so halos and prefix states are tables of at most one row
(or ``k``) a block and are broadcast by that bound.  There is one plan at all
sizes; block boundaries never change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from panelwise.sources.scratch import written

BLOCK = "_block"
HALO = "_halo"


def in_blocks(df: DataFrame, key: Sequence[str], order: Sequence[Column], blocks: int | None = None) -> DataFrame:
    """``df`` with its block number, written once.  ``blocks`` (for tests): at most so many blocks."""
    by = [F.asc_nulls_first(k) for k in key] + list(order)
    placed = df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)
    return written(placed.withColumn(BLOCK, F.spark_partition_id()), "blocks")


def block_window(key: Sequence[str], order: Sequence[Column]) -> WindowSpec:
    return Window.partitionBy(*key, BLOCK).orderBy(*order)


def pieces(blocked: DataFrame, key: Sequence[str], **sums: Column) -> DataFrame:
    """One row a (key, block): its rows, the key's rows and ``sums`` in earlier blocks, and its number within the key."""
    parts = blocked.groupBy(*key, BLOCK).agg(F.count("*").alias("_rows"), *[c.alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*key).orderBy(BLOCK) if key else Window.orderBy(BLOCK)  # without a key: one row a block
    before = earlier.rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*key, BLOCK, "_rows", F.row_number().over(earlier).alias("_number"),
                        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
                        *[F.sum(n).over(before).alias(n) for n in sums])


def _renamed(parts: DataFrame, key: Sequence[str], prefix: str, columns: dict[str, str]) -> DataFrame:
    return parts.select(*[F.col(c).alias(f"{prefix}{c}") for c in key], *[F.col(c).alias(n) for c, n in columns.items()])


def _same(key: Sequence[str], a: str, b: str) -> Column:
    found = F.lit(True)
    for k in key:
        found = found & F.col(f"{a}{k}").eqNullSafe(F.col(f"{b}{k}"))
    return found


def with_halo(blocked: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Adds to each block the ``k`` rows of its first key that come before it, marked ``_halo``."""
    columns, parts = blocked.columns, pieces(blocked, key)
    later = _renamed(parts.where("_rows_before > 0"), key, "_to_", {BLOCK: "_to", "_number": "_to_number", "_rows_before": "_to_before"})
    later = F.broadcast(later)  # at most one row a block
    parts = _renamed(parts, key, "_of_", {BLOCK: "_of", "_number": "_number", "_rows": "_rows", "_rows_before": "_rows_before"})
    goes_on = parts.join(later, _same(key, "_of_", "_to_") & (F.col("_to_number") == F.col("_number") + 1), "left_semi")
    # the last k rows of each block's last key, where the key goes on
    last = (blocked.join(F.broadcast(goes_on), _same(key, "", "_of_") & (F.col(BLOCK) == F.col("_of")))
            .withColumn("_place", F.row_number().over(block_window(key, order)))
            .withColumn("_left", F.col("_rows") - F.col("_place")).where(F.col("_left") < k))
    # the rows between one of them and a later block's first: those left in its block, and those of the blocks between
    between = F.col("_left") + F.col("_to_before") - F.col("_rows_before") - F.col("_rows")
    halo = last.join(later, _same(key, "_of_", "_to_") & (F.col("_to_number") > F.col("_number")) & (F.col("_to_number") <= F.col("_number") + k)
                     & (between < k))
    halo = halo.select(*[F.col("_to").alias(BLOCK) if c == BLOCK else F.col(c) for c in columns], F.lit(True).alias(HALO))
    return blocked.withColumn(HALO, F.lit(False)).unionByName(halo)


def with_prefix(rows: DataFrame, parts: DataFrame, key: Sequence[str], *sums: str) -> DataFrame:
    """Adds ``_rows_before`` and ``sums`` of ``pieces`` to each row; null in a key's first block."""
    parts = _renamed(parts.where("_rows_before > 0"), key, "_of_", {BLOCK: "_of", **{c: c for c in ("_rows_before", *sums)}})
    joined = rows.join(F.broadcast(parts), _same(key, "", "_of_") & (F.col(BLOCK) == F.col("_of")), "left")  # at most one row a block
    return joined.drop("_of", *[f"_of_{c}" for c in key])


def with_position(df: DataFrame, order: Sequence[Column], key: Sequence[str] = (), name: str = "position", blocks: int | None = None) -> DataFrame:
    """Adds each row's place, from 1, in the order of all rows (of its key), without a task that holds them all."""
    blocked = in_blocks(df, key, order, blocks)
    placed = with_prefix(blocked, pieces(blocked, key), key).withColumn("_place", F.row_number().over(block_window(key, order)))
    return placed.withColumn(name, (F.coalesce("_rows_before", F.lit(0)) + F.col("_place")).cast("long")).drop("_rows_before", "_place", BLOCK)
