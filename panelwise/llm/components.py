"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Links never leave the cluster: each round is two joins with a min per node,
combined before the shuffle, and is written to the shared folder.  A node
with very many links is a skewed key of a plain sort-merge join only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.shared import written


#: Links in a file of a round's table, and files at least.
LINKS_A_FILE, MIN_FILES = 200_000, 12


def _both_ways(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    both = _both_ways(e)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (two id columns): the least id that it reaches.

    Null ends and links of a node with itself are ignored; repeated links do
    no harm; no links give no rows.
    """
    x, y = links.columns

    def put(df: DataFrame, name: str, rows: int) -> DataFrame:
        return written(df.coalesce(MIN_FILES + rows // LINKS_A_FILE), name)

    e = links.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where(
        F.col(x).isNotNull() & F.col(y).isNotNull()).where("a <> b").distinct()
    e = written(e, "links")
    while True:
        each = _both_ways(e).groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        ends, open_nodes = each.agg(F.sum("n"), F.count_if(F.expr("m < a and n > 1"))).first()
        if not open_nodes:  # every node is the least of its neighbours, or has one neighbour, which is less
            break
        e = put(_small_star(put(_large_star(e), "large-star", ends)), "small-star", ends)
    # every edge now leads from a node to the least of its component
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
