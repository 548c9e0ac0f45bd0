"""Resharding by minimum-cost flow.

From the sizes of the old shards and the capacities of the new ones, a
minimum-cost flow decides how many bytes each old shard keeps and sends
where; staying costs nothing, each byte moved costs one, so the fewest bytes
move.  The network has a node per shard, however many documents there are.
Within an old shard the documents lie in a fixed order, larger size classes
first, so that the cuts between destinations fall among small ones, and equal
texts beside each other; the flow's byte counts become ranges of that order.
Only shards that lose or gain a document are rewritten.

There are fewer cuts than pairs of shards.  Each is found by prefix sums over
groups of the order, then within the group that holds it, and becomes a string
that documents are compared with: to place them needs neither a join nor a
shuffle, and no task holds a shard or a text's copies.  The rewritten files are
read back for the report.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwise.llm.shared import scratch_path, written

#: Characters of the order: size class, each digest, and the prefix of a digest that groups are made by.
CLASS, DIGEST, PREFIX = 3, 32, 3


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Units sent from each supply to each capacity at the least cost, by successive shortest paths with potentials.

    ``sum(supply) <= sum(capacity)``; integers throughout.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold the supplies")
    source, sink, size = n + m, n + m + 1, n + m + 2
    to, room, price, out = [], [], [], [[] for _ in range(size)]

    def edge(a: int, b: int, most: int, each: int) -> None:
        for x, y, r, p in ((a, b, most, each), (b, a, 0, -each)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(p)

    first = len(to)
    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost[i][j])
    for i in range(n):
        edge(source, i, supply[i], 0)
    for j in range(m):
        edge(n + j, sink, capacity[j], 0)
    potential = [0] * size
    while True:
        far: list[float] = [float("inf")] * size
        far[source], via, heap = 0, [-1] * size, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in out[a]:
                if room[e] and (x := d + price[e] + potential[a] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if via[sink] < 0:
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        path, a = [], sink
        while a != source:
            path.append(via[a])
            a = to[via[a] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return [[room[(first + 2 * (i * m + j)) ^ 1] for j in range(m)] for i in range(n)]


def transfers(old_sizes: list[int], capacities: list[int]) -> list[list[int]]:
    """Bytes from each old shard to each new one; a byte that changes its shard's number costs one."""
    cost = [[int(i != j) for j in range(len(capacities))] for i in range(len(old_sizes))]
    return min_cost_flow(old_sizes, capacities, cost)


def even_capacities(total: int, shards: int) -> list[int]:
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def hashed_shard(text: Column, shards: int) -> Column:
    """The layout that is resharded where none is given: a hash of the text, so that equal texts begin together."""
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(shards)).cast("int")


def _document_key() -> Column:
    """Of the id and the text; equal only for repeated rows."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def _ordered(docs: DataFrame) -> DataFrame:
    """Adds ``_size`` and ``_at``, the place in the order within an old shard.

    A string of fixed parts: size class (large first), digest of the text, document key.
    """
    d = docs.withColumn("_size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    klass = F.lpad((F.lit(200) - F.floor(2 * F.log2("_size"))).cast("string"), CLASS, "0")
    return d.withColumn("_at", F.concat(klass, F.md5(F.coalesce("text", F.lit(""))), _document_key()))


def _containing(keys: DataFrame, cuts: list[dict], length: int) -> list[dict]:
    """For each cut, the group of documents with equal first ``length`` characters of the order that holds its byte.

    ``cuts`` has old_shard, number, byte (from the start of its last group), within (that group, '' at first).
    """
    spark = keys.sparkSession
    at = spark.createDataFrame([(c["old_shard"], c["number"], c["byte"], c["within"]) for c in cuts],
                               "old_shard int, number int, byte long, within string")
    before = len(cuts[0]["within"])
    groups = (keys.withColumn("within", F.substring("_at", 1, before))
              .join(F.broadcast(at.select("old_shard", "within").distinct()), ["old_shard", "within"])
              .groupBy("old_shard", "within", F.substring("_at", 1, length).alias("group"))
              .agg(F.sum("_size").alias("bytes")))
    order = Window.partitionBy("old_shard", "within").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("first", F.coalesce(F.sum("bytes").over(order), F.lit(0)))
    found = groups.join(F.broadcast(at), ["old_shard", "within"]).where((F.col("first") <= F.col("byte")) & (F.col("byte") < F.col("first") + F.col("bytes")))
    return [{"old_shard": r["old_shard"], "number": r["number"], "byte": r["byte"] - r["first"], "within": r["group"], "bytes": r["bytes"]}
            for r in found.collect()]  # one row a cut


def _boundaries(keys: DataFrame, cuts: list[dict], slack: int) -> dict[tuple[int, int], str]:
    """For each cut the place in the order that it is made at: documents before it go to the earlier side.

    A cut is made beside the text that it falls in, on the nearer side, if that
    is off by at most ``slack`` bytes; only a text with more bytes is itself cut, between two documents.
    """
    placed = {}
    for length in (CLASS + PREFIX, CLASS + DIGEST, CLASS + DIGEST + PREFIX, CLASS + 2 * DIGEST):
        if not cuts:
            break
        cuts, left = _containing(keys, cuts, length), []
        for c in cuts:
            off = min(c["byte"], c["bytes"] - c["byte"])
            if length == CLASS + 2 * DIGEST or off == 0 or length == CLASS + DIGEST and off <= slack:
                # "g" comes after all digits of a digest
                placed[c["old_shard"], c["number"]] = c["within"] + ("" if 2 * c["byte"] <= c["bytes"] else "g")
            else:
                left.append(c)
        cuts = left
    return placed


def reshard(docs: DataFrame, old_shards: int, new_shards: int, old: Column | None = None,
            tolerance: float = 0.02) -> tuple[DataFrame, list[list[int]]]:
    """Adds ``old_shard`` and ``shard`` to docs (doc_id, text), and gives the transfers in bytes.

    ``old`` is a column of numbers from 0 to ``old_shards`` - 1; without it the
    layout is a hash of the text.  Documents of equal text in one old shard go
    to one new shard, unless the text's copies hold so many bytes that a cut
    beside them would be more than ``tolerance`` of a new shard off; such a text
    (a third of all rows, say) is cut between documents.  So a new shard is off
    by at most ``tolerance`` of itself for each cut at its ends.  Copies that begin
    in several old shards stay apart where bringing them together would move bytes.
    """
    d = _ordered(docs.withColumn("old_shard", (hashed_shard(F.col("text"), old_shards) if old is None else old).cast("int")))
    keys = written(d.select("old_shard", "_at", "_size"), "shard-keys")
    found = {r["old_shard"]: r["bytes"] for r in keys.groupBy("old_shard").agg(F.sum("_size").alias("bytes")).collect()}
    if any(i is None or not 0 <= i < old_shards for i in found):
        raise ValueError(f"old shards are numbered from 0 to {old_shards - 1}, found {sorted(found, key=str)}")
    sizes = [found.get(i, 0) for i in range(old_shards)]
    moves = transfers(sizes, even_capacities(sum(sizes), new_shards))
    cuts, turns = [], {}
    for i, row in enumerate(moves):  # what stays comes first, then the others in turn
        turns[i] = sorted((j for j in range(new_shards) if row[j]), key=lambda j: (j != i, j))
        upto = 0
        for number, j in enumerate(turns[i][:-1]):
            upto += row[j]
            cuts.append({"old_shard": i, "number": number, "byte": upto, "within": ""})
    placed = _boundaries(keys, cuts, int(tolerance * sum(sizes) / new_shards))
    shard = F.lit(None).cast("int")
    for i, turn in turns.items():
        if turn:
            place = F.lit(turn[-1])
            for number in range(len(turn) - 2, -1, -1):
                place = F.when(F.col("_at") < placed[i, number], F.lit(turn[number])).otherwise(place)
            shard = F.when(F.col("old_shard") == i, place).otherwise(shard)
    return d.withColumn("shard", shard.cast("int")), moves


def affected_shards(moves: list[list[int]]) -> list[int]:
    """New shards that lose or gain documents."""
    n_new = len(moves[0]) if moves else 0
    return [j for j in range(n_new) if any(row[j] for i, row in enumerate(moves) if i != j)
            or (j < len(moves) and any(x for k, x in enumerate(moves[j]) if k != j))]


def rewrite_shards(resharded: DataFrame, moves: list[list[int]], path: str, columns: list[str]) -> list[int]:
    """Write the new shards that lose or gain documents to ``path/shard=<n>``; gives their numbers.

    A shard that keeps exactly what it had is left alone.
    """
    affected = affected_shards(moves)
    (resharded.where(F.col("shard").isin(affected)).select(*columns, "shard")
     .write.partitionBy("shard").mode("overwrite").parquet(path))
    return affected


def reshard_folder(spark: SparkSession, source: str, target: str, old_shards: int, new_shards: int,
                   tolerance: float = 0.02) -> tuple[dict[int, str], list[list[int]]]:
    """Reshard files ``source/shard=<n>`` (n from 0 to ``old_shards`` - 1), with columns doc_id, text and any others.

    Shards that lose or gain documents are written to ``target/shard=<n>``; the
    others stay where they are, unread but for their keys.  Gives each new
    shard's folder and the transfers in bytes.  ``source`` is not changed; a
    shard without documents has no folder.
    """
    docs = spark.read.option("basePath", source).parquet(source)
    resharded, moves = reshard(docs, old_shards, new_shards, F.col("shard"), tolerance)
    columns = [c for c in docs.columns if c != "shard"]
    affected = rewrite_shards(resharded, moves, target, columns)
    held = [sum(row[j] for row in moves) for j in range(new_shards)]
    return {j: f"{target if j in affected else source}/shard={j}" for j in range(new_shards) if held[j]}, moves


def sharded_report(docs: DataFrame, old_shards: int = 5, new_shards: int = 8) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null), from the rewritten files.

    A null text has no bytes and size 1, and is of the group of empty texts;
    documents of equal text share a shard unless their bytes alone would make the shards uneven
    (``reshard``); repeated rows are documents each; an empty table gives no
    rows; other columns are ignored.  Slots number a shard's documents by a hash of id and text, gapless from 0.
    """
    resharded, moves = reshard(docs.select("doc_id", "text"), old_shards, new_shards)
    columns = ["doc_id", "text"]
    path = scratch_path(docs.sparkSession, "shards")
    affected = rewrite_shards(resharded, moves, path, columns)
    spark = docs.sparkSession
    files = spark.read.schema(resharded.select(*columns, "shard").schema).parquet(path)
    kept = [j for j in range(new_shards) if j not in affected]
    if kept:
        files = files.unionByName(resharded.where(F.col("shard").isin(kept)).select(*columns, "shard"))
    d = files.select("doc_id", "shard", _document_key().alias("key"),
                     (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                     F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    d = written(d.withColumn("prefix", F.substring("key", 1, PREFIX)), "shard-rows")
    before = Window.partitionBy("shard").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    first = (d.groupBy("shard", "prefix").agg(F.count("*").alias("n"))
             .select("shard", "prefix", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    place = Window.partitionBy("shard", "prefix").orderBy("key", "doc_id")
    d = d.withColumn("place", F.row_number().over(place)).join(first, ["shard", "prefix"])
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("first") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
