"""Prefix trie of conversations, counted in minimal-perfect-hash node tables.

A node is a distinct sequence of first turns; its digest is a 128-bit sum of
mixed (depth, turn) digests, so a conversation's prefix digests are a running
sum.  Conversations are dealt over shards by their ids.  A shard enumerates
the distinct prefix digests of its own conversations, gives each a slot by a
minimal perfect hash, checks the digest kept in a slot at every look-up, and
scatters counts into flat arrays by slot.  The shards' tables are summed by
digest, which gives each node's members and its owner, the smallest of them.

What a node adds to its ancestors is then entered once, in the shard of its
owner, where all its ancestors have slots too: it is accumulated there through
the parent-slot array, deepest nodes first, and the shards' sums are added by
digest once more.  So a prefix that a third of all conversations share costs
one slot a shard, and no task ever holds a node's members.

A conversation is worked on whole (about 100 bytes a turn, without texts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.shared import joined_small, ship_by_value, written

#: Turns that a shard gets, about.
SHARD_TURNS = 100_000
#: Room of a hash level for each of its keys, and levels before the few keys left are numbered by a search.
SPREAD, LEVELS = 2, 24
#: Ids in a piece of a node's list of members.
PIECE = 4096
LOCAL = "shard int, a bigint, b bigint, pa bigint, pb bigint, depth bigint, turn bigint, bytes bigint, n bigint, first bigint, ends array<bigint>"
PARTS = "a bigint, b bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint"


# --- digests and slots ------------------------------------------------------------

def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of unsigned 64-bit numbers."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_digests(conv: np.ndarray, depth: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests (two 64-bit halves) of all prefixes; rows are sorted by conversation and depth."""
    starts = np.flatnonzero(np.diff(conv, prepend=conv[:1] - 1)) if len(conv) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(conv)))
    found = []
    with np.errstate(over="ignore"):
        for half, seed in ((x, 0x9E3779B97F4A7C15), (y, 0xC2B2AE3D27D4EB4F)):
            each = mixed(half.astype(np.uint64) + depth.astype(np.uint64) * np.uint64(seed))
            total = np.cumsum(each, dtype=np.uint64)
            found.append(total - np.repeat(total[starts] - each[starts], sizes))
    return found[0], found[1]


class PerfectHash:
    """Slots 0 to n-1 for n distinct digests: at each level, digests alone in their place get the next slots, the others go on."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        left, base = np.arange(len(a)), 0
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        slots = np.empty(len(a), np.int64)
        for level in range(LEVELS):
            if not len(left):
                break
            size = SPREAD * len(left)
            place = self._place(a[left], b[left], level, size)
            alone = np.bincount(place, minlength=size) == 1
            rank = base + np.cumsum(alone) - 1
            self.levels.append((size, alone, rank))
            settled = alone[place]
            slots[left[settled]] = rank[place[settled]]
            base += int(alone.sum())
            left = left[~settled]
        self.rest = {(int(a[i]), int(b[i])): base + k for k, i in enumerate(left.tolist())}
        slots[left] = base + np.arange(len(left))
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slots], self.b[slots] = a, b
        self.own = slots

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            seed = mixed(np.array([level + 1], np.uint64))
            return (mixed(a ^ seed) + mixed(b + seed)) % np.uint64(size)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of digests; -1 for one that isn't in the table."""
        found, left = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (size, alone, rank) in enumerate(self.levels):
            place = self._place(a[left], b[left], level, size)
            hit = alone[place]
            slot, at = rank[place[hit]], left[hit]
            same = (self.a[slot] == a[at]) & (self.b[slot] == b[at])
            found[at[same]] = slot[same]
            left = left[~hit]
        for i in left.tolist() if self.rest else []:
            found[i] = self.rest.get((int(a[i]), int(b[i])), -1)
        return found


def accumulated(depth: np.ndarray, parent: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Each array summed over subtrees, through the parent slots (-1: none), deepest nodes first."""
    out = [v.copy() for v in values]
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        inner = level[parent[level] >= 0]
        for v in out:
            np.add.at(v, parent[inner], v[inner])
    return out


def _unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def local_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's distinct prefixes with the counts of its own conversations."""
    shard = int(pdf["shard"].iloc[0])
    pdf = pdf.sort_values(["conv_id", "depth"], kind="stable")
    conv, depth, turn, size = (pdf[c].to_numpy(np.int64) for c in ("conv_id", "depth", "turn", "bytes"))
    a, b = prefix_digests(conv, depth, _unsigned(pdf["x"]), _unsigned(pdf["y"]))
    top = depth == 1
    pa_, pb_ = np.where(top, 0, np.roll(a, 1)).astype(np.uint64), np.where(top, 0, np.roll(b, 1)).astype(np.uint64)
    pair = np.empty(len(a), [("a", np.uint64), ("b", np.uint64)])
    pair["a"], pair["b"] = a, b
    _, first = np.unique(pair, return_index=True)
    table = PerfectHash(a[first], b[first])
    slot = table.slots(a, b)
    n = len(first)
    row = np.empty(n, np.int64)
    row[table.own] = first
    for column in (pa_, pb_, depth, turn, size):  # rows of one slot are of one node
        if not (column == column[row][slot]).all():
            raise ValueError("two sequences of turns have one digest")
    count, least = np.bincount(slot, minlength=n), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv)
    last = np.append(conv[1:] != conv[:-1], True) if len(conv) else np.zeros(0, bool)
    ended, ids = slot[last], conv[last]
    order = np.lexsort((ids, ended))
    cuts = np.searchsorted(ended[order], np.arange(n + 1))
    ends = [ids[order[cuts[i]:cuts[i + 1]]] for i in range(n)]
    signed = lambda u: u.view(np.int64)
    return pd.DataFrame({"shard": np.int32(shard), "a": signed(table.a), "b": signed(table.b), "pa": signed(pa_[row]), "pb": signed(pb_[row]), "depth": depth[row],
                         "turn": turn[row], "bytes": size[row], "n": count, "first": least, "ends": ends})


def summed_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's part of the sums over subtrees: those of the nodes whose owner is here."""
    a, b = _unsigned(pdf["a"]), _unsigned(pdf["b"])
    table = PerfectHash(a, b)
    back = np.empty(len(a), np.int64)
    back[table.own] = np.arange(len(a))  # slot to row
    by_slot = {c: pdf[c].to_numpy(np.int64)[back] for c in ("pa", "pb", "depth", "bytes", "first", "conv_id", "n_convs", "n_ends")}
    parent = table.slots(by_slot["pa"].view(np.uint64), by_slot["pb"].view(np.uint64))
    if ((parent < 0) != (by_slot["depth"] == 1)).any():
        raise ValueError("a node's parent has no slot")
    own = by_slot["first"] == by_slot["conv_id"]
    leaf = own & (by_slot["n_ends"] == by_slot["n_convs"])
    saved = np.where(own, (by_slot["n_convs"] - 1) * by_slot["bytes"], 0)
    leaves, saved = accumulated(by_slot["depth"], parent, leaf.astype(np.int64), saved)
    inner = parent >= 0
    children = np.bincount(parent[inner], weights=own[inner], minlength=len(a)).astype(np.int64)
    above = np.where(inner, by_slot["conv_id"][parent], -1)
    out = pd.DataFrame({"a": table.a.view(np.int64), "b": table.b.view(np.int64), "conv_id": by_slot["conv_id"], "depth": by_slot["depth"], "parent_conv_id": above,
                        "n_convs": by_slot["n_convs"], "n_children": children, "n_leaves": leaves, "saved": saved})
    return out.assign(parent_conv_id=out["parent_conv_id"].astype("Int64").where(inner))


# --- Spark jobs ----------------------------------------------------------------------

@dataclass(frozen=True)
class PrefixTrie:
    """``nodes``: a, b (digest, zeros for the root), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.
    ``ends``: a, b, conv_id of each conversation at the node where it ends."""

    nodes: DataFrame
    ends: DataFrame


def _once(column: str) -> Column:
    """The one value of a group; two of them fail the job."""
    low, high = F.min(column), F.max(column)
    return F.when(low == high, low).otherwise(F.raise_error(F.lit("two sequences of turns have one digest")).cast("bigint"))


def prefix_trie(conversations: DataFrame, turns: DataFrame, shard_turns: int = SHARD_TURNS) -> PrefixTrie:
    """The trie of ``turns`` (conv_id, depth from 1 without gaps, role, text) of ``conversations`` (conv_id, each once).

    A null role or text is empty; a conversation without turns is a member of
    the root alone; an empty table gives no nodes.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda at: F.conv(F.substring(whole, at, 15), 16, 10).cast("long")
    turns = turns.select("conv_id", F.col("depth").cast("long").alias("depth"), half(1).alias("x"), half(17).alias("y"),
                         F.xxhash64(role, text).alias("turn"), F.octet_length(text).cast("long").alias("bytes"))
    turns = written(turns, "trie-turns")
    shards = max(1, -(-turns.count() // shard_turns))
    dealt = turns.withColumn("shard", F.pmod(F.xxhash64("conv_id"), F.lit(shards)).cast("int"))
    local = written(dealt.groupBy("shard").applyInPandas(local_nodes, LOCAL), "trie-nodes")
    total = local.groupBy("a", "b").agg(
        F.sum("n").alias("n_convs"), F.min("first").alias("conv_id"), F.sum(F.size("ends")).cast("long").alias("n_ends"),
        *[_once(c).alias(f"_{c}") for c in ("pa", "pb", "depth", "turn", "bytes")])
    placed = local.drop("n", "ends").join(total.select("a", "b", "n_convs", "conv_id", "n_ends", "_depth", "_pa", "_pb", "_turn", "_bytes"), ["a", "b"])
    # the checks of `total` are part of what is read, so that none is optimised away
    placed = placed.where("_depth = depth AND _pa = pa AND _pb = pb AND _turn = turn AND _bytes = bytes")
    parts = placed.select("shard", "a", "b", "pa", "pb", "depth", "bytes", "first", "conv_id", "n_convs", "n_ends").groupBy("shard").applyInPandas(summed_nodes, PARTS)
    nodes = written(parts.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")), "trie-sums")
    ids = conversations.select("conv_id")
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    tops = nodes.where("depth = 1").agg(F.count("*").alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"),
                                        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    top = tops.select(F.struct("*")).scalar()
    root = root.select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id", F.lit(0).cast("long").alias("depth"),
                       F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", *[top.getField(c).alias(c) for c in tops.columns])
    least = ids.select(F.min("conv_id")).scalar()
    nodes = nodes.withColumn("parent_conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("parent_conv_id")))
    ended = local.select("a", "b", F.explode("ends").alias("conv_id"))
    silent = ids.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")
    return PrefixTrie(nodes.unionByName(root), ended.unionByName(silent))


def end_digests(ends: DataFrame) -> DataFrame:
    """Per node: a, b and the SHA-256 of its members' ids, ascending and joined by commas.

    The ids are sorted over all tasks and joined into pieces there; a task
    then reads a node's pieces in order, one at a time, as the hash asks.
    """
    piece_schema, digest_schema = "a bigint, b bigint, first bigint, ids string", "a bigint, b bigint, digest string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (c.to_numpy() for c in batch.columns)
            new = np.flatnonzero((np.diff(a, prepend=a[:1] - 1) != 0) | (np.diff(b, prepend=b[:1] - 1) != 0)) if len(a) else np.zeros(0, np.int64)
            starts = np.array([at for lo, hi in zip(new, np.append(new[1:], len(a))) for at in range(lo, hi, PIECE)], np.int64)
            stops = np.minimum(np.append(starts[1:], len(a)), starts + PIECE)
            texts = [",".join(map(str, ids[lo:hi].tolist())) for lo, hi in zip(starts, stops)]
            yield pa.RecordBatch.from_arrays([pa.array(a[starts], pa.int64()), pa.array(b[starts], pa.int64()), pa.array(ids[starts], pa.int64()), pa.array(texts, pa.string())],
                                             names=["a", "b", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (a, b) != node:
                    done += [(*node, state.hexdigest())] if node else []
                    node, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py().encode())
            yield _digest_rows(done)
        if node:
            yield _digest_rows([(*node, state.hexdigest())])

    by = ["a", "b", "conv_id"]
    cut = ends.repartitionByRange(*by).sortWithinPartitions(*by).select(*by).mapInArrow(pieces, piece_schema)
    return cut.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digests, digest_schema)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "digest"])


# --- rebuilt conversations ------------------------------------------------------------

FAMILY, HEADS = 5, 9


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations' ids, and their turns rebuilt on the head of the family's first.

    Turns are ordered by ``turn`` (null first), ties by role and text; null
    role and text are empty; repeated rows are turns each; rows without a
    conv_id belong to no conversation.  Conversation c takes the first h turns
    of conversation c - c % 5 (a floor remainder), where h is its id's CRC-32
    modulo 9, and its own turns after its first h.
    """
    d = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    d = written(d.withColumn("place", F.row_number().over(order)).select("conv_id", "place", "role", "text"), "ordered-turns")
    ids = d.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    ids = written(ids.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))), "conversation-ids")
    # at most FAMILY conversations have a base, and at most HEADS - 1 of its turns are taken
    heads = d.where(F.col("place") < HEADS).select(F.col("conv_id").alias("base"), "place", "role", "text")
    taken = ids.where("h > 0").join(heads, "base").where("place <= h").select("conv_id", F.col("place").cast("long").alias("depth"), "role", "text")
    bases = ids.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    lengths = ids.join(bases, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k"))
    own = joined_small(d, lengths, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).cast("long").alias("depth"), "role", "text")
    return ids.select("conv_id"), taken.unionByName(own)


def trie_report(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Per node of the rebuilt conversations' trie: its counts and the digest of the ids that end there."""
    trie = prefix_trie(*rebuilt_conversations(conversations), shard_turns)
    found = trie.nodes.join(end_digests(trie.ends), ["a", "b"], "left")
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return found.select(*[F.col(c).cast("long").alias(c) for c in names], F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


ship_by_value(__name__)
