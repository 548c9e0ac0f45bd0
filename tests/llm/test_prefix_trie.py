"""The trie against one of nested sequences."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from panelwise.llm import prefix_trie as pt
from panelwise.llm import queries

SF001 = "/root/testdata/sf0.001"


def brute_nodes(rows):
    """rows: (conv_id, turn, role, text) -> the query's rows."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [r[2:] for r in sorted(t)] for c, t in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children = {}
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)

    def below(s):
        found = [s]
        for t in found:
            found += children.get(t, [])
        return found

    out = []
    for s, m in members.items():
        sub = below(s)
        ends = sorted(c for c in m if len(rebuilt[c]) == len(s))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children.get(s, [])), sum(t not in children for t in sub),
                    sum((len(members[t]) - 1) * len(t[-1][1].encode()) for t in sub if t), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn int, role string, text string"


def _found(df, **kw):
    return sorted((tuple(r) for r in pt.trie_report(df, **kw).collect()), key=str)


def test_whole_table(spark):
    found = sorted((tuple(r) for r in queries.QUERIES["op12_prefix_trie"](spark, SF001).collect()), key=str)
    rows = spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found == brute_nodes(map(tuple, rows))


@pytest.mark.parametrize("shard_turns", [3, 40, 100_000])
def test_shared_prefixes_in_any_shards(spark, shard_turns):
    rng = random.Random(shard_turns)
    rows = []
    for c in range(150):
        common = c % 3 > 0  # two thirds start alike, a third are one conversation
        for turn in range(rng.randint(1, 14)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"t{turn}é" if common or rng.random() < .5 else f"x{rng.randrange(4)}"))
    rng.shuffle(rows)
    assert _found(spark.createDataFrame(rows, SCHEMA), shard_turns=shard_turns) == brute_nodes(rows)


def test_edge_rows(spark):
    """Nulls in all columns, ties, repeated rows, conversations without turns of their own left, clashing columns, long and empty texts."""
    rows = [(7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (7, 1, "a", "b"), (None, 0, "user", "nobody's"), (5, 0, "user", "x" * 100_000),
            (5, 0, "assistant", ""), (9, 3, "u", "only"), (-4, 0, "u", "below zero"), (-5, 0, "u", "base of it"), (12, 0, "u", "no base"), (2 ** 40 + 2, 0, "u", "far")]
    rows += [(30, t, "u", f"turn {t}") for t in range(12)] + [(c, t, "u", f"turn {t}") for c in (31, 32, 33, 34) for t in range(10)]
    d = spark.createDataFrame(rows, SCHEMA)
    clash = d
    for c in ("shard", "a", "b", "depth", "bytes", "n", "first", "h", "k", "base", "place", "digest", "ends"):
        clash = clash.withColumn(c, d["role"])
    expected = brute_nodes(rows)
    assert _found(d) == expected and _found(clash, shard_turns=7) == expected
    assert _found(d.limit(0)) == []
    silent = [(2, 0, "u", "a")]  # its head has more turns than it, and there's no base: the root alone
    assert zlib.crc32(b"2") % 9 > 0
    assert _found(spark.createDataFrame(silent, SCHEMA)) == brute_nodes(silent)


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(0, 0, "ab", "c"), (10, 0, "a", "bc"), (20, 0, "", "abc"), (30, 0, "ab", "c")]
    assert len(_found(spark.createDataFrame(rows, SCHEMA))) == len(brute_nodes(rows))


@pytest.mark.parametrize("n", [1, 2, 50, 20_000])
def test_slots_are_minimal_and_checked(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 2 ** 63, n, dtype=np.uint64), rng.integers(0, 2 ** 63, n, dtype=np.uint64)
    table = pt.PerfectHash(a, b)
    assert sorted(table.slots(a, b).tolist()) == list(range(n)) and (table.slots(a, b) == table.own).all()
    assert (table.slots(a ^ np.uint64(1), b) == -1).all() and (table.slots(rng.integers(0, 2 ** 63, 100, dtype=np.uint64), b[:1].repeat(100)) == -1).all()


def test_digits_left_after_the_last_level(monkeypatch):
    monkeypatch.setattr(pt, "LEVELS", 1)
    a, b = np.arange(300, dtype=np.uint64), np.zeros(300, np.uint64)
    table = pt.PerfectHash(a, b)
    assert table.rest and sorted(table.slots(a, b).tolist()) == list(range(300))


def test_one_digest_for_two_sequences_fails():
    import pandas as pd

    rows = pd.DataFrame({"shard": 0, "conv_id": [1, 2], "depth": 1, "x": 5, "y": 6, "turn": [1, 2], "bytes": 3})
    with pytest.raises(ValueError, match="one digest"):
        pt.local_nodes(rows)
