"""Runs against a search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelwise.llm import periodic_runs, queries

SF001 = "/root/testdata/sf0.001"


def brute_runs(words, least):
    """Every period's maximal stretches of words equal to those one period on; a run's smallest period alone."""
    n, found = len(words), {}
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.array([numbers[w] for w in words])
    for q in range(1, n // 2 + 1):
        equal = np.append(codes[:-q] == codes[q:], False)
        edges = np.flatnonzero(np.diff(equal.astype(int), prepend=0))
        for a, b in zip(edges[0::2], edges[1::2]):
            length = int(b - a) + q
            if length >= max(2 * q, least) and (int(a), length) not in found:
                found[int(a), length] = q
    return sorted(((a, length, q) for (a, length), q in found.items()), key=lambda r: (r[0], r[2]))


def _texts(rng):
    for _ in range(400):
        n, letters = rng.randint(0, 60), rng.choice([1, 2, 3, 5])
        yield [b"%d" % rng.randrange(letters) for _ in range(n)]
    for _ in range(120):
        words = []
        while len(words) < 120:
            part = [b"%d" % rng.randrange(40) for _ in range(rng.randint(1, 20))]
            words += part * rng.choice([1, 1, 2, 3, 5])
            if rng.random() < .3 and len(words) > 20:
                at = rng.randrange(len(words) - 10)
                words += words[at:at + rng.randint(1, 30)]
        yield words
    a, b = [b"a"], [b"b"]
    while len(b) < 300:  # Fibonacci words hold as many runs as can be
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("least", [2, 3, 5, 12, 20])
def test_runs_equal_those_of_all_periods(least):
    total = 0
    for words in _texts(random.Random(least)):
        found = periodic_runs.runs_of_words(words, least)
        assert found == brute_runs(words, least), words
        total += len(found)
    assert total > 100


def test_access_colours_paths():
    """Segments against colours kept node by node."""
    rng = random.Random(7)
    parent = [-1] + [rng.randrange(max(0, i - 4), i) for i in range(1, 200)]
    paths, plain = periodic_runs.PreferredPaths(parent), [-1] * 200
    for colour in range(600):
        node = rng.randrange(200)
        expected, x = [], node
        while x >= 0:
            if plain[x] >= 0 and (not expected or expected[-1][0] != plain[x]):
                expected.append((plain[x], x))
            plain[x] = colour
            x = parent[x]
        assert paths.access(node, colour) == expected


def _expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_whole_table(spark):
    found = [tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, SF001).collect()]
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(found) == sorted(_expected(*r) for r in docs)
    assert sum(r[1] > 0 for r in found) > len(found) // 20


def test_edge_rows(edge_docs):
    found = [tuple(r) for r in periodic_runs.run_report(edge_docs, edit=periodic_runs.planted_period).collect()]
    short = edge_docs.where("doc_id IS NULL OR doc_id <> 6").select("doc_id", "text").collect()
    order = lambda r: tuple(map(str, r))
    assert sorted((r for r in found if r[0] != 6), key=order) == sorted((_expected(*r) for r in short), key=order)
    long = [r for r in found if r[0] == 6]
    assert [r[1:6] for r in long] == [(1, 0, 120_000, 2, 60_000_000)]
    assert periodic_runs.run_report(edge_docs.limit(0)).collect() == []


def test_spaces_of_other_kinds_are_letters(spark):
    d = spark.createDataFrame([(1, "a\xa0b\x1cc " * 20)], "doc_id long, text string")
    r = periodic_runs.collapse_runs(d).first()
    assert r["n_words"] == 20 and r["collapsed"] == "a\xa0b\x1cc" and [tuple(x) for x in r["runs"]] == [(0, 20, 1)]
