"""Runs of repeated words, found by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period ``q`` (words
``q`` apart are identical) of at least ``max(least, 2 * q)`` words that
neither neighbour extends.  The words are appended one at a time: the states
of the new prefix's suffixes form a path in the suffix-link tree, and a
link-cut access turns it into one preferred path coloured with the new end.
The preferred paths it was cut from still bear the ends at which their
strings last occurred.  Where such an end lies no farther back than the
segment's longest string is long, that string and the words between form a
square; extended both ways it is a run, and every run's first square is met.

Words that can't lie in a run are set aside first: with periods below
``GRAM`` too, a run's words all lie in six-word windows that recur within it.
Only stretches covered by such windows go through the automaton.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.shared import ship_by_value

LEAST = 12
#: A run of at least ``LEAST`` words holds this many consecutive words that equal those one period on.
GRAM = 6
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
Edit = Callable[[object, list[bytes]], list[bytes]]


# --- the automaton --------------------------------------------------------------

def suffix_automaton(codes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Links and longest lengths of the states (state 0 is the root), and the state of each prefix."""
    moves: list[dict[int, int]] = [{}]
    link, longest, states, last = [-1], [0], [], 0
    for c in codes:
        new = len(link)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                clone = len(link)
                moves.append(moves[q].copy())
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        states.append(new)
        last = new
    return link, longest, states


class PreferredPaths:
    """Link-cut access on a fixed tree: preferred paths as splay trees by depth, one colour a path.

    A path's colour is held by the root of its splay tree; ``up`` is a node's
    parent within it or, at the root, the tree node above the path's top.
    """

    def __init__(self, parent: list[int]):
        self.up = list(parent)
        self.shallow, self.deep = [-1] * len(parent), [-1] * len(parent)
        self.colour = [-1] * len(parent)

    def _rotate(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        p = up[x]
        g = up[p]
        if shallow[p] == x:
            b = shallow[p] = deep[x]
            deep[x] = p
        else:
            b = deep[p] = shallow[x]
            shallow[x] = p
        if b >= 0:
            up[b] = p
        if g >= 0:
            if shallow[g] == p:
                shallow[g] = x
            elif deep[g] == p:
                deep[g] = x
            else:
                self.colour[x] = self.colour[p]  # x is the new root of the splay tree
        else:
            self.colour[x] = self.colour[p]
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        while (p := up[x]) >= 0 and (shallow[p] == x or deep[p] == x):
            g = up[p]
            if g >= 0 and (shallow[g] == p or deep[g] == p):
                self._rotate(p if (shallow[p] == x) == (shallow[g] == p) else x)
            self._rotate(x)

    def access(self, node: int, colour: int) -> list[tuple[int, int]]:
        """Colour the path from the root to ``node``; gives (old colour, deepest node) of its former segments, deepest first."""
        found, below, x = [], -1, node
        while x >= 0:
            self._splay(x)
            cut = self.deep[x]
            if cut >= 0:  # what lay deeper keeps its colour as a path of its own
                self.colour[cut] = self.colour[x]
            self.deep[x] = below
            if self.colour[x] >= 0:
                found.append((self.colour[x], x))
            below, x = x, self.up[x]
        self._splay(node)
        self.colour[node] = colour
        return found


def runs_of_stretch(codes: list[int], least: int) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words."""
    link, longest, states = suffix_automaton(codes)
    paths, n = PreferredPaths(link), len(codes)
    ends: dict[int, int] = {}  # by period: the end of its last run
    found = []
    for i, state in enumerate(states):
        for before, node in paths.access(state, i):
            period = i - before
            if period > longest[node] or ends.get(period, 0) > i:
                continue
            start, end = before - longest[node] + 1, i + 1
            while end < n and codes[end] == codes[end - period]:
                end += 1
            while start and codes[start - 1] == codes[start - 1 + period]:
                start -= 1
            ends[period] = end
            if end - start >= least:
                found.append((start, end - start, period))
    return found


def covered_stretches(codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Maximal stretches (start, end) that recurring windows of ``GRAM`` words cover, each window recurring within its stretch."""
    n = len(codes)
    gram = min(GRAM, least - least // 2)  # least words hold at least this many that equal those one period on
    if n < max(least, 2):
        return []
    # wrapping sums of odd multiples: windows that differ may agree by chance, which only lets more words through
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    windows = np.zeros(n - gram + 1, np.uint64)
    for k in range(gram):
        windows = windows * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:n - gram + 1 + k]
    at, stretch = np.arange(len(windows)), np.zeros(len(windows), np.int64)
    while True:
        order = np.lexsort((windows[at], stretch)) if len(at) and stretch[-1] else np.argsort(windows[at], kind="stable")
        w, s = windows[at][order], stretch[order]
        same = (w[1:] == w[:-1]) & (s[1:] == s[:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        left = at[twice]
        if not len(left):
            return []
        # windows that overlap or touch are of one stretch
        begins = np.flatnonzero(np.diff(left, prepend=-gram - 1) > gram)
        starts, ends = left[begins], left[np.append(begins[1:], len(left)) - 1] + gram
        long = ends - starts >= least
        kept = np.repeat(long, np.diff(np.append(begins, len(left))))
        numbered = np.repeat(np.cumsum(long) - 1, np.diff(np.append(begins, len(left))))[kept]
        if len(left[kept]) == len(at) and (numbered == stretch).all():
            return list(zip(starts[long].tolist(), ends[long].tolist()))
        at, stretch = left[kept], numbered
        if not len(at):
            return []


def runs_of_words(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``max(least, 2 * period)`` words, by start, then period."""
    numbers: dict[bytes, int] = {}
    codes = np.fromiter(map(numbers.setdefault, words, itertools.count()), np.int64, len(words))
    found = []
    for start, end in covered_stretches(codes, least):
        found += [(start + a, length, period) for a, length, period in runs_of_stretch(codes[start:end].tolist(), least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return list(itertools.compress(words, np.cumsum(edges[:-1]) == 0))


# --- the operator ------------------------------------------------------------------

def planted_period(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the ids made periodic from some word on, so that every table holds long runs; a null id's stay."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = words[a:a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + list(itertools.islice(itertools.cycle(period), n - a))


def collapse_runs(docs: DataFrame, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """Per document: ``doc_id, n_words, runs`` (by start, then period) and ``collapsed``, its words without the repetitions.

    Words lie between the six ASCII white-space characters, and the words kept
    are joined by one space.  ``edit`` may change a document's words first.
    Null and empty texts have no words, no runs and an empty collapsed text;
    repeated rows and null ids give a row each; other columns are ignored.  A
    text is worked on whole, in memory that grows with that text alone.
    """
    if least < 2:
        raise ValueError("a run has at least two words")
    kind = docs.schema["doc_id"].dataType.simpleString()
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                words = edit(doc_id, words) if edit else words
                found = runs_of_words(words, least)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                texts.append(b" ".join(collapsed(words, found)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, run), pa.array(texts, pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, n_words bigint, runs {RUN}, collapsed string")


def run_report(docs: DataFrame, least: int = LEAST, edit: Edit | None = None) -> DataFrame:
    """Per document: its number of runs, the longest (ties: smallest start, then period), and digests of runs and collapsed text."""
    d = collapse_runs(docs, least, edit)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    d = d.withColumn("top", top)
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
                    (-F.col("top.period")).alias("period"), F.expr("1000 * top.length DIV -top.period").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


ship_by_value(__name__)
