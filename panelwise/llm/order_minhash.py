"""Near-duplicate documents by order min-hash (Marcais, DeBlasio, Pandey, Kingsford, 2019).

A text is a sequence of five-word shingles, each labelled with how often it
occurred before.  Each of ``sketches`` hash functions picks the
``picked`` labelled shingles of least hash and keeps them in text order; the
ordered pick is a bucket key, so texts with the same content in another
order don't meet.  Picks of short texts seldom meet or never, so these also
have a key for each ordered choice of shingles that a similar text may share
with them, all in one more bucket number.  Texts that share a bucket are candidates and verified by
a banded alignment of their shingles: similarity is the aligned shingles
over all shingles of both, at least 0.8.

Equal texts are one class first.  Buckets are never expanded into all pairs:
each round compares a bucket's members with a few of them, its leaders, unless
connected with them, and drops the buckets whose members are connected by then;
only members still in different components are compared with each other at
the end, all of them.  So classes
equal the components of all links among candidates.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.components import components
from panelwise.llm.shared import joined_small, ship_by_value, worker_cache, written
from panelwise.operators.blocks import with_position

_PRIME = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 20
#: Powers in a worker's tables at least, and at once of a group's texts: shingles, and texts whose pairs are listed.
_LEAST_TABLE, _SHINGLES_AT_ONCE, _TEXTS_AT_ONCE = 1 << 16, 512, 256
#: Values of a hash function expected under the limit below which its least are sought.
_EXPECTED = 24
#: Ids and digests of texts to verify that are broadcast at most (about 100 bytes each); beyond, a plain join.
WANTED_ROWS = 400_000


@dataclass(frozen=True)
class OrderMinHash:
    shingle: int = 5
    sketches: int = 32
    picked: int = 5
    similarity: float = 0.8
    #: keys at most of a short text's ordered choices of shingles; at similarity 0.8, texts of up to 14 shingles have them
    exact_keys: int = 128
    #: leaders of a bucket in each round
    leaders: tuple[int, ...] = (1,)
    #: texts of a bucket compared with as many at once
    chunk: int = 1000
    #: bytes of such texts together, about; longer texts are compared with fewer at once
    chunk_bytes: int = 1 << 22
    seed: int = 42


# --- shingles -------------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p, out=p)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the prime and of its inverse: as many as the longest slice so far needs, by doubling."""
    kept = worker_cache("order_minhash")
    if len(kept.get("up", ())) < n:
        size = max(_LEAST_TABLE, 1 << (n - 1).bit_length())
        kept["up"], kept["down"] = _powers(_PRIME, size), _powers(pow(_PRIME, -1, 1 << 64), size)
    return kept["up"], kept["down"]


def _hash_words(b: np.ndarray) -> np.ndarray:
    up, down = _tables(len(b))
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:len(b)])))
    return _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words, a slice of the text at a time."""
    b = np.frombuffer((text or "").encode(), np.uint8)
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(b):
        end = min(len(b), at + _SLICE)
        while end < len(b) and not (b[end] == 32 or 9 <= b[end] <= 13):
            end += 1
        if end - at <= 2 * _SLICE:
            found.append(_hash_words(b[at:end]))
        else:  # words of over a megabyte
            found.append(np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest()) for w in b[at:end].tobytes().split()], np.uint64))
        at = end
    return np.concatenate(found)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text with a word has one shingle, all its words."""
    w = word_hashes(text)
    n = max(1, len(w) - width + 1) if len(w) else 0
    s = np.zeros(n, np.uint64)
    for i in range(min(width, len(w))):
        s = s * np.uint64(0xD1342543DE82EF95) + w[i:i + n]
    return _mix(s)


def _occurrences(s: np.ndarray) -> np.ndarray:
    order = np.argsort(s, kind="stable")
    new = np.concatenate(([True], np.diff(s[order]) != 0)) if len(s) else np.zeros(0, bool)
    place = np.arange(len(s))
    label = np.empty(len(s), np.uint64)
    label[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return label


def _least_places(v: np.ndarray, take: int) -> np.ndarray:
    """Per row of v, the places of its ``take`` least values, in text order."""
    rows, n = v.shape
    if take == n:
        return np.tile(np.arange(n), (rows, 1))
    if n > 4 * _EXPECTED:  # values are spread evenly: few lie under the limit, which are then sorted, by row
        flat = np.flatnonzero(v < np.uint64(int(_EXPECTED / n * 2**64)))
        row = flat // n
        count = np.bincount(row, minlength=rows)
        if count.min() >= take:
            bits = np.uint64((rows - 1).bit_length())
            by = (v.ravel()[flat] >> bits) | (row.astype(np.uint64) << (np.uint64(63) - bits) << np.uint64(1))
            first = (np.cumsum(count) - count)[:, None] + np.arange(take)
            return np.sort(flat[np.argsort(by)[first]] % n, axis=1)
    return np.sort(np.argpartition(v, take - 1, axis=1)[:, :take], axis=1)


def order_sketch(s: np.ndarray, p: OrderMinHash = OrderMinHash()) -> list[int]:
    """Per hash function, the key of its least labelled shingles in text order, as a signed 64-bit number.

    The functions are products of the mixed labelled hash with odd numbers.
    """
    if not len(s):
        return []
    labelled = _mix(s + _occurrences(s) * np.uint64(_PRIME))
    odd = _mix(np.arange(1, p.sketches + 1, dtype=np.uint64) * np.uint64(_PRIME) + np.uint64(p.seed)) | np.uint64(1)
    take = min(p.picked, len(s))
    weights = _mix(np.arange(take, dtype=np.uint64) * np.uint64(_PRIME) + np.uint64(p.seed + 1)) | np.uint64(1)
    keys: list[int] = []
    for functions in np.split(odd, p.sketches) if len(s) > 20_000 else [odd]:  # long texts one function at a time
        ordered = s[_least_places(labelled[None, :] * functions[:, None], take)]
        keys += _mix((ordered * weights).sum(axis=1)).astype(np.int64).tolist()
    return keys


_CHOICES: dict[tuple[int, int], list[np.ndarray]] = {}


def exact_sketch(s: np.ndarray, p: OrderMinHash = OrderMinHash()) -> list[int]:
    """Keys of all that is left of a short text's shingles without as many as a similar text may lack; none for a longer text.

    Two texts share one if their common subsequence is long enough for ``similarity``.
    """
    n = len(s)
    lacking = int(n * (1 - p.similarity) + 1e-9)
    if not n or n > p.exact_keys or sum(math.comb(n, k) for k in range(lacking + 1)) > p.exact_keys:
        return []
    if (n, lacking) not in _CHOICES:
        _CHOICES[n, lacking] = [np.array(list(itertools.combinations(range(n), n - k))) for k in range(lacking + 1)]
    keys: set[int] = set()
    for places in _CHOICES[n, lacking]:
        weights = _mix(np.arange(places.shape[1], dtype=np.uint64) * np.uint64(_PRIME) + np.uint64(p.seed + 2)) | np.uint64(1)
        keys.update(_mix((s[places] * weights).sum(axis=1)).astype(np.int64).tolist())
    return sorted(keys)


# --- verification -----------------------------------------------------------------

def banded_common(a: list[int], b: list[int], band: int) -> int:
    """Length of a longest common subsequence of a and b among cells within ``band`` of the diagonal.

    Bit-parallel: a row of the alignment is an integer with a 0 where the
    length grows; only the band's bits are kept.
    """
    places: dict[int, list[int]] = {}
    for i, v in enumerate(a):
        places.setdefault(v, []).append(i)
    row, low, high, common = 0, 0, 0, 0
    for j, v in enumerate(b):
        to = max(0, j - band)
        if to > low:
            cut = min(to, high) - low
            common += cut - (row & ((1 << cut) - 1)).bit_count()
            row, low = row >> cut, to
            high = max(high, low)
        top = min(len(a), j + band + 1)
        if top > high:
            row |= ((1 << (top - high)) - 1) << (high - low)
            high = top
        at = places.get(v)
        if not at:
            continue
        match = 0
        for i in at[bisect.bisect_left(at, low):bisect.bisect_left(at, high)]:
            match |= 1 << (i - low)
        both = row & match
        row = ((row + both) | (row - both)) & ((1 << (high - low)) - 1)
    return common + (high - low) - row.bit_count()


def aligned_similarity(x: np.ndarray, y: np.ndarray, least: float = 0.8) -> float:
    """Aligned shingles over all shingles of both texts; 0 where a bound shows that it is under ``least``."""
    n, m = len(x), len(y)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    values, count = np.unique(np.concatenate((x, y)), return_counts=True)
    if len(values) < n + m:
        mine, own = np.unique(x, return_counts=True)
        full = np.zeros(len(values), np.int64)
        full[np.searchsorted(values, mine)] = own
        shared = int(np.minimum(full, count - full).sum())
    else:
        shared = 0
    if shared < least * (n + m - shared):
        return 0.0
    k = min(n, m)
    differs = np.flatnonzero(x[:k] != y[:k])
    head = int(differs[0]) if len(differs) else k
    differs = np.flatnonzero(x[n - k + head:][::-1] != y[m - k + head:][::-1])
    tail = int(differs[0]) if len(differs) else k - head
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9)
    common = head + tail + banded_common(x[head:n - tail].tolist(), y[head:m - tail].tolist(), band)
    return common / (n + m - common)


# --- Spark jobs --------------------------------------------------------------------

def sketched(docs: DataFrame, p: OrderMinHash) -> DataFrame:
    """doc_id, digest (of the text; null for a null one) and sketch keys, exact ones after the others."""
    names = ["doc_id", "digest", "sketch"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [order_sketch(s, p) + exact_sketch(s, p) for s in (shingles(text.as_py(), p.shingle) for text in b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64()))], names=names)

    return _digested(docs).mapInArrow(sketch, "doc_id bigint, digest string, sketch array<bigint>")


def _digested(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")


def verified(pairs: DataFrame, texts: DataFrame, p: OrderMinHash) -> DataFrame:
    """Of the pairs (a, b), those whose texts (rep, text) are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            kept: list[tuple[int, int]] = []
            for a, b, ta, tb in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if last[0] != a:
                    last = (a, shingles(ta.as_py(), p.shingle))
                if aligned_similarity(last[1], shingles(tb.as_py(), p.shingle), p.similarity) >= p.similarity:
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    d = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
    d = d.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    return d.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a bigint, b bigint")


def _unfinished(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components."""
    several = members.groupBy("bucket", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return written(members.join(several.select("bucket", "key"), ["bucket", "key"]), "omh-members")


def _still_open(members: DataFrame) -> DataFrame:
    """Unfinished members after a round: it compared both texts of buckets of two; of buckets of the same texts one is enough."""
    sets = members.groupBy("bucket", "key").agg(
        F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"),
        *(F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(20,0)")).alias(f"set_{i}") for i in (0, 1))).where("x <> y and n > 2")
    one = sets.groupBy("n", "set_0", "set_1").agg(F.min(F.struct("bucket", "key")).alias("of")).select("of.*")
    return written(members.join(one, ["bucket", "key"]), "omh-members")


def class_links(classes: DataFrame, docs: DataFrame, p: OrderMinHash) -> DataFrame | None:
    """Links (a, b) whose components are those of all similar candidates; ``classes`` has rep, doc_id, digest, sketch."""
    members = classes.select("rep", F.posexplode("sketch").alias("bucket", "key")).withColumn("bucket", F.least("bucket", F.lit(p.sketches)))
    members = _unfinished(members.withColumn("component", F.col("rep")))
    wanted = written(members.select("rep").distinct().join(classes.select("rep", "doc_id", "digest"), "rep"), "omh-wanted")
    rows = wanted.count()
    if not rows:
        return None
    texts = _digested(docs).join(F.broadcast(wanted) if rows <= WANTED_ROWS else wanted, ["doc_id", "digest"])
    texts = written(texts.dropDuplicates(["rep"]).select("rep", "text", F.octet_length("text").alias("bytes")), "omh-texts")
    links: list[DataFrame] = []
    tested: list[DataFrame] = []

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def test(pairs: DataFrame) -> None:
        """Verify the pairs not tested so far."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = written(pairs.join(union(tested), ["a", "b"], "left_anti") if tested else pairs, "omh-pairs")
        tested.append(pairs)
        links.append(written(verified(pairs, texts, p), "omh-links"))

    for k, many in enumerate(p.leaders):
        order = F.xxhash64("rep", F.lit(p.seed + k))
        leaders = members.groupBy("bucket", "key", F.pmod(F.hash(order), F.lit(many)).alias("of")).agg(
            F.min_by("rep", order).alias("leader"), F.min_by("component", order).alias("led"))
        pairs = members.join(leaders, ["bucket", "key"]).where("component <> led").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
        test(pairs)
        joined = components(union(links)).withColumnRenamed("node", "rep")
        members = members.drop("component").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        members = _still_open(members)
        if members.isEmpty():
            return union(links)
    links.append(written(_links_in_buckets(members, texts, p), "omh-links"))
    return union(links)


def _links_in_buckets(members: DataFrame, texts: DataFrame, p: OrderMinHash) -> DataFrame:
    """Links between components within each bucket, from all pairs of its texts, a pair of chunks a group.

    A bucket has as many chunks as its texts' number or their bytes ask for; ``texts`` has rep, text, bytes.
    """
    chunks = F.greatest(F.ceil(F.count("*") / p.chunk), F.ceil(F.sum("bytes") / p.chunk_bytes)).cast("int").alias("chunks")
    sizes = written(members.join(texts.select("rep", "bytes"), "rep").groupBy("bucket", "key").agg(chunks), "omh-chunks")
    d = joined_small(members, sizes, ["bucket", "key"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    d = d.select("bucket", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "component")
    d = d.join(texts.select("rep", "text"), "rep")
    return d.groupBy("bucket", "key", "lo", "hi").applyInPandas(lambda g: linked_in_group(g, p), "a bigint, b bigint")


def _shared_shingles(sets: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each labelled shingle that several texts have, by its number: the text's place and the number."""
    labelled = np.concatenate([s + _occurrences(s) * np.uint64(_PRIME) for s in sets])
    order = np.argsort(labelled)
    labelled = labelled[order]
    new = np.ones(len(order), bool)
    new[1:] = labelled[1:] != labelled[:-1]
    several = ~new
    several[:-1] |= ~new[1:]
    row = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order[several]]
    return row, np.cumsum(new[several], dtype=np.int32) - np.int32(1)


def linked_in_group(g: pd.DataFrame, p: OrderMinHash) -> pd.DataFrame:
    """Links that connect different components of one group.

    Products of the texts' incidence with labelled shingles give each pair's
    shared shingles, which bounds its similarity; the pairs that pass are
    aligned, unless connected already.  A few shingles and a few texts at a
    time, so that little but the texts and one number a pair is in memory.
    """
    sets = [shingles(t, p.shingle) for t in g["text"]]
    size, part = np.array([len(s) for s in sets]), g["part"].to_numpy()
    lo, hi = int(g["lo"].iloc[0]), int(g["hi"].iloc[0])
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    row, column = _shared_shingles(sets, size)
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _SHINGLES_AT_ONCE):
        here = slice(*np.searchsorted(column, (at, at + _SHINGLES_AT_ONCE)))
        m = np.zeros((len(sets), _SHINGLES_AT_ONCE), np.float32)
        m[row[here], column[here] - at] = 1
        x = m[left]
        shared += x @ (x if lo == hi else m[right]).T
    root = {c: c for c in g["component"].tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    own, ids, found = g["component"].to_numpy(), g["rep"].to_numpy(), []
    for at in range(0, len(left), _TEXTS_AT_ONCE):
        some, both = left[at:at + _TEXTS_AT_ONCE], shared[at:at + _TEXTS_AT_ONCE]
        near = both >= p.similarity * (size[some, None] + size[None, right] - both) - 1e-3
        if lo == hi:
            near &= some[:, None] < right[None, :]
        for i, j in zip(*(side[k] for side, k in zip((some, right), np.nonzero(near)))):
            x, y = find(int(own[i])), find(int(own[j]))
            if x != y and aligned_similarity(sets[i], sets[j], p.similarity) >= p.similarity:
                root[max(x, y)] = min(x, y)
                found.append((int(ids[i]), int(ids[j])))
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _text_classes(each: DataFrame, docs: DataFrame, p: OrderMinHash) -> DataFrame:
    """Per different text: digest, doc_id (the least that has it), rep (a number of its own), component (the least rep of its
    class) and class_id (the least doc_id of its class)."""
    usable = each.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "omh-classes")
    # a text is numbered by its least doc_id; where one id has several texts, the others get numbers past all ids
    several = written(classes.groupBy("doc_id").agg(F.min("digest").alias("first"), F.count("*").alias("n")).where("n > 1"), "omh-repeated")
    if several.isEmpty():
        classes = classes.withColumn("rep", F.col("doc_id"))
    else:
        others = joined_small(classes.select("doc_id", "digest"), several.select("doc_id", "first"), "doc_id").where("digest <> first")
        top = classes.agg(F.max("doc_id")).first()[0]
        numbered = with_position(others.select("digest"), [F.asc("digest")], name="past")
        classes = classes.join(numbered, "digest", "left").withColumn("rep", F.coalesce(F.col("past") + top, "doc_id")).drop("past")
        classes = written(classes, "omh-numbered")
    links = class_links(classes, docs, p)
    found = classes.select("digest", "doc_id", "rep")
    if links is None:
        return found.withColumns({"component": F.col("rep"), "class_id": F.col("doc_id")})
    found = found.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if several.isEmpty():  # a number is a doc_id then
        return found.withColumn("class_id", F.col("component"))
    found = written(found, "omh-components")
    return joined_small(found, found.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component")


def near_duplicate_classes(docs: DataFrame, p: OrderMinHash = OrderMinHash()) -> DataFrame:
    """Per document: doc_id, class_id (the least doc_id of its class), kept (it is that document).

    ``docs`` needs doc_id (long) and text.  Equal texts, empty ones too, are
    of one class; a null text or a null doc_id is in a class of its own, with
    its own doc_id as class_id, and kept.  Repeated rows get a row each; an id
    with several texts may be in several classes.  An empty table gives no
    rows; other columns are ignored.
    """
    each = written(sketched(docs, p), "omh-sketches")
    found = _text_classes(each, docs, p)
    usable = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    d = each.select("doc_id", "digest").join(found.select("digest", "class_id"), "digest", "left")
    class_id = F.when(usable, F.col("class_id")).otherwise(F.col("doc_id"))
    return d.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, p: OrderMinHash = OrderMinHash()) -> DataFrame:
    """One row of each class of texts, with all columns of ``docs`` (a written table).

    Of a class stays the text with the least number and of its rows one of
    those with its least doc_id; other texts of the same id are judged in
    their own classes.  Rows with a null doc_id or a null text stay.
    """
    each = written(sketched(docs, p), "omh-sketches")
    found = written(_text_classes(each, docs, p), "omh-found")
    stays = found.where("rep = component").select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_stays"))
    usable = F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    d = docs.where(usable).withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))
    d = d.withColumn("_stays", F.col("doc_id").cast("long")).join(stays, ["_digest", "_stays"])  # copies of other ids spread
    repeated = written(d.groupBy("_digest").agg(F.count("*").alias("n")).where("n > 1").select("_digest"), "omh-copies")
    if not repeated.isEmpty():
        once = d.join(repeated, "_digest", "left_anti")
        d = once.unionByName(d.join(repeated, "_digest", "left_semi").dropDuplicates(["_digest"]))
    return d.select(docs.columns).unionByName(docs.where(~usable))


ship_by_value(__name__)
