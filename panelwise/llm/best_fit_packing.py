"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

The instance is the histogram of piece lengths, at most ``capacity`` rows
whatever the corpus, so it is solved in one place: sets that provably
dominate all alternatives are fixed, the instance shrinks, and the rest is
packed by best fit in decreasing length, whole runs of equal lengths at a
time.  The solution is a list of segments, "ranks lo.. of length L go to
sequences s.. at offset o", again bounded by the histogram.  Spark tokenises
the texts, ranks the pieces of each length and looks the segments up.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.shared import joined_small, ship_by_value, written
from panelwise.llm.token_ids import word_ids

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


# --- tokens -----------------------------------------------------------------

def document_ids(text: str | None, path: str) -> bytes:
    """A document's ids, the end id last, as little-endian unsigned 32-bit bytes."""
    return word_ids(path).of_text(text).tobytes() + END_ID.to_bytes(4, "little")


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces of at most ``capacity`` ids; ``with_ids`` adds them as binary ``ids``."""
    kind = docs.schema["doc_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    fields = [("doc_id", arrow), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.binary())] if with_ids else []
    schema = pa.schema(fields)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in fields]
            size = 0
            for doc_id, found in zip(batch.column(0).to_pylist(), word_ids(tokenizer_path).of_column(batch.column(1))):
                ids = found.tobytes() + END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    size += len(part) * with_ids
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
                if size > 1 << 25:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields)], schema=schema)
                    rows, size = [[] for _ in fields], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, fields)], schema=schema)

    ddl = PIECES.format(id=kind.simpleString()) + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(pieces, ddl)


# --- the packing of a histogram ------------------------------------------------

@dataclass
class PackingPlan:
    """Segments, and how many sequences there are in all and by dominance."""

    capacity: int
    sequences: int = 0
    fixed: int = 0
    #: by length: the rank that the next segment starts at
    taken: dict[int, int] = field(default_factory=dict)
    #: (length, first rank, first sequence, copies a sequence, offset)
    segments: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def put(self, length: int, items: int, sequence: int, copies: int, offset: int) -> None:
        lo = self.taken.get(length, 0)
        self.segments.append((length, lo, sequence, copies, offset))
        self.taken[length] = lo + items

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def lookup(self) -> dict[str, np.ndarray]:
        rows = np.array(sorted(self.segments), np.int64).reshape(-1, 5)
        return {"key": (rows[:, 0] << 44) | rows[:, 1], "lo": rows[:, 1], "sequence": rows[:, 2], "copies": rows[:, 3], "offset": rows[:, 4]}


def _largest(lengths: list[int], most: int) -> int:
    """The largest of the sorted lengths that is at most ``most``, else 0."""
    i = bisect.bisect_right(lengths, most)
    return lengths[i - 1] if i else 0


def dominating_set(length: int, counts: dict[int, int], lengths: list[int], capacity: int) -> tuple[int, ...] | None:
    """The partners of a piece of this length in a set that dominates all others, or None.

    ``counts`` and the sorted ``lengths`` describe the other pieces.  A set
    dominates if every feasible set with this piece could trade its partners
    for parts of the set's own: a perfect pair; the largest partner where no
    two fit, or where it is as large as the best two; and the best two where
    none but smaller ones could take either's place.
    """
    room = capacity - length
    if not lengths or lengths[0] > room:
        return ()
    best = _largest(lengths, room)
    if best == room:
        return (best,)
    smallest: list[int] = []
    for x in lengths[:3]:
        smallest += [x] * min(counts[x], 3)
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return (best,)
    if len(smallest) > 2 and sum(smallest[:3]) <= room:
        return None
    top, pair = 0, (0, 0)
    for a in reversed(lengths[:bisect.bisect_right(lengths, room)]):
        if 2 * a <= top:
            break
        b = _largest(lengths, min(a, room - a))
        if b == a and counts[a] < 2:
            b = _largest(lengths, a - 1)
        if b and a + b > top:
            top, pair = a + b, (a, b)
    if best >= top:
        return (best,)
    a, b = pair
    if a == best:
        above: list[int] = []
        for x in lengths[bisect.bisect_right(lengths, b):][:2]:
            above += [x] * min(counts[x], 2)
        if len(above) < 2 or above[0] + above[1] > room:
            return pair
    return None


def pack_histogram(histogram: dict[int, int], capacity: int = CAPACITY) -> PackingPlan:
    """Pack ``histogram`` (length to count) into sequences of ``capacity``."""
    plan, counts = PackingPlan(capacity), {k: n for k, n in histogram.items() if n}
    lengths = sorted(counts)

    def less(length: int, n: int) -> None:
        counts[length] -= n
        if not counts[length]:
            del counts[length]
            lengths.pop(bisect.bisect_left(lengths, length))

    for length in sorted(histogram, reverse=True):  # dominance, largest pieces first
        while counts.get(length):
            n = counts[length]
            less(length, 1)
            partners = dominating_set(length, counts, lengths, capacity)
            counts[length] = n
            if n == 1:
                bisect.insort(lengths, length)
            if partners is None:
                break
            members: dict[int, int] = {length: 1}
            for p in partners:
                members[p] = members.get(p, 0) + 1
            # with fewer pieces there are fewer alternatives, so the set dominates while its members last
            times = min(counts[p] // k for p, k in members.items())
            first, offset = plan.opened(times), 0
            plan.fixed += times
            for p, k in sorted(members.items(), reverse=True):
                plan.put(p, times * k, first, k, offset)
                offset += p * k
                less(p, times * k)
    rooms: list[int] = []  # sorted free rooms of open groups of sequences filled alike
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)

    def put_back(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):  # best fit, decreasing
        n = counts[length]
        while n:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, many = capacity, -(-n // (capacity // length))
                first = plan.opened(many)
            copies = min(room // length, n)
            used = min(many, n // copies)
            plan.put(length, used * copies, first, copies, capacity - room)
            put_back(room - copies * length, first, used)
            put_back(room, first + used, many - used)
            n -= used * copies
    return plan


# --- the operator ------------------------------------------------------------

def ranked(pieces: DataFrame, largest: int) -> DataFrame:
    """Adds ``rank``, gapless from 0 within each length, without one task for a frequent length.

    Each length is dealt over hashed buckets; a piece's rank is its place in
    the bucket after the sizes of the buckets before.
    """
    bucket_rows = max(1000, int(largest ** 0.5))
    d = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, -(-largest // bucket_rows)))))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = (d.groupBy("length", "bucket").agg(F.count("*").alias("n"))
             .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    first = written(first, "rank-offsets")
    place = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    d = d.withColumn("place", F.row_number().over(place))
    return joined_small(d, first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("place") - 1).drop("bucket", "first", "place")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that are read more than once (a written table)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("a piece's length must be 1 to the capacity")
    table = pack_histogram(histogram, capacity).lookup()
    d = ranked(pieces, max(histogram.values(), default=0))
    out = pieces.schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            i = np.searchsorted(table["key"], (length << 44) | rank, side="right") - 1
            past = rank - table["lo"][i]
            sequence = table["sequence"][i] + past // table["copies"][i]
            offset = table["offset"][i] + past % table["copies"][i] * length
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in out] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in out] + ["sequence_id", "offset"])

    return d.mapInArrow(place, ddl)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id alone; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.
    """
    return pack_pieces(written(cut_pieces(docs, tokenizer_path, capacity), "token-pieces"), capacity)


def packed_sequences(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: ``sequence_id, length, ids`` (binary, little-endian unsigned 32 bits)."""
    pieces = written(cut_pieces(docs, tokenizer_path, capacity, with_ids=True), "token-pieces")
    placed = pack_pieces(pieces, capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` ids a sequence
    return (placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))


ship_by_value(__name__)
