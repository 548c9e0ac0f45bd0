"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a few whole
records, then a seek table in a skippable frame (the public seekable format:
sizes of each frame, footer with frame count and magic number).  The index
maps a record's id to its bundle, frame and offset within the frame, so one
record is read by one ranged read and one frame's decompression.

Records of equal payloads of at least ``least`` bytes are one response and
revisits of it, found by a partial aggregate on the payload digest.  Tasks
write their rows as they stream, a bundle per ``bundle_bytes``; the result
of the writing job, not a listing of the folder, says which files count, so
files of failed attempts are never read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.shared import joined_small, scratch_path, ship_by_value, written

# Fixed values of the seekable Zstandard format
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 1 << 28
#: Frames that a reading task gets, about.
FRAMES_A_TASK = 16
LEAST = 1000
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
INDEX = "page_id bigint, bundle string, frame int, frame_start bigint, frame_bytes bigint, record_offset bigint, record_bytes bigint"
RECORD = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


# --- records ------------------------------------------------------------------

def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (headers alone) if ``refers_to`` is given."""
    body = HTTP_HEAD.format(n=len(payload)).encode() + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {url.encode('unicode_escape').decode()}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The headers, the payload (empty for a revisit) and the end of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    start = end + 4
    stop = start + int(head["Content-Length"])
    payload = data[data.index(b"\r\n\r\n", start) + 4:stop]
    return head, payload, stop + 4


# --- bundles -------------------------------------------------------------------

class BundleWriter:
    """Writes records as they come; holds one frame in memory."""

    def __init__(self, out: io.IOBase, level: int = 3):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.frame, self.frames, self.waiting, self.at, self.size = bytearray(), [], [], 0, 0

    def add(self, page_id: int | None, record: bytes) -> list[tuple]:
        """Index rows (without the bundle's name) of the frame that this record completes, if it does."""
        done = self.flush() if self.frame and len(self.frame) + len(record) > FRAME_BYTES else []
        self.waiting.append((page_id, len(self.frame), len(record)))
        self.frame += record
        return done

    def flush(self) -> list[tuple]:
        if not self.frame:
            return []
        packed = self.packer.compress(bytes(self.frame))
        self.out.write(packed)
        rows = [(i, len(self.frames), self.at, len(packed), offset, n) for i, offset, n in self.waiting]
        self.frames.append((len(packed), len(self.frame)))
        self.at += len(packed)
        self.frame, self.waiting = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC))
        self.out.close()
        return rows


def seek_table(source: io.IOBase, size: int) -> list[tuple[int, int, int]]:
    """Per frame: its start, its packed and its plain size, from the footer alone."""
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    each = 12 if flags & 0x80 else 8
    source.seek(size - 9 - n * each)
    table, frames, at = source.read(n * each), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, i * each)
        frames.append((at, packed, plain))
        at += packed
    return frames


def read_one(path: str, frame_start: int, frame_bytes: int, record_offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: a ranged read of its frame."""
    fs, place = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(place) as f:
        plain = zstandard.ZstdDecompressor().decompress(f.read_at(frame_bytes, frame_start))
    return read_record(plain, record_offset)[:2]


def _uri(path: str) -> str:
    return path if "://" in path else f"file:{path.removeprefix('file:')}" if path.startswith("file:") else f"file://{path}"


# --- Spark jobs -----------------------------------------------------------------

def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest and refers_to (null for a response)."""
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    d = d.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    groups = (d.where(F.col("payload_bytes") >= least).groupBy("payload_digest")
              .agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    groups = written(groups, "payload-groups")
    d = joined_small(d, groups, "payload_digest", "left")
    refers = F.when((F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return d.withColumn("refers_to", refers).drop("first_id")


def write_bundles(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write every page as a record into bundles under ``folder``; gives the index (a written table).

    Null html is an empty payload; rows that share the largest page_id of
    equal payloads are all responses; a null page_id refers to the largest.
    """
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        writer, name = None, ""

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(x[0], f"{folder}/{name}", *x[1:]) for x in found])) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for batch in batches:
            get = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            for i in range(batch.num_rows):
                if writer is None:  # a name of its own for each attempt; the index names those that count
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None))
                page_id = get["page_id"][i].as_py()
                record = warc_record(page_id, get["url"][i].as_py(), get["payload"][i].as_py(), get["payload_digest"][i].as_py(), get["refers_to"][i].as_py())
                if done := writer.add(page_id, record):
                    yield rows(done)
                if writer.at > BUNDLE_BYTES:
                    yield rows(writer.close())
                    writer = None
        if writer is not None:
            yield rows(writer.close())

    d = with_revisits(pages, least).select("page_id", "url", "payload", "payload_digest", "refers_to")
    return written(d.mapInArrow(write, INDEX), "warc-index")


def read_bundles(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the bundles that ``index`` names, frame by frame, by their seek tables.

    The digest is taken anew from a response's payload and checked against its header.
    """
    frames = index.groupBy("bundle", "frame").agg(F.count("*").alias("n"))
    tasks = max(1, -(-frames.count() // FRAMES_A_TASK))  # rows this few would else be coalesced into one task
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, tables = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for path, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, place = pyarrow.fs.FileSystem.from_uri(path)
                with fs.open_input_file(place) as f:
                    if path not in tables:
                        tables = {path: seek_table(f, f.size())}
                    start, packed, plain = tables[path][frame]
                    data = unpack.decompress(f.read_at(packed, start), max_output_size=plain)
                rows, at = [], 0
                while at < len(data):
                    head, payload, at = read_record(data, at)
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
                    number = lambda k: int(head[k]) if k in head else None
                    url = head["WARC-Target-URI"].encode().decode("unicode_escape") if "WARC-Target-URI" in head else None
                    rows.append((number("X-Page-ID"), url, head["WARC-Type"], number("X-Refers-To-Page-ID"),
                                 int(head["X-Payload-Length"]), digest, payload if with_payload else None))
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return frames.select("bundle", "frame").repartition(tasks, "bundle", F.floor(F.col("frame") / FRAMES_A_TASK)).mapInArrow(read, RECORD)


def archived_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages, read the bundles back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    An empty table writes no bundle and gives no rows; other columns are ignored.
    """
    index = write_bundles(pages, scratch_path(pages.sparkSession, "warc"), least)
    return read_bundles(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ship_by_value(__name__)
