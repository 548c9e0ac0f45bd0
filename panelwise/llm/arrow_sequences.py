"""Token ids as Arrow files of equal-length sequences and masks.

All documents' ids, each with the end id last, lie one after another in
ascending order of ``doc_id``, cut into sequences of ``length`` ids.  A file
(Arrow's file format: the stream of batches and a footer with their places)
has three fixed-size-list columns: ``ids``, ``mask`` (false where the last
sequence is padded) and ``ends`` (true at the last id of a document).  Every
batch but a part's last has ``batch_rows`` sequences, so sequence ``i`` is row
``i % batch_rows`` of batch ``i // batch_rows``, and a memory-mapped file
gives its ids without a copy.

One range shuffle brings the texts in order; a task tokenises its range and
writes its own files, a part, each sequence at once.  Where a part begins
among all ids follows from the sizes of the parts before it, so only the
last sequence of a part is padded and no ids are moved a second time.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.shared import joined_small, scratch_path, ship_by_value, written
from panelwise.llm.token_ids import word_ids

LENGTH = 2048
BATCH_ROWS = 256
#: Sequences of a file; a task goes on in a further one.
FILE_ROWS = 1 << 16
END_ID = 1
#: Ids that a reading task gets, about.
TOKENS_A_TASK = 1 << 23
#: One row a document (``number`` null), and one a file (``doc_id`` null, ``n_tokens`` without the padding).
INDEX = "doc_id {id}, part int, number int, first bigint, n_tokens bigint, file string"


# --- files --------------------------------------------------------------------

def file_schema(length: int, wide: bool) -> pa.Schema:
    """Ids are 16 bits wide where the vocabulary allows it."""
    kinds = {"ids": pa.uint32() if wide else pa.uint16(), "mask": pa.bool_(), "ends": pa.bool_()}
    return pa.schema([pa.field(n, pa.list_(pa.field("item", k, nullable=False), length), nullable=False) for n, k in kinds.items()])


class SequenceWriter:
    """Files of one part: ids are added in order, full batches are written as they fill."""

    def __init__(self, folder: str, length: int, batch_rows: int, file_rows: int, wide: bool):
        self.fs, self.base = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.base, recursive=True)
        self.folder, self.length, self.batch_rows = folder, length, batch_rows
        self.file_rows = -(-file_rows // batch_rows) * batch_rows  # whole batches
        self.schema = file_schema(length, wide)
        self.ids = np.zeros(batch_rows * length, np.uint32 if wide else np.uint16)
        self.ends = np.zeros(batch_rows * length, bool)
        self.filled = 0  # of the open batch
        self.tokens = 0  # of the part
        self.files: list[list] = []  # number, first id, ids, name
        self.out = self.sink = None

    def add(self, ids: np.ndarray) -> int:
        """Append a document's ids; gives its place within the part."""
        first, at = self.tokens, 0
        while at < len(ids):
            take = min(len(ids) - at, len(self.ids) - self.filled)
            self.ids[self.filled:self.filled + take] = ids[at:at + take]
            self.filled += take
            at += take
            if at == len(ids):
                self.ends[self.filled - 1] = True
            if self.filled == len(self.ids):
                self.flush()
        self.tokens += len(ids)
        return first

    def flush(self) -> None:
        if not self.filled:
            return
        if self.out is None:
            name = f"{uuid.uuid4().hex}.arrow"  # of this attempt alone; the index names the files that count
            self.sink = self.fs.open_output_stream(f"{self.base}/{name}", compression=None)
            self.out = pa.ipc.new_file(self.sink, self.schema)
            self.files.append([len(self.files), len(self.files) * self.file_rows * self.length, 0, f"{self.folder}/{name}"])
        rows = -(-self.filled // self.length)
        columns = [pa.array(a[:rows * self.length]) for a in (self.ids, np.arange(len(self.ids)) < self.filled, self.ends)]
        self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema))
        self.files[-1][2] += self.filled
        self.ids[:], self.ends[:], self.filled = 0, False, 0
        if self.files[-1][2] == self.file_rows * self.length:
            self.close_file()

    def close_file(self) -> None:
        if self.out is not None:
            self.out.close()
            self.sink.close()
            self.out = None

    def close(self) -> list[list]:
        self.flush()
        self.close_file()
        return self.files


class SequenceFile:
    """Random access to a file's sequences; local files are mapped, so nothing is copied."""

    def __init__(self, path: str):
        fs, place = pyarrow.fs.FileSystem.from_uri(path)
        source = pa.memory_map(place) if isinstance(fs, pyarrow.fs.LocalFileSystem) else fs.open_input_file(place)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.batch_rows = self.file.get_batch(0).num_rows
        self.kept = (-1, None)

    def batch(self, i: int) -> pa.RecordBatch:
        if self.kept[0] != i:
            self.kept = (i, self.file.get_batch(i))
        return self.kept[1]

    def __len__(self) -> int:
        last = self.file.num_record_batches - 1
        return last * self.batch_rows + self.batch(last).num_rows

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of sequence ``i``."""
        batch, at = self.batch(i // self.batch_rows), i % self.batch_rows * self.length
        ids, mask = (batch.column(n).values.slice(batch.column(n).offset * self.length + at, self.length) for n in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def runs(self, first: int) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids from place ``first`` on to the end of their document, a view a batch, and whether it ends there."""
        size = self.batch_rows * self.length
        for i in range(first // size, self.file.num_record_batches):
            at = first - i * size if i == first // size else 0
            ids, ends, mask = (self.batch(i).column(n).values for n in ("ids", "ends", "mask"))
            near = 1 << 12
            while at < len(ids):  # the end mark is sought in growing steps
                found = np.flatnonzero(ends.slice(at, near).to_numpy(zero_copy_only=False))
                step = int(found[0]) + 1 if len(found) else min(near, len(ids) - at)
                if not mask[at + step - 1].as_py():
                    return
                yield ids.slice(at, step).to_numpy(), bool(len(found))
                if len(found):
                    return
                at, near = at + step, near * 8


def _uri(path: str) -> str:
    return path if "://" in path else f"file:{path.removeprefix('file:')}" if path.startswith("file:") else f"file://{path}"


# --- Spark jobs -----------------------------------------------------------------

def write_sequences(docs: DataFrame, tokenizer_path: str, folder: str, length: int = LENGTH, batch_rows: int = BATCH_ROWS, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write all documents' ids under ``folder``; gives the index (a written table, see ``INDEX``).

    Null and empty texts are the end id alone.  A null ``doc_id`` comes first,
    rows of one id follow in the order of the input, repeated rows are written
    each.  An empty table writes no file.  Other columns are ignored.
    """
    folder, kind = _uri(folder), docs.schema["doc_id"].dataType.simpleString()
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    kinds = [arrow, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    ddl = INDEX.format(id=kind)
    names = [c.split()[0] for c in ddl.split(", ")]

    def rows(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, writer = word_ids(tokenizer_path), TaskContext.get().partitionId(), None
        for batch in batches:
            if writer is None:
                writer = SequenceWriter(folder, length, batch_rows, file_rows, encoder.tokenizer.get_vocab_size() > 1 << 16)
            first, sizes = [], []
            for ids in encoder.of_column(batch.column(1)):
                first.append(writer.add(np.append(ids, np.uint32(END_ID))))
                sizes.append(len(ids) + 1)
            n = batch.num_rows
            yield rows([batch.column(0), [part] * n, [None] * n, first, sizes, [None] * n])
        for number, at, tokens, file in writer.close() if writer else []:
            yield rows([[None], [part], [number], [at], [tokens], [file]])

    ordered = (docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_input"))
               .repartitionByRange("doc_id", "_input").sortWithinPartitions("doc_id", "_input").select("doc_id", "text"))
    return written(ordered.mapInArrow(write, ddl), "sequence-index")


def read_documents(index: DataFrame, file_rows: int = FILE_ROWS, length: int = LENGTH, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before.  Raises if a document's
    end mark isn't where the index says.
    """
    kind = index.schema["doc_id"].dataType.simpleString()
    file_ids = -(-file_rows // batch_rows) * batch_rows * length
    files = index.where("number IS NOT NULL").select("part", "number", "file", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part: as many as writing tasks
    parts = (files.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.array_sort(F.collect_list(F.struct("number", "file"))).alias("files"))
             .select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"), F.transform("files", lambda f: f["file"]).alias("files")))
    parts = written(parts, "sequence-parts")
    total = files.agg(F.sum("n_tokens")).first()[0] or 0
    tasks = max(1, -(-total // TOKENS_A_TASK))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            get = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            part, first, listed = (get[c].to_numpy() for c in ("part", "first", "n_tokens"))
            crcs, sizes, order = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.lexsort((first, part))
            for i in order.tolist():
                at, crc, size, ended, names = int(first[i]), 0, 0, False, None
                names = get["files"][i].as_py()
                while not ended and at // file_ids < len(names):
                    if path != names[at // file_ids]:
                        path = names[at // file_ids]
                        file = SequenceFile(path)
                    got = 0
                    for ids, ended in file.runs(at % file_ids):
                        crc, got = zlib.crc32(ids.astype("<u4", copy=False), crc), got + len(ids)
                    if not got:
                        break
                    at, size = at + got, size + got
                if not ended or size != listed[i]:
                    raise ValueError(f"a document's end mark isn't at its end: part {part[i]}, first {first[i]}")
                crcs[i], sizes[i] = crc, size
            start = get["part_start"].to_numpy() + first
            yield pa.RecordBatch.from_arrays([get["doc_id"], pa.array(start, pa.int64()), pa.array(sizes), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    d = index.where("number IS NULL").select("doc_id", "part", "first", "n_tokens")
    d = d.repartition(tasks, "part", F.floor(F.col("first") / TOKENS_A_TASK))
    return joined_small(d, parts, "part").mapInArrow(read, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def stored_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, batch_rows: int = BATCH_ROWS, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write all documents' ids into Arrow files, read them back: doc_id, start, n_tokens, ids_crc32."""
    index = write_sequences(docs, tokenizer_path, scratch_path(docs.sparkSession, "sequences"), length, batch_rows, file_rows)
    return read_documents(index, file_rows, length, batch_rows)


ship_by_value(__name__)
