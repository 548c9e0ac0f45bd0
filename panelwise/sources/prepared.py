"""S3: the prepared panel as a table that is written once and found again.

The table lies in the shared folder, partitioned by year, under a name made of
a fingerprint of its inputs' files (paths, lengths, modification times) and of
the library's own code.  While neither changes, every analysis reads that
table; once a file is added, removed or rewritten, the name differs and the
panel is derived anew.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from panelwise.operators.filters import filter_panel
from panelwise.session import ensure_checkpoint_dir
from panelwise.sources.panel_io import write_prepared
from panelwise.spec import DEFAULT_SPEC, PanelSpec

YEAR = "year"
#: Schemas of the tables found, by path; a path's fingerprint fixes what it holds.
_SCHEMAS: dict[str, StructType] = {}


@cache
def _code_digest() -> str:
    root, found = Path(__file__).resolve().parents[1], hashlib.sha256()
    for folder in ("operators", "sources", "functions"):
        for file in sorted((root / folder).glob("*.py")):
            found.update(file.read_bytes())
    return found.hexdigest()


def fingerprint(spark: SparkSession, inputs: Sequence[str]) -> str:
    """Digest of the inputs' files, listed by Spark; no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(inputs))
             .select(F.xxhash64("path", "length", F.unix_micros("modificationTime")).alias("h")))
    row = files.agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{tuple(row)}:{_code_digest()}".encode()).hexdigest()[:32]


@dataclass(frozen=True)
class PreparedTable:
    """A prepared panel on disk."""

    spark: SparkSession
    path: str
    spec: PanelSpec

    def read(self, entities: Iterable | DataFrame | None = None, start=None, end=None) -> DataFrame:
        """P1 on the table: the years outside the dates asked for are never opened."""
        if self.path not in _SCHEMAS:
            _SCHEMAS[self.path] = self.spark.read.parquet(self.path).schema
        df = self.spark.read.schema(_SCHEMAS[self.path]).parquet(self.path)
        for day, beyond in ((start, F.col(YEAR) >= F.year(F.lit(start).cast("date"))), (end, F.col(YEAR) <= F.year(F.lit(end).cast("date")))):
            if day is not None:
                df = df.where(beyond)
        return filter_panel(df, entities, start, end, self.spec).drop(YEAR)


def keep_prepared(spark: SparkSession, inputs: Sequence[str], derive: Callable[[], DataFrame], spec: PanelSpec = DEFAULT_SPEC) -> PreparedTable:
    """The prepared table of ``inputs``: found under its fingerprint, else derived and written.

    A table counts once it has been renamed into place whole, so a job that
    dies while writing leaves nothing that is read; of two that write at the
    same time, one is kept.
    """
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelwise-prepared"
    table = PreparedTable(spark, f"{root}/{fingerprint(spark, inputs)}", spec)
    if not path_exists(spark, f"{table.path}/_SUCCESS"):
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        write_prepared(derive(), draft, spec)
        if not move_path(spark, draft, table.path) and not path_exists(spark, f"{table.path}/_SUCCESS"):
            raise OSError(f"can't move the prepared table to {table.path}")
    return table


def drop_prepared(table: PreparedTable) -> None:
    """Delete a prepared table, when no result that reads it is needed any more."""
    fs, path = _fs(table.spark, table.path)
    fs.delete(path, True)


def _fs(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, found = _fs(spark, path)
    return fs.exists(found)


def move_path(spark: SparkSession, path: str, target: str) -> bool:
    """Rename within one file system; false if it can't, as where the target is there already."""
    fs, found = _fs(spark, path)
    _, to = _fs(spark, target)
    return not fs.exists(to) and fs.rename(found, to)
