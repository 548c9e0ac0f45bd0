"""Helpers of the training-data operators: scratch tables, words, size checks."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from types import ModuleType

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.session import ensure_checkpoint_dir

#: A word is a run of characters other than these six (the same in Java, RE2 and Python).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

#: Largest row count for which a one-row-per-group side table is broadcast; beyond it a plain join is used.
BROADCAST_ROWS = 20_000


def ship_by_value(module: str) -> ModuleType:
    """Pickle a module's functions with the task, so that executors need no installed copy."""
    mod = sys.modules[module]
    cloudpickle.register_pickle_by_value(mod)
    return mod


ship_by_value(__name__)


def worker_cache(owner: str) -> dict:
    """A dict that the tasks of one worker process share; a module pickled by value has new globals in each task.

    Only the last owner's is kept: a worker serves one operator after
    another, and what an earlier one left would fill its memory.
    """
    kept = sys.modules.setdefault("panelwise_worker_caches", ModuleType("panelwise_worker_caches")).__dict__.setdefault("kept", {})
    if owner not in kept:
        kept.clear()
        kept[owner] = {}
    return kept[owner]


#: Folder, below the application's, of the tables written in the current scope.
_SCOPE: ContextVar[str] = ContextVar("panelwise_scratch_scope", default="")


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's written tables, inside ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/panelwise-llm/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}{_SCOPE.get()}/{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts the lineage: an executor lost later costs a re-read, not a recomputation.
    """
    return written_at(df, scratch_path(df.sparkSession, name))


def dropped(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; a result that reads them must be written elsewhere before."""
    outer = _SCOPE.get()
    token = _SCOPE.set(f"{outer}/scope-{uuid.uuid4().hex}")
    inner = f"{scratch_root(spark)}{_SCOPE.get()}"
    try:
        yield
    finally:
        _SCOPE.reset(token)
        dropped(spark, inner)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables (call when no result that reads them is needed any more)."""
    dropped(spark, scratch_root(spark))


def joined_small(df: DataFrame, side: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join a side table, broadcasting it only if its counted rows are at most ``BROADCAST_ROWS``."""
    rows = side.count() if rows is None else rows
    return df.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, on, how)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "")
