"""Reading a raw panel, reporting a missing source, keeping the prepared table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.spec import DEFAULT_SPEC, RAW_COLUMNS, PanelSpec

# The tokens pandas' CSV reader treats as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


class PanelSourceError(FileNotFoundError):
    """Raised when the panel source does not exist (no partial result)."""


def require_path(spark: SparkSession, path: str) -> str:
    """Fail early, with one clear error, when ``path`` does not exist."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        raise PanelSourceError(f"panel source not found: {path}")
    return path


def read_panel_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV read by its header: the first column is the row id, the others go by name, every value as text.

    Columns may come in any order; a missing one raises, columns beyond the
    schema are passed through.  Missing-value tokens become NULL here; typing
    (strict dates and counters, lenient population) is done by
    :func:`panelwise.operators.prepare.clean_panel`.
    """
    require_path(spark, path)
    df = (
        spark.read.option("header", True)
        .option("mode", "FAILFAST")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    row_id, *found = df.columns
    missing = [c for c in RAW_COLUMNS[1:] if c not in found]
    if missing:
        raise ValueError(f"the panel source lacks the columns {missing}")
    tokens = F.array(*[F.lit(t) for t in NA_TOKENS])
    cols = [F.col(f"`{row_id}`").cast("bigint").alias(RAW_COLUMNS[0])]
    for c in [*RAW_COLUMNS[1:], *(x for x in found if x not in RAW_COLUMNS)]:
        # exact token match on the raw field, as pandas does (no whitespace stripping)
        v = F.col(f"`{c}`")
        cols.append(F.when(F.array_contains(tokens, v), F.lit(None)).otherwise(v).alias(c))
    return df.select(*cols)


def read_panel_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S1 for Parquet: typed columns, filters and projections pushed to the scan."""
    require_path(spark, path)
    return spark.read.parquet(path)


def persist_prepared(df: DataFrame) -> DataFrame:
    """S3: keep the prepared table across analyses (spills to disk, recomputable)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def write_prepared(df: DataFrame, path: str, spec: PanelSpec = DEFAULT_SPEC, partitions: int | None = None) -> None:
    """S3 at scale: write the prepared panel once, partitioned by year so that
    date-range filters prune whole directories.

    A range repartition on (year, entity, date) -- not a hash repartition on
    the year, which would send a whole year to one task -- gives balanced
    tasks that each write into one or two year directories, with files
    clustered by entity and date (tight min/max statistics for pushdown).
    """
    by = ["year", spec.entity, spec.date]
    dated = df.withColumn("year", F.year(F.col(spec.date)))
    placed = dated.repartitionByRange(partitions, *by) if partitions else dated.repartitionByRange(*by)
    placed.sortWithinPartitions(*by).write.mode("overwrite").partitionBy("year").parquet(path)
