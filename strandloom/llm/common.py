"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_arrow_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lower the rows and bytes per Arrow batch, so that long texts cannot fill a worker; smaller settings stay.

    The session keeps the bounds, as a plan reads them when it runs.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", 2 * SLICE_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a temporary folder is set if the session runs in one process, as in tests; a cluster must name it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="strandloom-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends and a lost executor costs nothing.

    Parquet is used instead of ``checkpoint()`` because its files are compressed and columns can be pruned. Shuffle
    files of the step go as soon as it is written.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised tables that no later step reads."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def with_rest(df: DataFrame, *needed: str) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The two columns that an operator reads: id as bigint, text with null as empty.

    With ``carry`` all columns come along as one struct, so that no name can clash.
    """
    with_rest(df, id_col, text_col)
    rest = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        *rest,
    )


@lru_cache(maxsize=1)
def allocator() -> ctypes.CDLL | None:
    """The C library, told to give large arrays back to the system when they are freed; None where that is not glibc."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "malloc_trim") or not hasattr(libc, "mallopt"):
        return None
    libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    return libc


def tidy_memory() -> None:
    """Give back what this worker's last task has freed: workers live on, and each would keep its largest task's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := allocator():
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``most`` bytes of the given column, or one row."""
    tidy_memory()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
        first, before = 0, 0
        while first < n:
            last = int(ends.searchsorted(before + most, side="right"))
            last = min(n, max(last, first + 1))
            yield batch.slice(first, last - first)
            first, before = last, int(ends[last - 1])
    tidy_memory()
