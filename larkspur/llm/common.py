"""Shared plumbing of the training-data operators: inputs, shared scratch space, batching."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space of the word definition `[^\x20\x09-\x0D]+`, as a Java regex class and as characters.
SPACE_CLASS = r"[ \t-\r]"
SPACES = " \t\n\x0b\x0c\r"


#: Per-process caches of the operators, by name, with what empties each.
_caches: dict[str, Callable[[], None]] = {}


#: Arrays from this size on are mapped one by one, so that memory goes back to the system as soon as they are let go.
_MAPPED_BYTES = 4 << 20
_M_MMAP_THRESHOLD = -3


def _lean_allocator() -> None:
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).mallopt(_M_MMAP_THRESHOLD, _MAPPED_BYTES)


def claim_worker(name: str, empty: Callable[[], None] | None = None) -> None:
    """Called first by each Arrow function: Python workers are reused by later stages, so the caches that other
    operators have left in this one are emptied, and the memory goes back to the system."""
    _lean_allocator()
    others = [n for n in _caches if n != name]
    for n in others:
        _caches.pop(n)()
    if empty is not None:
        _caches[name] = empty
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """`name`, or with as many underscores behind it as it takes to be no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors (`spark.checkpoint.dir`).

    Only where the session names none and runs on this machine alone (local tests) a temporary folder is set for it;
    on a cluster that would be another folder on each executor, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.sparkContext.setCheckpointDir(folder)
        return folder
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/larkspur-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new name for a table in the shared folder, under one folder for each application."""
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for folder in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that were not written elsewhere can no longer be read."""
    discard(spark, _application_folder(spark))


class Scratch:
    """Tables in the shared folder that are deleted together, once what was made of them is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, label))
        return _written(df, self.paths[-1])

    def clear(self) -> None:
        discard(self.spark, *self.paths)
        self.paths = []


def qualified(spark: SparkSession, folder: str) -> str:
    """`folder` with the scheme of its file system, for readers and writers outside Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + uri[len("file:") :] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def release_shuffles(spark: SparkSession) -> None:
    """Executors keep a finished query's shuffle files until the driver's JVM has collected what refers to them, which
    without memory pressure takes half an hour; this asks for it now, so that disk holds the exchanges of one query, not of all."""
    gc.collect()  # Python's handles first
    spark._jvm.System.gc()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _own_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here remove their shuffle files as they end. Collection alone leaves those of a
    query whose DataFrame is still referred to."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _written(df: DataFrame, path: str) -> DataFrame:
    with _own_shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    release_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet into the shared scratch folder and read it again."""
    return _written(df, scratch_path(df.sparkSession, label))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the bytes of `column` in each stay near `max_bytes` (one row at least)."""
    for batch in batches:
        col = batch.column(column)
        n = batch.num_rows
        if n == 0:
            continue
        if col.buffers()[1] is None:  # nothing but nulls
            yield batch
            continue
        width = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
        offsets = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + n + 1].astype(np.int64)
        offsets = offsets - offsets[0]
        at = 0
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


def csr_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start_i .. start_i+length_i-1 of every i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts.astype(np.int64) - (ends - lengths), lengths)
    return out
