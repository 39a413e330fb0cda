"""Intermediate tables in the cluster's shared folder, and blobs of numpy columns routed through Spark's shuffle.

A task packs many small records for one destination into a single binary row, so that the JVM moves a few large rows
instead of millions of tiny ones; Spark still partitions, shuffles, retries and spills them as ordinary rows.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A task emits its blobs once it holds so many bytes.
FLUSH_BYTES = 10 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only where none is set, as in tests in one process."""
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("parlance.shared.dir", None)
    if not set_dir:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("parlance.shared.dir", set_dir)
    return set_dir.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it is deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/parlance/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and any executor can read it."""
    return _written(df, new_folder(df.sparkSession, name))


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(folder + "/table")
    return df.sparkSession.read.schema(df.schema).parquet(folder + "/table")


class Scratch:
    """Tables that are deleted together, once nothing that is still to run reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def table(self, df: DataFrame, name: str) -> DataFrame:
        self.folders.append(new_folder(self.spark, name))
        return _written(df, self.folders[-1])

    def clear(self) -> None:
        for folder in self.folders:
            delete_folder(self.spark, folder)
        self.folders = []


def n_buckets(spark: SparkSession) -> int:
    """Destinations of a blob shuffle: the session's shuffle partitions, which its user sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


BLOB_SCHEMA = "bucket int, n long, blob binary"
_ARROW_BLOB = pa.schema([("bucket", pa.int32()), ("n", pa.int64()), ("blob", pa.binary())])


class Router:
    """Collects columns with a destination for each row and gives them out as one blob for each destination."""

    def __init__(self, *dtypes: str):
        self.dtypes = [np.dtype(d) for d in dtypes]
        self.parts: list[tuple] = []
        self.held = 0

    def add(self, bucket: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            cols = tuple(np.ascontiguousarray(c, dtype=d) for c, d in zip(cols, self.dtypes, strict=True))
            self.parts.append((bucket.astype(np.int32), *cols))
            self.held += sum(c.nbytes for c in self.parts[-1])
        if self.held >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        bucket, *cols = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, cols = bucket[order], [c[order] for c in cols]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        ends = np.r_[cuts[1:], len(bucket)]
        blobs = [b"".join(c[s:e].tobytes() for c in cols) for s, e in zip(cuts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array((ends - cuts).astype(np.int64)), pa.array(blobs, pa.binary())], schema=_ARROW_BLOB)


def unpack(n: int, blob: bytes, dtypes: list[np.dtype]) -> list[np.ndarray]:
    out, at = [], 0
    for d in dtypes:
        out.append(np.frombuffer(blob, d, n, at))
        at += n * d.itemsize
    return out


def gather(batches: Iterator[pa.RecordBatch], *dtypes: str) -> list[np.ndarray] | None:
    """All columns that reached this partition, or None if none did."""
    kinds, parts = [np.dtype(d) for d in dtypes], []
    for batch in batches:
        for n, blob in zip(batch.column("n").to_pylist(), batch.column("blob"), strict=True):
            parts.append(unpack(n, blob.as_buffer(), kinds))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def route(blobs: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's blobs in the partition of that number."""
    return blobs.repartitionById(buckets, F.col("bucket"))


#: What empties the tables that modules keep while a task runs.
FORGET: list[Callable] = []


def tidy(run: Callable) -> Callable:
    """A task's function that gives its memory back when it ends: Python workers live on, and idle ones would keep it."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            for forget in FORGET:
                forget()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


def _store(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The shared folder's file system, as tasks' Python can open it, and its path there."""
    return pa.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def save_array(folder: str, name: str, values: np.ndarray) -> None:
    """An array as a file of the shared folder; a task that runs again replaces it by the same one."""
    fs, path = _store(folder)
    fresh = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(fresh) as out:
        out.write(values.tobytes())
    fs.move(fresh, f"{path}/{name}")


_open_arrays: dict[str, np.ndarray] = {}


def load_array(folder: str, name: str, dtype: str) -> np.ndarray:
    """An array of save_array(), mapped; an empty one if there is none. A task's process keeps those of one folder open."""
    key = f"{folder}/{name}"
    if key not in _open_arrays:
        for old in [k for k in _open_arrays if not k.startswith(folder)]:
            del _open_arrays[old]
        fs, path = _store(folder)
        path = f"{path}/{name}"
        n = fs.get_file_info(path)
        if n.type == pa.fs.FileType.NotFound or not n.size:
            _open_arrays[key] = np.zeros(0, dtype)
        elif isinstance(fs, pa.fs.LocalFileSystem):
            _open_arrays[key] = np.memmap(path, dtype, "r")
        else:
            with tempfile.NamedTemporaryFile(delete=False) as copy, fs.open_input_stream(path) as source:
                while block := source.read(1 << 24):
                    copy.write(block)
            _open_arrays[key] = np.memmap(copy.name, dtype, "r")
            with contextlib.suppress(OSError):
                os.unlink(copy.name)  # the mapping keeps it until the task's process ends
    return _open_arrays[key]


def namer(columns: list[str]) -> Callable[[str], str]:
    """Names for working columns that none of these columns has: a name with two underscores behind it, or more."""
    mark = "__"
    while any(c.endswith(mark) for c in columns):
        mark += "_"
    return lambda name: name + mark


def empty(df: DataFrame) -> bool:
    return not df.take(1)
