"""Helpers shared by the operators: staged tables, shared files, batches.

*Staged table*: a DataFrame written as Parquet under the cluster's shared
folder (``spark.checkpoint.dir``) and read back.  It cuts the lineage, is
computed once, and survives the loss of any executor.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import scratch_path

# The six ASCII blanks that end a word in the contracts: space, tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
NOT_BLANKS = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000  # texts of an Arrow batch, which a task has in memory on both of Spark's sides


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per session, for clusters where
    it isn't installed or submitted with ``--py-files``."""
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="quarry-ship-")) / "quarry.zip"  # on the driver; Spark hands it out
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(out))
    sc._quarry_shipped = True


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs started inside, for
    tables whose single rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, "llm", name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def row_key(*cols: Column) -> Column:
    """A 128-bit key of a row's content as two longs' text; equal rows, equal keys."""
    return F.concat_ws(":", F.xxhash64(F.lit(1), *cols).cast("string"), F.xxhash64(F.lit(2), *cols).cast("string"))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in the single column of
    ``gone``, whatever the columns of ``docs`` are called."""
    name = unused(docs, "_gone")
    return docs.join(gone.toDF(name), key == F.col(name), "left_anti")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- shared files
def file_system(path: str):
    """(pyarrow file system, path inside it) of a Hadoop-style URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if path.startswith(("s3a://", "s3n://")):
        path = "s3://" + path.split("://", 1)[1]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def read_file(path: str) -> bytes:
    f, p = file_system(path)
    with f.open_input_file(p) as src:
        return src.read()


class Output:
    """A binary file being written; ``n`` is the number of bytes so far."""

    def __init__(self, folder: str, name: str):
        self.path = f"{folder.rstrip('/')}/{name}"
        f, p = file_system(self.path)
        f.create_dir(p.rsplit("/", 1)[0], recursive=True)
        self._out = f.open_output_stream(p, compression=None)  # else a .gz name compresses once more
        self.n = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.n += len(data)

    def close(self) -> None:
        self._out.close()


def attempt_name() -> str:
    """A file name part no other task attempt uses: a retried or doubled
    task never touches the files of the attempt whose rows were kept."""
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{t.partitionId():06d}-{t.taskAttemptId()}" if t else "000000-0"


def partition_id() -> int:
    from pyspark import TaskContext

    t = TaskContext.get()
    return t.partitionId() if t else 0


# ---------------------------------------------------------------- batches
def release_memory() -> None:
    """Hand freed memory back at a task's end: Python workers live on, idle,
    through stages that need the executor's memory elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``text`` column has about ``limit`` bytes,
    so a task's memory does not follow the batch's row count.  Every row is
    passed on; a text longer than the limit is a slice of its own."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0), dtype=np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield b.slice(at, to - at)
            at = to
        del b, sizes, ends
    release_memory()


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + len), one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lens), lens)
