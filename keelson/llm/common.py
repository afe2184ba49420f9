"""What the corpus operators share: cutting lineage and reading text from Arrow."""

from __future__ import annotations

import ctypes
import tempfile
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the context's checkpoint folder, or else the session's spark.checkpoint.dir.

    Only a local master, whose executors are this machine, gets a temporary folder where both are unset.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="keelson-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of queries that are made and run inside go when each has ended; only for queries whose result is written or collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from there; its shuffle files go at once."""
    checkpoint_folder(df.sparkSession)
    with tidy(df.sparkSession):
        return df.select("*").checkpoint()


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder wherever it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Give memory that is free back to the system, so that a worker that lives on does not keep the peak of an earlier stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def in_slices(batches, text: str, most: int = 4 << 20, rows: int = 4096):
    """Cut Arrow batches so that each piece holds about `most` bytes of text (one row at least)."""
    for batch in batches:
        n, i = batch.num_rows, 0
        sizes = [x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()]
        while i < n:
            j, held = i, 0
            while j < n and j - i < rows and (j == i or held + sizes[j] <= most):
                held += sizes[j]
                j += 1
            yield batch.slice(i, j - i)
            i = j
        trim()
