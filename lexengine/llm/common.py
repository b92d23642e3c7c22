"""Shared pieces of the training-data operators: table access, scratch tables and word rules.

Words are runs of anything but the six ASCII white-space characters.  ``bytes.split()`` splits on
exactly those, and ``bytes.lower()`` lower-cases exactly A-Z, so operators work on UTF-8 bytes.
"""

from __future__ import annotations

import ctypes
import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SQL = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the input tables through Spark, so any path that Spark can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables: spark.checkpoint.dir, else a local one (tests, local mode)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/lexengine"


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df to a scratch table, with options of the writer, and reads it back, which cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = "/".join([scratch_dir(spark), app, *_open_scopes(), f"{label}-{uuid.uuid4().hex}"])
    schema = df.schema
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes this application's scratch tables; DataFrames that read them must have been written by then."""
    remove(spark, f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}")


_scopes = threading.local()


def _open_scopes() -> list[str]:
    """The scopes that this thread has open: each pipeline of a driver has its own."""
    if not hasattr(_scopes, "names"):
        _scopes.names = []
    return _scopes.names


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are removed at the end; what reads them must be written inside."""
    names = _open_scopes()
    names.append(f"scope-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        folder = "/".join([scratch_dir(spark), spark.sparkContext.applicationId, *names])
        names.pop()
        remove(spark, folder)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def as_text(column: pa.Array) -> list[str]:
    """Strings of a string column; null becomes empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; a column that df lacks becomes a null string, and further columns are left out."""
    have = {c.lower() for c in df.columns}
    return df.select(*[F.col(f"`{n}`") if n.lower() in have else F.lit(None).cast("string").alias(n) for n in names])


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and what its task no longer needs goes back to the system: a worker that waits for tasks holds memory of its executor."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library; its memory stays with the worker

    return task
