"""Helpers shared by the training-data operators: durable tables and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table (ids or 64-bit keys) is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 100_000

#: Rows that Spark sends to Python at a time, at most, while an operator's tables are written: texts may be long.
BATCH_ROWS = 1_000

#: The six characters that `[\x20\x09-\x0D]` matches.
WHITE_SPACE = b" \t\n\x0b\x0c\r"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a new local folder where none is set and all of Spark is on this machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few rows within, so that neither side holds thousands of texts at once; the session's own setting after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), BATCH_ROWS) if int(was) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_by(df: DataFrame, name: str, col: str) -> tuple[DataFrame, str]:
    """As materialise, but bucketed by a column: joins on it leave these rows where they are. Also the table's name, for forget()."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{table}"
    with small_batches(spark):
        df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), col).option("path", path).saveAsTable(table, format="parquet")
    return spark.table(table), table


def forget(spark: SparkSession, table: str) -> None:
    """Take a table of materialise_by out of the catalogue; its files stay in the shared folder with the others."""
    spark.sql(f"DROP TABLE {table}")


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a materialised narrow table if it has at most so many rows; else leave the join to Spark."""
    return F.broadcast(df) if df.count() <= rows else df


_held: dict[object, Any] = {}


def release_state() -> None:
    """Let go of what worker_state keeps in this worker, so that an operator does not run beside the leavings of the one before."""
    _held.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps freed memory otherwise
        give(0)


def worker_state(key: object, make: Callable[[], Any]) -> Any:
    """What make() gives, kept by a worker process until another key is asked for: operators that share workers hold one such thing at a time."""
    if key not in _held:
        release_state()
        _held[key] = make()
    return _held[key]
