"""Deliveries of several tables that readers see whole or not at all.

A batch is staged, a folder for each table, and then one commit marker names it. Readers take the rows of batches that
have a marker, so a delivery cut short between two tables shows nothing, and the same batch again writes over
what it left. All files are in a folder that readers and executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commits"
#: Markers up to which they are broadcast to a reader.
BROADCAST_ROWS = 100_000


def create(spark: SparkSession, root: str, schemas: dict[str, str]) -> None:
    """An empty store with these tables; one that is there already stays as it is."""
    for name, schema in {**schemas, COMMITS: "tables array<string>"}.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}/batch=none")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(batch, tables) of the deliveries that count."""
    return spark.read.schema("tables array<string>, batch string").parquet(f"{root}/{COMMITS}")


def read(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A table's rows with their batch: those of committed batches, whose folders alone are read."""
    markers = committed(spark, root).select("batch")
    markers = F.broadcast(markers) if markers.count() <= BROADCAST_ROWS else markers
    return spark.read.schema(f"{schema}, batch string").parquet(f"{root}/{name}").join(markers, "batch", "left_semi")


def stage(root: str, batch: str, tables: dict[str, DataFrame]) -> None:
    """The tables of a batch where no reader looks yet; what an earlier attempt left is written over."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def deliver(spark: SparkSession, root: str, batch: str, tables: dict[str, DataFrame], write: Callable[[str, str, dict[str, DataFrame]], None] = stage) -> bool:
    """Stages the tables and commits the batch; False, without a write, where it is committed already. batch is one word."""
    if not committed(spark, root).where(F.col("batch") == batch).isEmpty():
        return False
    write(root, batch, tables)
    spark.createDataFrame([(sorted(tables),)], "tables array<string>").coalesce(1).write.mode("overwrite").parquet(f"{root}/{COMMITS}/batch={batch}")
    return True


def deliver_stream(stream: DataFrame, root: str, state: str, split: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
    """All that a stream has now, a delivery for each micro-batch under its number: what is replayed after a failure is delivered once."""

    def put(batch: DataFrame, number: int) -> None:
        deliver(batch.sparkSession, root, f"{number:012}", split(batch))

    stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
