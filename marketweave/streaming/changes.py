"""Change logs kept from streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketweave.functions import ordered
from marketweave.functions.scratch import scratch_root, written


#: Micro-batches after which the state of all keys is written anew; in between, each batch writes the keys it changed.
COMPACT = 20


def capture_changes(stream: DataFrame, name: str, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """All that is there now, through the stream: rows whose values, taken together, differ from the previous row of their key; the first always counts.

    A micro-batch is dealt by ranges of key and order, so a key's rows may lie in many partitions and none is held in memory: each row
    is compared with the one before it, a key's first with what the batches before left. That is one text of values a key, written under the number of
    the batch, so a batch that is replayed gives the same rows. A batch must hold later rows than those before it. Null keys are a key.
    """
    spark: SparkSession = stream.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    text = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    kept = "_key string, _last string"
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/rows/n=-1")

    def state(number: int) -> DataFrame:
        """What the batches before this one left."""
        full = number - number % COMPACT
        parts = [spark.read.schema(kept).parquet(f"{path}/state/n={n}").withColumn("_n", F.lit(n)) for n in range(max(0, full - 1), number)]
        none = spark.createDataFrame([], kept).withColumn("_n", F.lit(-1))
        return reduce(DataFrame.unionByName, parts, none).groupBy("_key").agg(F.max_by("_last", "_n").alias("_last"))

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumns({"_key": text(keys), "_said": text(values)})
        rows = written(ordered.previous(rows, ["_key"], [F.col(c).asc_nulls_first() for c in order], "_said", "_was"), "captured")
        before = written(state(number), "before")
        met = rows.join(before, "_key", "left").withColumn("_was", F.coalesce("_was", "_last"))
        met.where(F.col("_was").isNull() | (F.col("_was") != F.col("_said"))).select(*stream.columns).write.mode("overwrite").parquet(f"{path}/rows/n={number}")
        last = rows.groupBy("_key").agg(F.max_by("_said", F.struct(*order)).alias("_last"))
        if number % COMPACT == COMPACT - 1:
            last = last.unionByName(before.join(last.select("_key"), "_key", "left_anti"))
        last.write.mode("overwrite").parquet(f"{path}/state/n={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/stream").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/n=*")


def evidence(stream: DataFrame, quote: str, at: str, delay: str) -> DataFrame:
    """Each quote once per hash of its text, as long as its copies come no later than the delay."""
    hashed = stream.withColumn("hash", F.sha2(F.coalesce(quote, F.lit("")), 256)).withWatermark(at, delay)
    return hashed.dropDuplicatesWithinWatermark(["hash"])


def drain(stream: DataFrame, name: str) -> DataFrame:
    """All that is there now, through the stream and into Parquet in the shared folder; the table that came out."""
    spark: SparkSession = stream.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drain_latest(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """An aggregation over a stream as it stands when all that is there now has been read: every batch writes the keys it changed, the last batch of a key counts."""
    spark: SparkSession = stream.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/n={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.withColumn("_batch", F.lit(0)).schema).parquet(f"{path}/rows/n=*")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_l"))
    return last.select(*keys, *(F.col("_l")[c].alias(c) for c in rest))
