"""Table maintenance as pure functions: (current, delta) to the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Rows of delta replace those of current with the same key. delta has one row a key."""
    return current.join(delta.select(*key), key, "left_anti").select(*current.columns).unionByName(delta.select(*current.columns))


def upsert_sighting(current: DataFrame, seen: DataFrame, key: list[str], first: str = "first_seen", last: str = "last_seen") -> DataFrame:
    """The earliest first and the latest last sighting of every key."""
    both = current.select(*key, first, last).unionByName(seen.select(*key, first, last))
    return both.groupBy(*key).agg(F.min(first).alias(first), F.max(last).alias(last))


def append_if_changed(current: DataFrame, delta: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows of delta whose value differs from the last of their key in current."""
    last = current.groupBy(*key).agg(F.max(F.struct(*order, value)).alias("_l")).select(*key, F.col("_l")[value].alias("_was"), F.lit(True).alias("_held"))
    joined = delta.join(last, key, "left")
    return joined.where(F.col("_held").isNull() | ~F.col(value).eqNullSafe(F.col("_was"))).select(*delta.columns)


def replace_by_key(current: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """All rows of current whose key delta names go; all rows of delta come."""
    return current.join(delta.select(*key).distinct(), key, "left_anti").select(*current.columns).unionByName(delta.select(*current.columns))


def insert_if_absent(current: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    return current.unionByName(delta.join(current.select(*key).distinct(), key, "left_anti").select(*current.columns))


def prune(current: DataFrame, seen: DataFrame, source: str, key: list[str]) -> DataFrame:
    """Rows that their source no longer lists go; a source that returned nothing prunes nothing."""
    spoke = seen.select(source).distinct().withColumn("_spoke", F.lit(True))
    listed = seen.select(source, *key).distinct().withColumn("_listed", F.lit(True))
    joined = current.join(spoke, source, "left").join(listed, [source, *key], "left")
    return joined.where(F.col("_spoke").isNull() | F.col("_listed").isNotNull()).select(*current.columns)


def expire(df: DataFrame, taken_at: str, today, days: int = 45) -> DataFrame:
    """Rows of the last so many days before today, which is given and never the clock."""
    return df.where(F.col(taken_at) >= F.date_sub(today, days))


def retire(offerings: DataFrame, witness: list[str], last: str, today, unseen: int = 7, recent: int = 2) -> DataFrame:
    """status is stale where an offering is unseen for so many days although its witness key was seen lately."""
    seen = offerings.groupBy(*witness).agg(F.max(last).alias("_seen"))
    stale = (F.col(last) < F.date_sub(today, unseen)) & (F.col("_seen") >= F.date_sub(today, recent))
    return offerings.join(seen, witness).withColumn("status", F.when(stale, "stale").otherwise("live")).drop("_seen")
