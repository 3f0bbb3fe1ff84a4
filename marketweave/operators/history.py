"""Prices, metrics and standings over time: what holds now, what changed, who disagrees.

The newest row of a key is an aggregation of structs, not a window: Spark combines it before the
shuffle, so a key with a third of all rows leaves each task as one row. Null order values lose to others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by the order columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in df.columns if c not in keys])


def current_price(prices: DataFrame, keys: list[str], own: Column, taken_at: str, seq: list[str], days: int = 45) -> DataFrame:
    """One row per key: the seller's own newest figure while it is within so many days of the newest word, else the newest.

    seq orders figures of one day; the last wins. The column own_page tells which rule decided.
    """
    rest = [c for c in prices.columns if c not in keys and c not in [taken_at, *seq]]
    row = F.struct(taken_at, *seq, *rest)
    best = prices.groupBy(*keys).agg(F.max(row).alias("_any"), F.max(F.when(own, row)).alias("_own"))
    fresh = F.coalesce(F.col("_own")[taken_at] >= F.date_sub(F.col("_any")[taken_at], days), F.lit(False))
    best = best.withColumn("own_page", fresh).withColumn("_row", F.when(fresh, F.col("_own")).otherwise(F.col("_any")))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in prices.columns if c not in keys], "own_page")


def current_standing(standings: DataFrame, keys: list[str], taken_at: str, rank: str, seq: list[str]) -> DataFrame:
    """One row per key: the newest reading, in it the best rank (null last), then the last ingested."""
    with_neg = standings.withColumn("_neg", -F.col(rank))
    return latest(with_neg, keys, [taken_at, "_neg", *seq]).drop("_neg")


def changes(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Rows whose values, taken together, differ from the previous row of their key; the first always counts."""
    w = W.partitionBy(*keys).orderBy(*order)
    now = F.struct(*values)
    marked = df.withColumn("_was", F.lag(now).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    return marked.where(F.col("_first") | ~now.eqNullSafe(F.col("_was"))).drop("_was", "_first")


def first_writer(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first figure of each key stands; clashes counts the later ones that differ from it."""
    row = F.struct(*order, value)
    first = df.groupBy(*keys).agg(F.min(row).alias("_first"), F.count(value).alias("_n"))
    same = df.groupBy(*keys, value).agg(F.count("*").alias("_same"))
    joined = first.select(*keys, F.col("_first")[value].alias(value), "_n").join(same, [*keys, value], "left")
    return joined.select(*keys, value, (F.col("_n") - F.coalesce("_same", F.lit(0))).alias("clashes"))


def disputed(df: DataFrame, keys: list[str], source: str, order: list[str], value: str) -> DataFrame:
    """Keys whose sources' latest figures differ: low, high, figures, sources and the ratio high / low."""
    heard = latest(df.select(*keys, source, *order, value), [*keys, source], order)
    out = heard.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.countDistinct(value).alias("figures"), F.count("*").alias("sources"))
    return out.where("figures > 1").withColumn("ratio", F.col("high") / F.nullif(F.col("low"), F.lit(0)))


def agreement(df: DataFrame, keys: list[str], source: str, order: list[str], value: str) -> DataFrame:
    """How many sources' latest figures equal the newest one, and how many spoke."""
    heard = latest(df.select(*keys, source, *order, value), [*keys, source], order)
    top = heard.groupBy(*keys).agg(F.max(F.struct(*order, value)).alias("_top"), F.count("*").alias("spoke"))
    figures = heard.groupBy(*keys, value).agg(F.count("*").alias("agreed"))
    return top.select(*keys, F.col("_top")[value].alias(value), "spoke").join(figures, [*keys, value])


def unambiguous(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with one distinct figure, and the figure."""
    return df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).where(F.col("_low") == F.col("_high")).select(*keys, F.col("_low").alias(value))


def outliers(df: DataFrame, group: list[str], value: str, times: float = 150, least: int = 20) -> DataFrame:
    """Rows above so many times the mean of their group, where the group has more than least rows."""
    mean = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.count("*").alias("n")).where(F.col("n") > least)
    return df.join(mean, group).where(F.col(value) > times * F.col("mean"))
