"""Leaderboards: ranks over the whole field, percentiles, scale repair and headline metrics. A board of any size is ranked by ranges of its values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketweave.functions import ordered


def rank_board(df: DataFrame, suite: str, value: str, order: list[str], lower: bool = False) -> DataFrame:
    """rank is the place in the suite's whole field, ties by the order columns; out_of is its size."""
    by = F.col(value).asc_nulls_last() if lower else F.col(value).desc_nulls_last()
    field = df.groupBy(suite).agg(F.count("*").alias("out_of"))
    return ordered.placed(df, [suite], [by, *map(F.col, order)], "rank").join(field, suite)


def best_config(df: DataFrame, keys: list[str], rank: str, effort: str, efforts: list[str]) -> DataFrame:
    """One row per key: the best rank, then the cheapest effort in the given order."""
    cost = F.coalesce(F.array_position(F.array(*map(F.lit, efforts)), F.col(effort)), F.lit(0))
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(F.col(rank).alias("_r"), cost.alias("_c"), *rest)).alias("_b"))
    return best.select(*keys, *[F.col("_b")[c].alias(c) for c in rest])


def headline_metric(df: DataFrame, suite: str, metric: str, entity: str) -> DataFrame:
    """The metric of a suite that most entities have, the first by name among equals."""
    n = df.groupBy(suite, metric).agg(F.countDistinct(entity).alias("entities"))
    top = n.groupBy(suite).agg(F.min(F.struct((-F.col("entities")).alias("_n"), metric)).alias("_t"))
    return top.select(suite, F.col("_t")[metric].alias(metric), (-F.col("_t._n")).alias("entities"))


def separates(df: DataFrame, suite: str, value: str, least_rows: int = 8, least: float = 0.05) -> DataFrame:
    """Boards whose top tenth stands apart: (highest - value at the nine-tenths place) / range, and whether it is enough."""
    size = df.groupBy(suite).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    placed = ordered.placed(df.select(suite, value), [suite], [F.col(value)], "_place").join(size, suite)
    at = F.max(F.when(F.col("_place") == F.col("n") - F.greatest(F.floor(F.col("n") / 10), F.lit(1)), F.col(value))).alias("edge")
    out = placed.groupBy(suite, "n", "low", "high").agg(at)
    spread = (F.col("high") - F.col("edge")) / F.nullif(F.col("high") - F.col("low"), F.lit(0))
    return out.select(suite, "n", spread.alias("spread"), F.coalesce((spread >= least) & (F.col("n") >= least_rows), F.lit(False)).alias("separates"))


def percentile_standing(df: DataFrame, entity: str, suite: str, rank: str, out_of: str) -> DataFrame:
    """Share of the field beaten, averaged over an entity's boards, and its best board."""
    share = 1 - (F.col(rank) - 1) / (F.col(out_of) - 1)
    rows = df.where(F.col(rank).isNotNull() & (F.col(out_of) > 1)).withColumn("share", share)
    best = F.max(F.struct("share", out_of, suite)).alias("_b")
    return rows.groupBy(entity).agg(F.avg("share").alias("mean_share"), F.count("*").alias("boards"), best).select(entity, "mean_share", "boards", F.col("_b.share").alias("best_share"), F.col("_b")[suite].alias("best_board"))


def score_bar(df: DataFrame, suite: str, value: str, lower: bool = False) -> DataFrame:
    """Min-max place of each score on its board, from 2 to 100; null on a board with one value, where there is nothing to draw."""
    ends = df.groupBy(suite).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    share = (F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0))
    share = 1 - share if lower else share
    return df.join(ends, suite).withColumn("bar", F.when(share.isNotNull(), F.greatest(F.least(share * 100, F.lit(100.0)), F.lit(2.0)))).drop("_low", "_high")


def mixed_scale_lift(df: DataFrame, suite: str, value: str) -> DataFrame:
    """On a board with values both above 1.5 and at most 1, the small ones are lifted by 100 and marked."""
    mixed = df.groupBy(suite).agg((F.max(F.col(value) > 1.5) & F.max(F.col(value) <= 1)).alias("_mixed"))
    lift = F.col("_mixed") & (F.col(value) <= 1)
    return df.join(mixed, suite).withColumn("lifted", lift).withColumn(value, F.when(lift, F.round(F.col(value) * 100, 3)).otherwise(F.col(value))).drop("_mixed")


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of an even number of values the upper of the middle two, by place and not from a list in memory."""
    return ordered.upper_median(df, keys, [value]).withColumnRenamed(value, "median")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
