"""Reports: one row per entity or standing, from current prices and readings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.operators import boards


def find_index(current: DataFrame, standings: DataFrame, entity: str, seller: str, dimension: str, value: str, taken_at: str, lead: str, out: str, suite: str = "suite", rank: str = "rank", out_of: str = "out_of") -> DataFrame:
    """One row per sold entity: its lowest rates in two units, the dearest, sellers, the freshest date, best place and boards."""
    low = lambda d: F.min(F.when(F.col(dimension) == d, F.col(value)))
    rates = current.where(F.col(value) > 0).groupBy(entity).agg(low(lead).alias("lead_rate"), low(out).alias("out_rate"), F.max(value).alias("dearest"), F.countDistinct(seller).alias("sellers"), F.max(taken_at).alias("freshest"))
    placed = standings.where(F.col(rank).isNotNull() & (F.col(out_of) > 1)).groupBy(entity).agg(F.min(rank).alias("best_place"), F.countDistinct(suite).alias("boards"))
    return rates.join(placed, entity, "left").withColumn("boards", F.coalesce("boards", F.lit(0)))


def board_report(readings: DataFrame, suite: str, entity: str, value: str) -> DataFrame:
    """Each current reading on its board with mixed scales lifted, its bar, its place and the size of the field."""
    lifted = boards.mixed_scale_lift(readings, suite, value)
    return boards.rank_board(boards.score_bar(lifted, suite, value), suite, value, [entity])


def newest_dates(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """The newest date of every key over several (table, key, date); each is reduced before they meet."""
    parts = [df.groupBy(F.col(key).alias("key")).agg(F.max(date).alias("newest")) for df, key, date in tables]
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.max("newest").alias("newest"))
