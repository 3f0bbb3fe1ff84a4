"""Places, running sums and previous rows over a whole order, without one task for a whole group.

Rows are dealt by ranges of (group, order) and written, so that a group of any size lies in many partitions.
Windows then work within a partition's part of a group; what each part carries on to the next is one row a part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketweave.functions.scratch import written

_PART = "_part"


def dealt(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """df by ranges of group and order, with the number of its range in _part; order must name a row for results that do not depend on the run."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in group), *order).withColumn(_PART, F.spark_partition_id()), "ordered")


def _carried(parts: DataFrame, group: list[str], sums: dict[str, str]) -> DataFrame:
    """parts(group, _part, totals) with what the parts before each add up to; as many rows a group as it has partitions."""
    before = W.partitionBy(*group).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*group, _PART, *(F.coalesce(F.sum(total).over(before), F.lit(0)).alias(total) for total in sums.values()))


def _joined(rows: DataFrame, parts: DataFrame, group: list[str]) -> DataFrame:
    """rows with the columns that parts has for their partition and group; a null group meets a null one."""
    renamed = parts.select(F.col(_PART).alias("_p"), *(F.col(c).alias(f"_g_{c}") for c in group), *(c for c in parts.columns if c not in (*group, _PART)))
    same = F.col(_PART) == F.col("_p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return rows.join(renamed, same).drop("_p", *(f"_g_{c}" for c in group))


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str], place: str | None = None) -> DataFrame:
    """df with place, from 1, in its group's order, and the running sums, own row included, of the columns that sums names: {column: new column}."""
    rows = dealt(df, group, order)
    wanted = {**sums, **({"_one": place} if place else {})}
    rows = rows.withColumn("_one", F.lit(1).cast("long"))
    here = W.partitionBy(_PART, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy(*group, _PART).agg(*(F.sum(c).alias(f"_t_{new}") for c, new in wanted.items()))
    carried = _carried(totals, group, {c: f"_t_{new}" for c, new in wanted.items()})
    rows = _joined(rows.select("*", *(F.coalesce(F.sum(c).over(here), F.lit(0)).alias(new) for c, new in wanted.items())), carried, group)
    kept = [F.col(c) for c in df.columns if c not in wanted.values()]
    return rows.select(*kept, *((F.col(new) + F.col(f"_t_{new}")).alias(new) for new in wanted.values()))


def placed(df: DataFrame, group: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """df with its place, from 1, in the group's order."""
    return running(df, group, order, {}, place)


def previous(df: DataFrame, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """df with the value of the row before in its group's order; null in the first. value is not null."""
    rows = dealt(df, group, order)
    here = W.partitionBy(_PART, *group).orderBy(*order)
    rows = rows.select("*", F.lag(value).over(here).alias("_lag"), F.row_number().over(here).alias("_n"), F.count("*").over(here.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_of"))
    ends = rows.where("_n = _of").select(*group, _PART, F.col(value).alias("_end"))
    before = ends.select(*group, _PART, F.lag("_end").over(W.partitionBy(*group).orderBy(_PART)).alias("_before"))
    return _joined(rows, before, group).select(*df.columns, F.coalesce("_lag", F.when(F.col("_n") == 1, F.col("_before"))).alias(name))


def upper_median(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, a median for each value column): of an even number of values the upper of the middle two; nulls do not count.

    All columns are ranked in one pass, as one column of values with the number of the one it came from.
    """
    stacked = df.select(*keys, F.posexplode(F.array(*(F.col(v).cast("double") for v in values))).alias("_of", "_value")).where("_value is not null")
    rows = placed(stacked, [*keys, "_of"], [F.col("_value")], "_place")
    n = stacked.groupBy(*keys, "_of").agg(F.count("*").alias("_n"))
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in (*keys, "_of")]
    middle = rows.alias("_l").join(n.alias("_r"), same).where("_place = _n div 2 + 1").select("_l.*")
    return middle.groupBy(*keys).agg(*(F.max(F.when(F.col("_of") == i, F.col("_value"))).alias(v) for i, v in enumerate(values)))
