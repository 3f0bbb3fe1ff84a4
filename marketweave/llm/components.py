"""Connected components by alternating large-star and small-star on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketweave.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of edges(u, v); component is the least id reachable.

    Self edges and nulls are ignored; repeated and reversed edges count once; an empty table gives an
    empty table. Each round is written to the shared folder. It ends when the edges form stars: every
    node has one edge, to a node that has none of its own.
    """
    e = edges.where("u is not null and v is not null and u <> v").select("u", "v")
    while True:
        e = materialise(_small_star(_large_star(e)), "stars")
        chained = e.join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi")
        if chained.isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
