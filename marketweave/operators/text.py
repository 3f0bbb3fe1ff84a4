"""Text jobs: sentences, article tests and nearest vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Queries and vectors of a search that meet in one group, and vectors that are scored at once.
QUERY_BLOCK, VECTOR_BLOCK, CHUNK = 2_000, 20_000, 2_000


def sentences(text: Column) -> Column:
    """Split behind a stop and white space; the stop stays."""
    return F.split(text, r"(?<=\.)\s+")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine of two vectors, whose norms may be known; unequal lengths and null vectors give 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    sizes = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.size(a) == F.size(b), F.coalesce(dot / F.nullif(sizes, F.lit(0.0)), F.lit(0.0))).otherwise(0.0)


def _nearest(key: str, vector: str, k: int, threshold: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Of a block of vectors and one of queries the k nearest of each query, ties by key; score is in whole millionths, as it is rounded to."""

    def dense(rows: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([-1 if v is None else len(v) for v in rows], np.int64)
        out = np.zeros((len(rows), size))
        for i, v in enumerate(rows):
            if v is not None:
                out[i, : len(v)] = v
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norms, out=np.zeros_like(out), where=norms != 0), sizes

    def run(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        vectors = vectors.sort_values(key, ignore_index=True)
        size = max((len(v) for rows in (vectors[vector], queries["_q"]) for v in rows if v is not None), default=0)
        asked, asked_sizes = dense(queries["_q"], size)
        parts = [pd.DataFrame({"query": queries["query"].iloc[:0], key: vectors[key].iloc[:0], "score": np.zeros(0)})]
        for at in range(0, len(vectors) if len(queries) else 0, CHUNK):
            some = vectors.iloc[at : at + CHUNK]
            held, held_sizes = dense(some[vector], size)
            score = np.where(asked_sizes[:, None] == held_sizes[None, :], asked @ held.T, 0.0)
            micros = np.rint(score * 1e6)
            order = np.where(np.isnan(micros), -np.inf, -micros)
            order[queries["query"].to_numpy()[:, None] == some[key].to_numpy()[None, :]] = np.inf
            if threshold > -1:
                order[micros / 1e6 < threshold] = np.inf
            last = np.partition(order, min(k, order.shape[1]) - 1, axis=1)[:, min(k, order.shape[1]) - 1 :][:, :1]
            q, v = np.nonzero((order <= last) & (order < np.inf))
            by = np.lexsort((v, order[q, v], q))
            q, v = q[by], v[by]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, v = q[first], v[first]
            parts.append(pd.DataFrame({"query": queries["query"].to_numpy()[q], key: some[key].to_numpy()[v], "score": micros[q, v] / 1e6}))
        return pd.concat(parts[1:] or parts, ignore_index=True)

    return run


def cosine_topk(queries: DataFrame, vectors: DataFrame, key: str, vector: str, group: str | None, k: int, threshold: float = -1.0) -> DataFrame:
    """The k nearest of all vectors for every query, ties by key; a group keeps to the vectors of the query's own.

    Blocks of about QUERY_BLOCK queries meet blocks of vectors, each pair of blocks a group of its own, which is one product of matrices and
    leaves k rows a query. Vectors are sent once for each block of queries.
    """
    by = [group] if group else []
    known = F.when(~F.exists(vector, lambda x: x.isNull()), F.col(vector))  # a vector with a gap scores 0
    q = queries.select(F.col(key).alias("query"), *by, known.alias("_q"))
    v = vectors.select(key, *by, known.alias(vector))
    if group:
        q, v = q.where(F.col(group).isNotNull()), v.where(F.col(group).isNotNull())
    blocks = -(-q.count() // QUERY_BLOCK) or 1
    dealt = max(-(-v.count() // VECTOR_BLOCK), 1 if group else int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select("*", place("query", blocks).alias("_b"), every(dealt).alias("_c"))
    v = v.select("*", every(blocks).alias("_b"), place(key, dealt).alias("_c"))
    of = queries.schema[key].dataType
    schema = StructType([StructField("query", of), StructField(key, vectors.schema[key].dataType), StructField("score", DoubleType())])
    rows = v.groupBy(*by, "_b", "_c").cogroup(q.groupBy(*by, "_b", "_c")).applyInPandas(_nearest(key, vector, k, threshold), schema)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), key))).where(F.col("place") <= k)
