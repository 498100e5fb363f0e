"""Exact vector search, and fusion of rank lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K, VECTOR_CAP = 60, 200


def valid(v: Column, dimension: int) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimension) & fine, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for lengths that differ, empty vectors and zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.coalesce(F.when(fine & (norms > 0), dot(a, b) / norms), F.lit(0.0))


def scored(rows: DataFrame, query: DataFrame, vector: str) -> DataFrame:
    """``rows`` with their cosine to the one row of ``query``: a scan, with the query broadcast."""
    one = F.broadcast(query.select(F.col(vector).alias("__query")).limit(1))
    return rows.crossJoin(one).withColumn("cosine", cosine(F.col(vector), F.col("__query"))).drop("__query", vector)


def top(found: DataFrame, n: int, key: str = "vec_id") -> DataFrame:
    return found.orderBy(F.desc("cosine"), key).limit(n)


def ranked(found: DataFrame, most: int = VECTOR_CAP, space: str | None = None, key: str = "vec_id") -> DataFrame:
    """``rank`` from 1 in each space. Without spaces the list is cut to ``most`` before one task ranks it."""
    if space is None:
        return top(found, most, key).withColumn("rank", F.row_number().over(W.orderBy(F.desc("cosine"), key)))
    return found.withColumn("rank", F.row_number().over(W.partitionBy(space).orderBy(F.desc("cosine"), key))).where(F.col("rank") <= most)


def fused(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (key, rank) lists, ranks from 1."""
    every = reduce(DataFrame.unionByName, [x.select(key, "rank") for x in lists])
    return every.groupBy(key).agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))
