"""Which interval covers a point first: an index of intervals by powers of two, so that the join is an equality.

Every interval is cut into blocks of 2^k lines that begin at a multiple of 2^k, at most two of each size. Of each
block the least of its intervals is kept, which is all that a point in it can ask for. A point lies in one block of
each size, so it meets at most some thirty rows, however many intervals its key has, and no key gathers pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of blocks, as powers of two: enough for all ints.
SIZES = 32


def blocks(start: Column, end: Column) -> Column:
    """The blocks (k, at) that make up the lines from ``start`` to ``end``, both included and not negative."""
    start, end, sizes = start.cast("long"), end.cast("long"), F.sequence(F.lit(0), F.lit(SIZES - 1))
    bounds = F.transform(sizes, lambda k: F.struct(k.alias("k"), F.ceil(start / F.pow(F.lit(2.0), k)).alias("low"), F.floor((end + 1) / F.pow(F.lit(2.0), k)).alias("high")))
    block = lambda k, at: F.struct(k.alias("k"), at.cast("long").alias("at"))
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    ends = lambda b: F.array(F.when(odd(b["low"]), block(b["k"], b["low"])), F.when(odd(b["high"]), block(b["k"], b["high"] - 1)))
    return F.array_compact(F.flatten(F.transform(F.filter(bounds, lambda b: b["low"] < b["high"]), ends)))


def first_cover(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, order: Column, value: str) -> DataFrame:
    """``points`` with ``value`` of the least interval, by ``order``, of equal keys that covers ``at``; null if none does.

    Null keys and places meet nothing, and an interval that ends before it starts covers nothing. Points that are
    alike are looked up once, and intervals alike are cut into blocks once.
    """
    # of intervals alike the least stays before they are cut, as one small file is one task, which would sort all blocks of its rows
    least = F.min(F.struct(order.alias("__order"), value)).alias("__least")
    alike = intervals.groupBy(*keys, F.col(start).alias("__start"), F.col(end).alias("__end")).agg(least)
    index = alike.select(*keys, "__least", F.explode(blocks(F.col("__start"), F.col("__end"))).alias("__b"))
    index = index.groupBy(*keys, F.col("__b.k").alias("__k"), F.col("__b.at").alias("__at")).agg(F.min("__least").alias("__least"))
    places = points.select(*keys, at).where(F.col(at) >= 0).distinct()
    asked = places.select(*keys, at, F.explode(F.sequence(F.lit(0), F.lit(SIZES - 1))).alias("__k"))
    asked = asked.withColumn("__at", F.floor(F.col(at) / F.pow(F.lit(2.0), F.col("__k"))).cast("long"))
    # the sizes that occur are few, and a row each
    asked = asked.join(F.broadcast(index.select("__k").distinct()), "__k", "left_semi")
    met = asked.join(index, [*keys, "__k", "__at"])
    least = met.groupBy(*keys, at).agg(F.min("__least").alias("__least"))
    return points.join(least.select(*keys, at, F.col("__least")[value].alias(value)), [*keys, at], "left").select(*points.columns, value)
