"""Exact order statistics of large groups, by counting ranges instead of gathering values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that a group's open range is cut into at each step.
RANGES = 1 << 10


def of_rank(values: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(keys, ``name``, value) for ``ranks`` (keys, ``name``, ``rank`` from 0): the value of that rank among its group's, nulls and NaN left out.

    Each step counts the values by range, within the range that is still open for each rank, and goes on
    with the range that holds the rank, until its least and greatest values are one. So a step shuffles at most
    ``RANGES`` rows a rank and task, and no task gets a group's values. Ranks beyond a group have no row.
    """
    rows = values.select(*keys, F.col(value).alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan(F.col("__v").cast("double")))
    whole = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    spark = values.sparkSession
    # one row a group and name: the open range, and the rank within it
    state = ranks.select(*keys, "name", "rank").join(whole, keys).where((F.col("rank") >= 0) & (F.col("rank") < F.col("__n"))).drop("__n")
    schema, done = state.schema, []
    while True:
        open_ = state.collect()  # as many rows as were asked for
        done += [r for r in open_ if r["__low"] == r["__high"]]
        open_ = [r for r in open_ if r["__low"] != r["__high"]]
        if not open_:
            break
        state = spark.createDataFrame(open_, schema)
        met = rows.join(F.broadcast(state), keys).where(F.col("__v").between(F.col("__low"), F.col("__high")))
        share = (F.col("__v") / 2 - F.col("__low") / 2) / (F.col("__high") / 2 - F.col("__low") / 2)  # halves, so that no difference overflows
        counted = met.groupBy(*keys, "name", "rank", F.floor(share.cast("double") * (RANGES - 1)).alias("__range")).agg(
            F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")
        )
        upto = F.sum("__n").over(W.partitionBy(*keys, "name").orderBy("__range"))
        held = counted.withColumn("__upto", upto).where((F.col("__upto") > F.col("rank")) & (F.col("__upto") - F.col("__n") <= F.col("rank")))
        state = held.select(*keys, "name", (F.col("rank") - F.col("__upto") + F.col("__n")).alias("rank"), "__low", "__high")
    found = spark.createDataFrame(done, schema)
    return found.select(*keys, "name", F.col("__low").alias(value))


def percentiles(values: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row a group with a column for each of ``wanted``: {column: ("floor" or "nearest", percent)}.

    "floor" is the value at the whole part of p / 100 * (n - 1), "nearest" that of rank ceil(p / 100 * n), at least the first.
    """
    n = F.count(F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))
    at = {"floor": lambda p: F.floor(F.lit(p / 100) * (F.col("n") - 1)), "nearest": lambda p: F.greatest(F.ceil(F.lit(p / 100) * F.col("n")) - 1, F.lit(0))}
    sizes = values.groupBy(*keys).agg(n.alias("n"))
    ranks = F.array(*[F.struct(F.lit(c).alias("name"), at[kind](p).cast("long").alias("rank")) for c, (kind, p) in wanted.items()])
    ranks = sizes.select(*keys, F.explode(ranks).alias("r")).select(*keys, "r.name", "r.rank")
    return of_rank(values, keys, value, ranks).groupBy(*keys).pivot("name", list(wanted)).agg(F.first(value))
