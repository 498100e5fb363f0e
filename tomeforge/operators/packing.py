"""Ordered greedy packing as a fold over an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import in_parts, with_value


def greedy_parts(sizes: Column, most: int) -> Column:
    """For each of an array of sizes, the number of its part: a part is closed when the next size would not fit.

    Whether a part closes depends on where it opened, so this is no window; it is one pass in the row. What is
    done is kept in pieces of an array each, so that a long row is not copied at every step.
    """
    ints = F.array().cast("array<int>")
    step = lambda a, n: (a["n"] > 0) & (a["sum"] + n > most)

    def add(a: Column, n: Column) -> Column:
        part = a["part"] + step(a, n).cast("int")
        total = F.when(step(a, n), n).otherwise(a["sum"] + n).cast("long")
        return F.struct(total.alias("sum"), part.alias("part"), F.lit(1).alias("n"), F.concat(a["parts"], F.array(part)).alias("parts"))

    def add_all(a: Column, piece: Column) -> Column:
        zero = F.struct(a["sum"].alias("sum"), a["part"].alias("part"), a["n"].alias("n"), ints.alias("parts"))
        done = F.aggregate(piece, zero, add)
        return with_value(done, lambda d: F.struct(d["sum"].alias("sum"), d["part"].alias("part"), d["n"].alias("n"), F.concat(a["pieces"], F.array(d["parts"])).alias("pieces")))

    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("part"), F.lit(0).alias("n"), F.array().cast("array<array<int>>").alias("pieces"))
    return F.flatten(F.aggregate(in_parts(sizes), zero, add_all)["pieces"])
