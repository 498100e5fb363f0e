"""Text and array functions against plain Python."""

import time

from pyspark.sql import functions as F

from tomeforge.functions import text
from tomeforge.operators import packing


def test_durations(spark):
    """Tenths are those of the exact value of the double, ties to even."""
    want = {0: "0.0s", 49: "0.0s", 50: "0.1s", 150: "0.1s", 250: "0.2s", 350: "0.3s", 450: "0.5s", 750: "0.8s", 949: "0.9s", 59_000: "59.0s", 59_950: "60.0s", 60_000: "1m 00s", 125_000: "2m 05s"}
    want |= {ms: f"{ms / 1000:.1f}s" for ms in range(50, 60_000, 100)}
    rows = spark.createDataFrame([(k,) for k in want], "ms long").select("ms", text.duration(F.col("ms")).alias("d")).collect()
    assert {r.ms: r.d for r in rows} == want


def test_long_rows_are_folded_in_time(spark):
    """A row of 200,000 sizes, against a plain loop, within seconds."""
    sizes = [(i * 7919) % 100 for i in range(200_000)]
    part, total, want = 0, None, []
    for n in sizes:
        if total is not None and total + n > 200:
            part, total = part + 1, n
        else:
            total = n + (total or 0)
        want.append(part)
    row = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(199_999)), lambda i: (i.cast("long") * 7919 % 100)).alias("s"))
    began = time.monotonic()
    assert row.select(packing.greedy_parts(F.col("s"), 200).alias("p")).first().p == want
    assert row.limit(0).select(packing.greedy_parts(F.col("s"), 200)).collect() == []
    assert spark.range(1).select(packing.greedy_parts(F.array().cast("array<bigint>"), 200).alias("p")).first().p == []
    assert time.monotonic() - began < 30
