"""Progress events that are let through: the first, then each that comes a gap or more after the last one let through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _settled(rows: DataFrame, checkpoint: bool) -> DataFrame:
    return rows.checkpoint() if checkpoint else rows.persist()


def successors(events: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """(key, at, next) for each distinct time: the first time of the key that is ``gap`` or more later, null if there is none.

    Times are dealt into slots of one gap. What is a gap later lies in the next slot, or is the first time of a
    later one; so times are compared within two neighbouring slots only, and of each slot one row meets the others of its key.
    """
    slot = F.floor(F.col(at) / gap)
    times = events.select(key, at).where(F.col(at).isNotNull()).distinct()
    rows = times.select(key, at, slot.alias("slot"), F.lit(True).alias("real")).unionByName(times.select(key, (F.col(at) + gap).alias(at), (slot + 1).alias("slot"), F.lit(False).alias("real")))
    # of a slot's times and of the times asked for in it: the first real one from each on
    ahead = W.partitionBy(key, "slot").orderBy(at).rangeBetween(W.currentRow, W.unboundedFollowing)
    near = rows.withColumn("near", F.min(F.when(F.col("real"), F.col(at))).over(ahead)).where("not real")
    firsts = times.groupBy(key, slot.alias("slot")).agg(F.min(at).alias("first"))
    # slots that are asked about take the first time of the slots after them
    asked = near.select(key, "slot").distinct().join(firsts, [key, "slot"], "full")
    after = F.min("first").over(W.partitionBy(key).orderBy("slot").rowsBetween(1, W.unboundedFollowing))
    later = asked.withColumn("later", after).select(key, "slot", "later")
    found = near.join(later, [key, "slot"])
    return found.select(key, (F.col(at) - gap).alias(at), F.coalesce("near", "later").alias("next"))


def throttled(events: DataFrame, key: str, at: str, gap: int, tie: str, checkpoint: bool = False) -> DataFrame:
    """``events`` that are let through, by key: the first, those ``gap`` or more after the last let through, and the very last.

    Whether one passes depends on the one before that passed, so this is no window with ``lag``. Each time points to
    the first time a gap later; following these pointers from a key's first time gives those let through. They
    are followed by doubling: after k steps the pointers jump 2^k passes, and all times within 2^k passes are
    known. A step is a join on (key, time), so a key with a third of all rows is split like any other.
    Of equal times the first by ``tie`` counts. Rows without a time are not let through. ``at`` and ``gap`` are whole numbers.
    """
    spark = events.sparkSession
    checkpoint = checkpoint or spark.sparkContext.getCheckpointDir() is not None
    jump = _settled(successors(events, key, at, gap).where("next is not null"), checkpoint)
    passed = _settled(events.where(F.col(at).isNotNull()).groupBy(key).agg(F.min(at).alias(at)), checkpoint)
    while True:
        reached = passed.join(jump, [key, at]).select(key, F.col("next").alias(at))
        more = _settled(passed.unionByName(reached).distinct(), checkpoint)
        if more.count() == passed.count():
            break
        passed = more
        further = jump.select(key, F.col(at).alias("next"), F.col("next").alias("then"))
        jump = _settled(jump.join(further, [key, "next"]).select(key, at, F.col("then").alias("next")), checkpoint)
    # of equal times the first by tie, and the end of each key
    first = events.join(passed, [key, at]).groupBy(key, at).agg(F.min(tie).alias(tie))
    last = events.where(F.col(at).isNotNull()).groupBy(key).agg(F.max(F.struct(at, tie)).alias("m")).select(key, f"m.{at}", f"m.{tie}")
    return events.join(first.unionByName(last).distinct(), [key, at, tie], "left_semi").select(*events.columns)
