"""Keep a ledger of recorded events by day, user and type, as a stream over files that are added.

The stream takes each file once: its checkpoint knows which were taken. Every batch is summed and written
as a partition of its own, over whatever a batch of that number left before, so a replayed batch changes nothing:

    OUTPUT/sums/batch=N/day=D/   what batch N adds to each (day, user, type)
    OUTPUT/folded/batch=N/       the last batch whose days are in the ledger; written last
    OUTPUT/ledger/day=D/         the ledger; only days that new batches touched are written again

Sums are decimal, so their order does not matter. Sums, counts, first and last times of batches are combined
by the same aggregates; numbers of sessions are not kept, as batches cut them.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common

log = logging.getLogger("event_ledger")

KEYS = ("day", "user_id", "event_type")
SUMS = "user_id long, event_type string, events long, without_value long, total decimal(38,6), first_ts timestamp_ntz, last_ts timestamp_ntz, batch long, day date"
LEDGER = "user_id long, event_type string, events long, without_value long, total decimal(38,6), first_ts timestamp_ntz, last_ts timestamp_ntz, day date"


def summed(events: DataFrame, decimals: int) -> DataFrame:
    """Counts, totals and times by (day, user, type). Null times, users and types are keys like any other, null values count apart."""
    value = F.when(~F.isnan("value"), F.col("value")).cast(f"decimal(38,{decimals})")
    day = F.to_date("ts").alias("day")
    return events.groupBy(day, "user_id", "event_type").agg(
        F.count("*").alias("events"), F.count_if(value.isNull()).alias("without_value"), F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,6)").alias("total"),
        F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.max("ts").cast("timestamp_ntz").alias("last_ts"),
    )


def combined(sums: DataFrame) -> DataFrame:
    """The sums of several batches as one."""
    added = [F.sum(c).alias(c) for c in ("events", "without_value")] + [F.sum("total").cast("decimal(38,6)").alias("total")]
    return sums.groupBy(*KEYS).agg(*added, F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def folded(spark: SparkSession, output: str) -> int:
    have = common.written(spark, f"{output}/folded", "batch long", "json")
    last = have.agg(F.max("batch")).first()[0] if have is not None else None
    return -1 if last is None else last


def fold(spark: SparkSession, output: str) -> int:
    """Bring the ledger's days up to the batches that are there; returns the number of days written."""
    sums = common.written(spark, f"{output}/sums", SUMS)
    if sums is None:
        return 0
    done = folded(spark, output)
    new = sums.where(F.col("batch") > done)
    last = new.agg(F.max("batch")).first()[0]
    if last is None:
        return 0
    days = [r.day for r in new.select("day").distinct().collect()]  # days, as the partitions have them
    known = [d for d in days if d is not None]
    touched = F.col("day").isin(known) if known else F.lit(False)
    touched = touched | F.col("day").isNull() if None in days else touched
    ledger = combined(sums.where(touched)).repartition("day", F.pmod(F.xxhash64("user_id"), F.lit(8)))
    ledger.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/ledger")
    mark = spark.createDataFrame([(f"{len(days)} days",)], "note string")
    mark.coalesce(1).write.mode("overwrite").json(f"{output}/folded/batch={last}")
    log.info("batches %d to %d: %d days of the ledger written", done + 1, last, len(days))
    return len(days)


def run(spark: SparkSession, events: str, output: str, checkpoint: str, config: dict) -> int:
    """Take all files that are new, then stop; returns the number of days written."""
    source = spark.read.parquet(events)
    # as a pattern, a path of one file is taken like a folder of files; this one matches the path alone
    pattern = f"{events.rstrip('/')[:-1]}[{events.rstrip('/')[-1]}]"
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(pattern)

    def add(batch: DataFrame, number: int) -> None:
        # the batch's own session writes it, whatever becomes of the caller's settings meanwhile
        rows = summed(batch.select("ts", "user_id", "event_type", "value"), config["decimals"])
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{output}/sums/batch={number}")
        log.info("batch %d: sums written to %s/sums", number, output)

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("read %d rows of %s", sum(p.numInputRows for p in query.recentProgress), events)
    return fold(spark, output)


def ledger(spark: SparkSession, output: str) -> DataFrame:
    """The ledger as it stands."""
    return spark.read.schema(LEDGER).parquet(f"{output}/ledger")


def job2_event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all events after two runs, the second of which finds no new file."""
    folder, config = common.new_folder(spark, "event_ledger"), common.settings("event_ledger")
    for _ in range(2):
        run(spark, f"{sf_dir}/events.parquet", f"{folder}/out", f"{folder}/checkpoint", config)
    return ledger(spark, f"{folder}/out").withColumns({"day": F.col("day").cast("string"), "total": F.col("total").cast("double")})


SQL = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id, event_type, count(*) AS events, count(*) FILTER (value IS NULL OR isnan(value)) AS without_value,
  CAST(coalesce(sum(CAST(CASE WHEN NOT isnan(value) THEN value END AS DECIMAL(38,6))), 0) AS DOUBLE) AS total, min(ts) AS first_ts, max(ts) AS last_ts
FROM events GROUP BY ALL
"""


if __name__ == "__main__":
    paths = {"events": "the events table", "output": "sums and ledger, made or brought up to date", "checkpoint": "what the stream has taken"}
    common.command("event_ledger", lambda spark, a, config: run(spark, a.events, a.output, a.checkpoint, config), paths)
