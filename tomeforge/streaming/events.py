"""Streams: change events to publications, event envelopes, live counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

PENDING_MOST = 4096


def quiet_periods(changes: DataFrame, quiet: str = "200 milliseconds", late: str = "1 minute") -> DataFrame:
    """(scope, opened, changes, paths): one row for each burst of changes (scope, path, ts) that a quiet time ends.

    More than ``PENDING_MOST`` distinct paths ask for a full build instead of a list.
    """
    bursts = changes.withWatermark("ts", late).groupBy("scope", F.session_window("ts", quiet).alias("w"))
    found = bursts.agg(F.count("*").alias("changes"), F.collect_set("path").alias("paths"))
    full = F.size("paths") > PENDING_MOST
    return found.select("scope", F.col("w.start").alias("opened"), "changes", full.alias("full"), F.when(~full, F.array_sort("paths")).alias("paths"))


def windowed(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return found.agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


class EnvelopeCheck(StatefulProcessor):
    """Faults of each run's events: numbers out of order, and anything after the one terminal event."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, ended = self.state.get() or (-1, False)
        faults = []
        for number, kind in sorted((int(n), k) for frame in rows for n, k in zip(frame["sequence"], frame["type"])):
            if ended:
                faults.append((key[0], number, "after the end"))
            elif number != last + 1:
                faults.append((key[0], number, "gap" if number > last else "repeat"))
            last, ended = max(last, number), ended or kind in ("completed", "cancelled", "failed")
        self.state.update((last, ended))
        yield pd.DataFrame(faults, columns=["run_id", "sequence", "fault"])

    def close(self) -> None:
        pass


def envelope_faults(events: DataFrame) -> DataFrame:
    """(run_id, sequence, fault) over a stream of (run_id, sequence, type)."""
    return events.groupBy("run_id").transformWithStateInPandas(EnvelopeCheck(), "run_id string, sequence long, fault string", "append", "none")


def envelope_check(events: DataFrame) -> DataFrame:
    """The same over a batch: by run, whether numbers are gapless from 0 and one terminal event comes last."""
    end = F.col("type").isin("completed", "cancelled", "failed")
    found = events.groupBy("run_id").agg(
        F.count("*").alias("n"), F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.count_distinct("sequence").alias("distinct"),
        F.count_if(end).alias("ends"), F.max(F.when(end, F.col("sequence"))).alias("end"),
    )
    gapless = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("distinct") == F.col("n"))
    return found.select("run_id", gapless.alias("gapless"), ((F.col("ends") == 1) & (F.col("end") == F.col("high"))).alias("ended"))


def watch(changes: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run ``build(batch, epoch)`` for each batch of changes; the checkpoint lets one writer go on where it stopped.

    ``build`` is to be idempotent on the manifest, as publishing is, since a batch may be replayed.
    """
    writer = changes.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
