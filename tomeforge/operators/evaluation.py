"""Evaluation of retrieval: provenance, leaks, modes, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def provenance_violations(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits whose file is missing, changed, or shorter than their lines, with the reason."""
    known = files.select("path", F.col("content_hash").alias("now"), "n_lines")
    reason = (
        F.when(F.col("now").isNull(), "missing")
        .when(F.col("content_hash") != F.col("now"), "changed")
        .when((F.col("line_start") < 1) | (F.col("line_end") > F.col("n_lines")) | (F.col("line_start") > F.col("line_end")), "lines")
    )
    return hits.join(known, "path", "left").withColumn("reason", reason).where("reason is not null").drop("now", "n_lines")


def leaks(rows: DataFrame, text: str, markers: list[str]) -> DataFrame:
    """Rows whose text holds a marker that must never be served."""
    return rows.where(reduce(lambda a, b: a | b, [F.contains(F.col(text), F.lit(m)) for m in markers]))


def effective_mode(modes: Column) -> Column:
    """The strongest mode that ran, of a map of mode to count."""
    ran = lambda m: F.coalesce(F.try_element_at(modes, F.lit(m)), F.lit(0)) > 0
    return F.when(ran("hybrid"), "hybrid").when(ran("lexical"), "lexical").when(ran("vectors-only"), "vectors-only")


def degraded(requested: Column, ran: Column) -> Column:
    return F.when(requested != ran, F.concat(F.lit("ran "), ran, F.lit(" instead of "), requested))


def gates(metrics: DataFrame) -> DataFrame:
    """(gate, status) from one row of metrics; what was not measured is never passed."""
    c = F.col
    ok = lambda test: F.when(F.coalesce(test, F.lit(False)), "measured-passed").otherwise("measured-failed")
    rows = {
        "exact-lookup": ok((c("exact_total") > 0) & (c("exact_passed") == c("exact_total")) & (c("violations") == 0)),
        "policy": F.when(c("isolation").isNull(), "unmeasured").otherwise(ok(c("leaks") + c("isolation") == 0)),
        "recall": ok((c("eligible") > 0) & (c("found") / c("eligible") >= 0.85)),
        "warm-search": ok(c("warm_p95_ms") <= 500),
        "token-reduction": F.lit("unmeasured"),
        "code-vectors": F.lit("unmeasured"),
        "hybrid-latency": F.lit("unmeasured"),
    }
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), v.alias("status")) for k, v in rows.items()])).alias("g")).select("g.*")
