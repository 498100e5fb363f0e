"""Analysis of recorded trials: counts, grades, paired comparison, evidence, claims, gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.random import mixed, shuffled, splitmix64


def timed_out(status: str = "status", reason: str = "reason") -> Column:
    return (F.col(status) == "error") & F.coalesce(F.contains(F.col(reason), F.lit("timeout")), F.lit(False))


def measurable() -> Column:
    """Trials whose figures count: completed, or timed out (censored)."""
    return (F.col("status") == "completed") | timed_out()


def status_counts(plan: DataFrame, trials: DataFrame, keys: list[str]) -> DataFrame:
    """By condition, over the plan: slots without a trial count as not started; timeouts are no errors."""
    status = F.coalesce("status", F.lit("not_started"))
    return plan.join(trials, keys, "left").groupBy("condition").agg(
        F.count("*").alias("planned"),
        F.count_if(status == "completed").alias("completed"),
        F.count_if(timed_out()).alias("timed_out"),
        F.count_if((status == "error") & ~timed_out()).alias("errors"),
        F.count_if(status == "not_started").alias("not_started"),
    )


def grade_summary(graded: DataFrame) -> DataFrame:
    """Passes and failures overall, by condition and by task, in one aggregate; null stands for all."""
    counts = [F.count_if(F.col("grade") == g).alias(c) for g, c in (("pass", "passed"), ("fail", "failed"), ("not_graded", "not_graded"))]
    condition, task = F.col("condition"), F.col("task")
    return graded.groupingSets([[], [condition], [task]], condition, task).agg(*counts)


def described(trials: DataFrame) -> DataFrame:
    """By condition: attempts, rates, means and exact medians of measurable trials; the success-only median is biased."""
    ms, done = F.when(measurable(), F.col("agent_ms")), F.when(F.col("status") == "completed", F.col("agent_ms"))
    attempts = F.count_if(F.col("status") != "not_started")
    return trials.groupBy("condition").agg(
        attempts.alias("attempts"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(timed_out()).alias("timed_out"),
        F.avg(ms).alias("mean_ms"), F.median(ms).alias("median_ms"), F.median(done).alias("success_only_median_ms"),
    )


def paired(trials: DataFrame, baseline: str, candidate: str, metric: str) -> DataFrame:
    """By task with both conditions measured: means, candidate - baseline, and the reduction (null at a zero baseline)."""
    value = lambda c: F.avg(F.when(F.col("condition") == c, F.col(metric)))
    tasks = trials.where(measurable() & F.col("condition").isin(baseline, candidate)).groupBy("task").agg(value(baseline).alias("base"), value(candidate).alias("cand"))
    tasks = tasks.where("base is not null and cand is not null").withColumn("difference", F.col("cand") - F.col("base"))
    return tasks.withColumn("reduction", F.when(F.col("base") != 0, (F.col("base") - F.col("cand")) / F.col("base")))


def bootstrap(pairs: DataFrame, seed: int, iterations: int) -> DataFrame:
    """(comparison, low, high): 2.5 and 97.5 percentiles of medians of resampled tasks; null under two tasks.

    ``pairs`` (comparison, task, difference) has a row per task of a suite, so a comparison
    fits one task; comparisons run side by side.
    """

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        diffs, state, medians = rows.sort_values("task")["difference"].to_numpy(), splitmix64(seed), []
        if len(diffs) < 2:
            return pd.DataFrame({"comparison": rows["comparison"].iloc[:1], "low": [None], "high": [None]}).astype({"low": "float64", "high": "float64"})
        for _ in range(iterations):
            picks = []
            for _ in diffs:
                state = splitmix64(state)
                picks.append(state % len(diffs))
            medians.append(float(np.median(diffs[picks])))
        medians.sort()
        at = lambda p: medians[int(p / 100 * (len(medians) - 1))]
        return pd.DataFrame({"comparison": rows["comparison"].iloc[:1].to_list(), "low": [at(2.5)], "high": [at(97.5)]})

    return pairs.select("comparison", "task", "difference").groupBy("comparison").applyInPandas(draw, "comparison string, low double, high double")


def schedule(spark: SparkSession, tasks: list[str], conditions: list[str], repeat: int, seed: int) -> DataFrame:
    """The frozen order of trials: blocks of task and repetition, conditions shuffled within each."""
    rows = []
    for t, task in enumerate(tasks):
        for r in range(repeat):
            for c in shuffled(len(conditions), mixed(seed, t, r)):
                rows.append((len(rows), task, r, conditions[c]))
    return spark.createDataFrame(rows, "ordered_index long, task string, repetition int, condition string")


def claim_verdict(kind: Column) -> Column:
    """Of one audited trial: supported, refuted, not_proven or unknown; missing evidence is unknown.

    Reads columns audit_status, succeeded, failed, degraded, hybrid, modes, clean, malformed, agent_ran.
    """
    c = F.col
    whole = (c("hybrid") > 0) & (c("hybrid") == c("succeeded"))
    hybrid = (
        F.when((c("degraded") > 0) | (c("modes") > c("hybrid")), "refuted")
        .when(whole & c("clean") & (c("malformed") == 0), "supported")
        .when(whole, "unknown")
        .otherwise("not_proven")
    )
    used = F.when(c("succeeded") + c("failed") > 0, "supported").otherwise("unknown")
    wants_hybrid = kind == "hybrid-executed"
    none = F.when(~c("agent_ran"), "unknown").when(wants_hybrid, "not_proven").otherwise("refuted")
    seen = F.when(wants_hybrid, hybrid).otherwise(used)
    return F.when(c("audit_status") == "observed", seen).when(c("audit_status") == "not_observed", none).otherwise("unknown")


def gate(checks: DataFrame, by: list[str]) -> DataFrame:
    """Any check without data makes it insufficient, else any failure fails it, else it passes."""
    has = lambda s: F.bool_or(F.col("check_status") == s)
    return checks.groupBy(*by).agg(F.when(has("insufficient_data"), "insufficient_data").when(has("failed"), "fail").otherwise("pass").alias("gate"))


def contains_any(text: Column, values: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, values)), lambda v: F.contains(text, v)), F.lit(False))


def contains_all(text: Column, values: list[str]) -> Column:
    return F.coalesce(F.forall(F.array(*map(F.lit, values)), lambda v: F.contains(text, v)), F.lit(False))


def contains_none(text: Column, values: list[str]) -> Column:
    """False for a null text as well."""
    return F.coalesce(F.forall(F.array(*map(F.lit, values)), lambda v: ~F.contains(text, v)), F.lit(False))


def ledger(usage: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Usage of each run and mode: cumulative reports count by their maximum, deltas by their sum; missing stays null."""
    value = lambda f: F.when(F.max("mode") == "cumulative", F.max(f)).otherwise(F.sum(f)).alias(f)
    return usage.groupBy(*keys).agg(*[value(f) for f in fields])


def audit_fold(lines: DataFrame, run: str, schema: str, raw: str = "line") -> DataFrame:
    """By run: tool calls, searches that went well, failed or fell back, modes, malformed lines."""
    parsed = lines.select(run, F.from_json(raw, schema, {"mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r.kind").isNull()
    search = F.coalesce((F.col("r.kind") == "tool_call") & (F.col("r.tool") == "search"), F.lit(False))
    return parsed.groupBy(run).agg(
        F.count_if(F.coalesce(F.col("r.kind") == "tool_call", F.lit(False))).alias("calls"),
        F.count_if(search & F.col("r.success")).alias("succeeded"),
        F.count_if(search & ~F.col("r.success")).alias("failed"),
        F.count_if(search & F.coalesce("r.degraded", F.lit(False))).alias("degraded"),
        F.count_if(bad).alias("malformed"),
    )


def overlaps(gold: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Pairs of gold ranges and hit ranges of one key that share a line."""
    return gold.join(hits, key).where("hit_start <= gold_end and hit_end >= gold_start")


def recall_at(ranked: DataFrame, gold: DataFrame, keys: list[str], k: int) -> DataFrame:
    """By query: whether any of its first k hits is gold."""
    hit = ranked.where(F.col("rank") <= k).join(gold, keys, "left_semi").select("query").distinct().withColumn("hit", F.lit(True))
    return gold.select("query").distinct().join(hit, "query", "left").select("query", F.coalesce("hit", F.lit(False)).alias("hit"))


def missing_runs(tasks: DataFrame, conditions: DataFrame, runs: DataFrame) -> DataFrame:
    """Cells of the task x condition matrix without a run; both dimensions are a suite's declared lists."""
    return tasks.crossJoin(conditions).join(runs, ["task", "condition"], "left_anti")


def sequence_gaps(events: DataFrame, run: str, sequence: str) -> DataFrame:
    """Events whose number is not one above the one before."""
    from pyspark.sql import Window as W

    before = F.lag(sequence).over(W.partitionBy(run).orderBy(sequence))
    return events.withColumn("before", before).where(F.col("before").isNotNull() & (F.col(sequence) != F.col("before") + 1))


def batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Frames cut to at most ``size`` rows, as a provider takes them."""
    for frame in frames:
        for at in range(0, len(frame), size):
            yield frame.iloc[at : at + size]
