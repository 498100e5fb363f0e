"""Grades of trials: deterministic checks, manual records, and what is censored; report assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import experiments as ex

# Evaluation methods that a person or a model fills in.
MANUAL = ("humanRubric", "modelJudge")


def manual_valid(status: Column, method: Column, wanted: Column, reason: Column) -> Column:
    """A manual record counts with the task's method, a pass or fail, and a reason."""
    return F.coalesce(status.isin("pass", "fail") & (method == wanted) & (F.trim(reason) != ""), F.lit(False))


def graded(trials: DataFrame) -> DataFrame:
    """``trials`` with ``grade`` and ``grade_method``.

    Reads task_method (null: no evaluator), status, checks_passed (null: not computable), and
    the record found: record_source, record_status, record_method, record_reason,
    record_unreadable. Only completed trials are graded. A valid operator record stands, an
    invalid or unreadable one is an evaluator error, which stays until a valid one replaces it.
    """
    c = F.col
    by_hand = c("task_method").isin(*MANUAL)
    valid = manual_valid(c("record_status"), c("record_method"), c("task_method"), c("record_reason"))
    theirs = c("record_status").isNotNull() & ~c("record_source").eqNullSafe(F.lit("engine"))
    sticky = (c("record_status") == "evaluator_error") & (c("record_method") == c("task_method"))
    manual = (
        F.when(F.coalesce("record_unreadable", F.lit(False)), "evaluator_error")
        .when(theirs & valid, c("record_status"))
        .when(theirs, "evaluator_error")
        .when(F.coalesce(sticky, F.lit(False)), "evaluator_error")
        .otherwise("not_graded")
    )
    checked = F.when(c("checks_passed").isNull(), "evaluator_error").when(c("checks_passed"), "pass").otherwise("fail")
    grade = (
        F.when(c("task_method").isNull() | (c("status") != "completed"), "not_graded").when(by_hand, manual).otherwise(checked)
    )
    return trials.withColumns({"grade": grade, "grade_method": F.coalesce("task_method", F.lit("none"))})


def report(trials: DataFrame, plan: DataFrame, baseline: str, candidates: list[str], min_correctness: float, threshold: float, seed: int = 0, iterations: int = 1000) -> dict:
    """The report of a suite: counts, grades, paired comparisons with intervals, and the verdict.

    ``trials`` (trial, task, condition, status, reason, agent_ms, grade) and ``plan`` (trial,
    condition) are a suite's; what is collected has a row per condition or comparison.
    """
    rows = lambda df: [r.asDict() for r in df.collect()]
    pairs = None
    for candidate in candidates:
        one = ex.paired(trials, baseline, candidate, "agent_ms").withColumn("comparison", F.lit(candidate))
        pairs = one if pairs is None else pairs.unionByName(one)
    medians = pairs.groupBy("comparison").agg(F.count("*").alias("tasks"), F.median("difference").alias("difference"), F.median("reduction").alias("reduction"))
    intervals = ex.bootstrap(pairs, seed, iterations)
    rates = trials.groupBy("condition").agg(F.count_if(F.col("grade") == "pass").alias("passed"), F.count_if(F.col("grade").isin("pass", "fail")).alias("graded"))
    rate = F.col("passed") / F.col("graded")
    correct = rates.select(F.concat(F.lit("correctness:"), "condition").alias("check"), F.when(F.col("graded") == 0, "insufficient_data").when(rate >= min_correctness, "passed").otherwise("failed").alias("check_status"))
    better = medians.select(F.concat(F.lit("improvement:"), "comparison").alias("check"), F.when(F.col("reduction").isNull(), "insufficient_data").when(F.col("reduction") >= threshold, "passed").otherwise("failed").alias("check_status"))
    checks = rows(correct.unionByName(better).orderBy("check"))
    states = {c["check_status"] for c in checks}
    return {
        "counts": rows(ex.status_counts(plan, trials.drop("condition"), ["trial"]).orderBy("condition")),
        "grades": rows(ex.grade_summary(trials)),
        "conditions": rows(ex.described(trials).orderBy("condition")),
        "comparisons": rows(medians.join(intervals, "comparison").orderBy("comparison")),
        "checks": checks,
        "gate": "insufficient_data" if "insufficient_data" in states else "fail" if "failed" in states else "pass",
    }


def markdown(found: dict) -> str:
    """A report as text."""
    out = [f"# Verdict: {found['gate']}"]
    for part in ("counts", "conditions", "comparisons", "checks"):
        if found[part]:
            names = list(found[part][0])
            shown = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
            lines = ["| " + " | ".join(shown(r[n]) for n in names) + " |" for r in found[part]]
            out += ["", f"## {part}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *lines]
    return "\n".join(out) + "\n"
