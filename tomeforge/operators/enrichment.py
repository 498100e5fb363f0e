"""What came of asking a host about items in order, where an answer can end the asking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STOPS = ("rate_limited", "permission_denied", "budget_exhausted")
COUNTS = {"verified": "enriched", "no_association": "no_association"}


def report(answers: DataFrame, scope: str, order: str, outcome: str, requests: str, most_items: int, most_requests: int) -> DataFrame:
    """By scope: attempted, enriched, no_association, failed and unattempted items, and which of ``STOPS`` ended it.

    ``answers`` has for each item what its host would say and how many requests that takes. Items are asked
    about in order of ``order`` until ``most_items`` were, or until the requests are used up: an item that
    needs more than are left uses them and ends it. A rate limit and a denial end it as well; any other outcome
    than those of ``COUNTS`` is a failure and does not, and so is a null one; null requests are none.

    Only the first ``most_items`` of a scope can be asked about. Spark keeps that many of each task before it
    shuffles, so a scope of any size sends a bounded list, and the flag that stops is carried by a fold over it.
    """
    total = answers.groupBy(scope).agg(F.count("*").cast("int").alias("items"))
    rank = F.row_number().over(W.partitionBy(scope).orderBy(order))
    first = answers.select(scope, order, F.col(outcome).alias("o"), F.coalesce(F.col(requests).cast("int"), F.lit(0)).alias("r"))
    first = first.withColumn("k", rank).where(F.col("k") <= most_items)
    lists = first.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("k", "o", "r"))).alias("list"))

    flags = {s: F.lit(False) for s in STOPS}
    figures = {c: F.lit(0) for c in ("attempted", "enriched", "no_association", "failed")}
    zero = F.struct(F.lit(most_requests).alias("left"), *[v.alias(c) for c, v in {**figures, **flags}.items()])

    def ask(a: Column, x: Column) -> Column:
        over = a["rate_limited"] | a["permission_denied"] | a["budget_exhausted"]
        short = x["r"] > a["left"]
        said = F.when(short, "budget_exhausted").otherwise(F.coalesce(x["o"], F.lit("")))
        figures = {"attempted": a["attempted"] + 1} | {c: a[c] + (said == o).cast("int") for o, c in COUNTS.items()}
        figures["failed"] = a["failed"] + (~said.isin(*STOPS, *COUNTS)).cast("int")
        asked = F.struct(F.when(short, 0).otherwise(a["left"] - x["r"]).alias("left"), *[v.alias(c) for c, v in figures.items()], *[(said == s).alias(s) for s in STOPS])
        # without requests the next item is not asked about
        dry = F.struct(a["left"].alias("left"), *[a[c].alias(c) for c in figures], *[(a[s] | F.lit(s == "budget_exhausted")).alias(s) for s in STOPS])
        return F.when(over, a).when(a["left"] == 0, dry).otherwise(asked)

    done = lists.select(scope, F.aggregate("list", zero, ask).alias("a")).join(total, scope)
    return done.select(scope, "items", *[f"a.{c}" for c in (*figures, *STOPS)], (F.col("items") - F.col("a.attempted")).alias("unattempted"))
