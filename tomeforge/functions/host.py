"""What a code host answers: status classes, next pages, verified requests, usage fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status_class(code: Column, remaining: Column, retry_after: Column) -> Column:
    """ok, rate-limited, permission-denied or other; a 403 is a limit only if a header says so."""
    limited = (code == 429) | ((code == 403) & (F.coalesce(remaining == "0", F.lit(False)) | retry_after.isNotNull()))
    return F.when(code.between(200, 299) | (code == 304), "ok").when(limited, "rate-limited").when(code.isin(401, 403), "permission-denied").otherwise("other")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^([^:/]+://[^/]*)", 1)


def next_page(link: Column, base: Column) -> Column:
    """The address of rel="next" in a Link header, if it has the origin of ``base``; null otherwise."""
    parts = F.filter(F.split(link, ","), lambda p: p.rlike(r';\s*rel="next"\s*(?:;|$)'))
    found = F.regexp_extract(F.get(parts, 0), r"^\s*<?([^>;]*)>?\s*;", 1)
    return F.when((found != "") & (origin(found) == origin(base)), found)


def verified(hints: Column, numbers: Column) -> Column:
    """The first hinted number that the host lists for the commit."""
    return F.get(F.array_intersect(hints, numbers), 0)


def usage(record: Column) -> Column:
    """The six usage fields of an adapter's JSON record, under either of their names; what is missing stays null."""
    value = lambda *names: F.coalesce(*[F.get_json_object(record, f"$.{n}").cast("double") for n in names])
    return F.struct(
        value("tokensIn", "inputTokens").alias("input"), value("tokensOut", "outputTokens").alias("output"), value("reasoningTokens").alias("reasoning"),
        value("cacheReads", "cacheReadTokens").alias("cache_read"), value("cacheWrites", "cacheWriteTokens").alias("cache_write"), value("costUsd", "cost").alias("cost"),
    )
