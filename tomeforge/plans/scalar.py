"""Scalar and in-row queries: host answers, usage fields, durations, greedy parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import host, text
from ..operators import packing
from ..session import table

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@register("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'ok' WHEN 1 THEN 'rate-limited' WHEN 2 THEN CASE WHEN event_id % 2 = 0 THEN 'rate-limited' ELSE 'permission-denied' END WHEN 3 THEN 'permission-denied' WHEN 4 THEN 'other' WHEN 5 THEN 'ok' ELSE 'other' END AS class FROM events""")
def host_status(spark, sf_dir):
    n = F.col("event_id")
    code = F.element_at(F.array(*[F.lit(c) for c in (200, 429, 403, 401, 404, 304, 500)]), (n % 7 + 1).cast("int"))
    remaining, retry = F.when(n % 4 == 0, "0").otherwise("9"), F.when(n % 2 == 0, "30")
    return table(spark, sf_dir, "events").select("event_id", host.status_class(code, remaining, retry).alias("class"))


@register("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://h.io/x?page=' || page_id END AS next FROM pages")
def link_next(spark, sf_dir):
    n = F.col("page_id").cast("string")
    same = F.concat(F.lit('<https://h.io/a>; rel="prev", <https://h.io/x?page='), n, F.lit('>; rel="next"'))
    other = F.concat(F.lit("<https://evil.io/x?page="), n, F.lit('>; rel="next"'))
    header = F.when(F.col("page_id") % 3 == 0, same).when(F.col("page_id") % 3 == 1, other).otherwise('<https://h.io/z>; rel="last"')
    return table(spark, sf_dir, "pages").select("page_id", host.next_page(header, F.lit("https://h.io/base")).alias("next"))


@register("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS input, CASE WHEN event_id % 3 = 0 THEN value + 1 END AS cost FROM events")
def usage_fields(spark, sf_dir):
    n, v = F.col("event_id"), F.col("value")
    record = F.to_json(F.struct(F.when(n % 4 == 0, v).alias("tokensIn"), F.when(n % 4 == 2, v).alias("inputTokens"), F.when(n % 3 == 0, v + 1).alias("cost")))
    return table(spark, sf_dir, "events").select("event_id", host.usage(record).alias("u")).select("event_id", "u.input", "u.cost")


@register("SELECT event_id, CASE WHEN event_id * 37 < 60000 THEN printf('%.1fs', CAST(event_id * 37 AS DOUBLE) / 1000) ELSE printf('%dm %02ds', event_id * 37 // 60000, event_id * 37 % 60000 // 1000) END AS shown FROM events")
def durations(spark, sf_dir):
    ms = F.col("event_id") * 37
    return table(spark, sf_dir, "events").select("event_id", text.duration(ms).alias("shown"))


@register("""WITH RECURSIVE s AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CAST(ceil(length(x) / 4) AS BIGINT)) AS n FROM documents),
f AS (SELECT doc_id, n, 1 AS i, n[1] AS total, 0 AS part FROM s UNION ALL
  SELECT doc_id, n, i + 1, CASE WHEN total + n[i + 1] > 200 THEN n[i + 1] ELSE total + n[i + 1] END, part + CASE WHEN total + n[i + 1] > 200 THEN 1 ELSE 0 END FROM f WHERE i < len(n))
SELECT doc_id, CAST(max(part) + 1 AS INTEGER) AS parts FROM f GROUP BY 1""")
def greedy_parts(spark, sf_dir):
    sizes = F.transform(F.split("text", "\n", -1), lambda x: F.ceil(F.length(x) / 4).cast("long"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.array_max(packing.greedy_parts(sizes, 200)) + 1).alias("parts"))


@register("SELECT user_id, verified FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 7 WHEN user_id % 3 = 1 THEN 9 END AS verified FROM (SELECT DISTINCT user_id FROM events))")
def verified_request(spark, sf_dir):
    n = F.col("user_id")
    listed = F.when(n % 3 == 0, F.array(F.lit(9), F.lit(7))).when(n % 3 == 1, F.array(F.lit(9), F.lit(1))).otherwise(F.array(F.lit(2)))
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", host.verified(F.array(F.lit(7), F.lit(9)), listed).alias("verified"))
