"""Cache and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import caches, enrichment, evaluation
from ..session import table

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return keep


@register("SELECT d.doc_id, e.vec_id IS NOT NULL AND d.doc_id % 13 <> 0 AS hit FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id")
def cache_lookup(spark, sf_dir):
    """Embeddings as a cache by document; every thirteenth entry is broken and counts as a miss."""
    key = lambda c: caches.cache_key(F.col(c).cast("string"), F.lit("f"))
    requests = table(spark, sf_dir, "documents").select("doc_id", key("doc_id").alias("cache_key"))
    vector = F.when(F.col("vec_id") % 13 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    cache = table(spark, sf_dir, "embeddings").select(key("vec_id").alias("cache_key"), vector.alias("vector"))
    return caches.looked_up(requests, cache, 64).select("doc_id", F.col("vector").isNotNull().alias("hit"))


@register("SELECT user_id, max_by(event_id, epoch_us(ts)) AS event_id FROM events GROUP BY 1")
def cache_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return caches.upserted(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "user_id", "ts").select("user_id", "event_id")


@register("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 UNION SELECT p_partkey FROM part WHERE p_size < 3")
def family_references(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("k"))
    b = table(spark, sf_dir, "part").where("p_size < 3").select(F.col("p_partkey").alias("k"))
    return caches.referenced([a, b], ["k"])


@register("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'lines' END AS reason FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0 OR doc_id % 5 = 0""")
def provenance_violations(spark, sf_dir):
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    lines = F.size(F.split("text", "\n"))
    files = docs.where(n % 11 != 0).select(n.alias("path"), F.sha2("text", 256).alias("content_hash"), lines.alias("n_lines"))
    served = F.when(n % 7 == 0, "old").otherwise(F.sha2("text", 256))
    hits = docs.select("doc_id", n.alias("path"), served.alias("content_hash"), F.lit(1).alias("line_start"), F.when(n % 5 == 0, lines + 1).otherwise(lines).alias("line_end"))
    return evaluation.provenance_violations(hits, files).select("doc_id", "reason")


@register("SELECT doc_id FROM documents WHERE contains(text, 'AKIA') OR contains(text, 'token = ')")
def leak_scan(spark, sf_dir):
    return evaluation.leaks(table(spark, sf_dir, "documents"), "text", ["AKIA", "token = "]).select("doc_id")


@register("SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 30) THEN 'hybrid' WHEN bool_or(event_type = 'view') THEN 'lexical' ELSE 'vectors-only' END AS mode FROM events GROUP BY 1")
def effective_mode(spark, sf_dir):
    name = F.when((F.col("event_type") == "error") & (F.col("value") > 30), "hybrid").when(F.col("event_type") == "view", "lexical").otherwise("vectors-only")
    rows = table(spark, sf_dir, "events").groupBy("user_id", name.alias("m")).agg(F.count("*").alias("n"))
    modes = rows.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("modes"))
    return modes.select("user_id", evaluation.effective_mode(F.col("modes")).alias("mode"))


@register("""WITH m AS (SELECT count(*) FILTER (quality = 1) AS p, count(*) AS n FROM labels)
SELECT unnest(['exact-lookup', 'policy', 'recall', 'warm-search', 'token-reduction', 'code-vectors', 'hybrid-latency']) AS gate,
unnest([CASE WHEN p = n THEN 'measured-passed' ELSE 'measured-failed' END, 'unmeasured', CASE WHEN p / n >= 0.85 THEN 'measured-passed' ELSE 'measured-failed' END, 'measured-passed', 'unmeasured', 'unmeasured', 'unmeasured']) AS status FROM m""")
def evaluation_gates(spark, sf_dir):
    good = F.count_if(F.col("quality") == 1)
    metrics = table(spark, sf_dir, "labels").agg(
        F.count("*").alias("exact_total"), good.alias("exact_passed"), F.lit(0).alias("violations"), F.lit(None).cast("int").alias("isolation"),
        F.lit(0).alias("leaks"), F.count("*").alias("eligible"), good.alias("found"), F.lit(7.0).alias("warm_p95_ms"),
    )
    return evaluation.gates(metrics)


@register("SELECT doc_id, 'title: ' || source || ' | text: ' || text AS input, 'emb-v1|p|m|dim=64|input=titled' AS fingerprint FROM documents")
def embedding_inputs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    made = caches.templated("titled", "docs", F.col("source"), F.col("text"))
    return rows.select("doc_id", made.alias("input"), F.lit(caches.fingerprint("1", "p", "m", 64, "titled")).alias("fingerprint"))


@register("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS items, CAST(floor(value / 100) AS INTEGER) + 1 AS r,
  CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'verified' WHEN 'click' THEN 'no_association' WHEN 'error' THEN CASE WHEN value > 200 THEN 'permission_denied' WHEN value > 100 THEN 'rate_limited' ELSE 'failed' END END AS o FROM events),
f AS (SELECT user_id, 0 AS k, 40 AS rest, 0 AS attempted, 0 AS enriched, 0 AS no_association, 0 AS failed, '' AS ended FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL SELECT f.user_id, e.k, CASE WHEN f.rest = 0 OR e.r > f.rest THEN 0 ELSE f.rest - e.r END, attempted + CASE WHEN f.rest = 0 THEN 0 ELSE 1 END,
    enriched + CASE WHEN f.rest > 0 AND e.r <= f.rest AND o = 'verified' THEN 1 ELSE 0 END, no_association + CASE WHEN f.rest > 0 AND e.r <= f.rest AND o = 'no_association' THEN 1 ELSE 0 END,
    failed + CASE WHEN f.rest > 0 AND e.r <= f.rest AND coalesce(o, 'failed') = 'failed' THEN 1 ELSE 0 END,
    CASE WHEN f.rest = 0 OR e.r > f.rest THEN 'budget_exhausted' WHEN o IN ('rate_limited', 'permission_denied') THEN o ELSE '' END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1 WHERE ended = '' AND e.k <= 20),
z AS (SELECT user_id, max(attempted) AS attempted, max(enriched) AS enriched, max(no_association) AS no_association, max(failed) AS failed, max(ended) AS ended FROM f GROUP BY 1)
SELECT user_id, CAST(items AS INTEGER) AS items, attempted, enriched, no_association, failed, ended = 'rate_limited' AS rate_limited, ended = 'permission_denied' AS permission_denied, ended = 'budget_exhausted' AS budget_exhausted,
  CAST(items - attempted AS INTEGER) AS unattempted FROM z JOIN (SELECT user_id, count(*) AS items FROM events GROUP BY 1) USING (user_id)""")
def enrichment_report(spark, sf_dir):
    """By user, events as answers of a host: 20 items and 40 requests at most."""
    kind, value = F.col("event_type"), F.col("value")
    error = F.when(value > 200, "permission_denied").when(value > 100, "rate_limited").otherwise("failed")
    outcome = F.when(kind.isin("purchase", "signup"), "verified").when(kind == "click", "no_association").when(kind == "error", error)
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", outcome.alias("outcome"), (F.floor(value / 100).cast("int") + 1).alias("requests"))
    return enrichment.report(rows, "user_id", "event_id", "outcome", "requests", 20, 40)
