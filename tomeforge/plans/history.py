"""History and structure queries: commit search, line offsets, chunk windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import running, with_value
from ..operators import chunking, lexical, throttle
from ..session import table
from ..sources import corpus
from .search import sql_tokens

QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


TERMS = ["the", "of"]


@register(f"""WITH tok AS (SELECT conv_id * 100 + turn AS item_id, {sql_tokens('text')} AS b, {sql_tokens('role')} AS r FROM conversations),
stats AS (SELECT count(*) AS n, avg(len(b) + len(r)) AS mean_length FROM tok),
post AS (SELECT item_id, term, length, count(*) AS tf FROM (SELECT item_id, unnest(b) AS term, len(b) + len(r) AS length FROM tok) WHERE term IN ('the', 'of') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
g AS (SELECT item_id, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) AS gain FROM post JOIN df USING (term), stats)
SELECT item_id, round(-sum(gain), 6) AS score FROM g GROUP BY 1 HAVING count(*) = 2 ORDER BY round(-sum(gain), 9), item_id LIMIT 25""")
def history_search(spark, sf_dir):
    """Plain BM25 over messages, roles counted for the length; no boosts."""
    items = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("item_id"), F.col("text").alias("message"), "role")
    found = lexical.postings(items, ("message",), ("role",), "item_id").where(F.col("term").isin(TERMS))
    scored = lexical.bm25(found, lexical.corpus_stats(items, ("message",), ("role",)), TERMS, "item_id")
    return lexical.top(scored, 25, F.round("score", 9), "item_id").select("item_id", F.round("score", 6).alias("score"))


@register("""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS line, octet_length(encode(unnest(x))) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY line) - n - 1 AS BIGINT) AS byte_start, CAST(sum(n + 1) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS BIGINT) AS byte_end FROM l""")
def line_byte_ranges(spark, sf_dir):
    """Running sums in the row: a file's lines are in one array, so nothing is shuffled."""
    sizes = F.transform(F.split("text", "\n", -1), F.octet_length)
    ranges = with_value(sizes, lambda n: with_value(running(F.transform(n, lambda x: x + 1)), lambda ends: F.arrays_zip(n.alias("n"), ends.alias("e"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(ranges.cast("array<struct<n:bigint,e:bigint>>")).alias("k", "z"))
    return rows.select("doc_id", (F.col("k") + 1).alias("line"), (F.col("z.e") - F.col("z.n") - 1).alias("byte_start"), (F.col("z.e") - 1).alias("byte_end"))


@register("SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '…' ELSE text END AS excerpt FROM documents")
def bounded_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.bounded(F.col("text")).alias("excerpt"))


@register("WITH e AS (SELECT user_id, event_id, ts, first_value(ts) OVER (PARTITION BY user_id ORDER BY ts) AS t0, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS done FROM events) SELECT event_id, CAST(done AS INTEGER) AS done, CAST(epoch_us(ts) - epoch_us(t0) AS BIGINT) AS elapsed FROM e")
def eta_baseline(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts")
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.row_number().over(w).alias("done"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.first("ts").over(w).cast("timestamp"))).alias("elapsed"))


@register("""WITH RECURSIVE passed AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1
  UNION ALL SELECT p.user_id, min(e.ts) FROM passed p JOIN events e ON e.user_id = p.user_id AND e.ts >= p.ts + INTERVAL 12 HOUR GROUP BY p.user_id, p.ts),
first AS (SELECT min(event_id) AS event_id FROM events JOIN passed USING (user_id, ts) GROUP BY user_id, ts),
last AS (SELECT max_by(event_id, {'ts': ts, 'id': event_id}) AS event_id FROM events GROUP BY user_id)
SELECT event_id FROM first UNION SELECT event_id FROM last""")
def progress_throttle(spark, sf_dir):
    """Each user's first event, those 12 hours or more after the last one let through, and the last."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return throttle.throttled(events, "user_id", "at", 12 * 3_600_000_000, "event_id").select("event_id")


@register("SELECT doc_id, sha256(text) = sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' ' ELSE text END) AS valid FROM documents")
def read_validate(spark, sf_dir):
    served = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", (F.sha2("text", 256) == F.sha2(served, 256)).alias("valid"))


@register()
def line_windows(spark, sf_dir):
    """Chunks of whole documents by the structural chunkers."""
    files = corpus.files(spark, sf_dir).select("path", F.lit("text").alias("language"), F.lit("current-doc").alias("role"), "text")
    return chunking.chunked(files).select("path", "address", "parent", "line_start", "line_end")
