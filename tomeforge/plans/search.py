"""Search queries over the chunked documents: BM25, boosts, paging, vectors, fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import lexical, vectors
from ..session import table
from ..sources import corpus

QUERY = "licensed under the"
TERMS = lexical.terms_of(QUERY)
FIELDS = ("path", "body")
QUERIES: dict = {}
ORACLES: dict = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def sql_tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


IN_TERMS = "(" + ", ".join(f"'{t}'" for t in TERMS) + ")"
SQL = f"""WITH {corpus.SQL}, tok AS (
  SELECT chunk_id, path, line, {sql_tokens('path')} AS p, {sql_tokens('body')} AS b FROM chunks
), stats AS (SELECT count(*) AS n, avg(len(p) + len(b)) AS mean_length FROM tok
), post AS (
  SELECT chunk_id, field, term, length, count(*) AS tf FROM (
    SELECT chunk_id, 'path' AS field, unnest(p) AS term, len(p) + len(b) AS length FROM tok
    UNION ALL SELECT chunk_id, 'body', unnest(b), len(p) + len(b) FROM tok)
  WHERE term IN {IN_TERMS} GROUP BY ALL
), df AS (SELECT term, field, count(*) AS df FROM post GROUP BY ALL
), gains AS (
  SELECT chunk_id, term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) AS gain
  FROM post JOIN df USING (term, field), stats
), scored AS (
  SELECT chunk_id, -sum(gain) AS score FROM gains GROUP BY chunk_id HAVING count(DISTINCT term) = {len(TERMS)}
), hits AS (
  SELECT s.chunk_id, path, line, score FROM scored s JOIN chunks USING (chunk_id) ORDER BY round(score, 9), path, line LIMIT 400
), boosted AS (
  SELECT chunk_id, path, line, score + (CASE WHEN {' OR '.join(f"contains(lower(path), '{t}')" for t in TERMS)} THEN -10 ELSE 0 END) - 2 AS score FROM hits
)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus.chunks(spark, sf_dir)
    found = lexical.postings(chunks, FIELDS).where(F.col("term").isin(TERMS))
    return lexical.bm25(found, lexical.corpus_stats(chunks, FIELDS), TERMS)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidates, with path and line but without texts."""
    named = corpus.chunks(spark, sf_dir).select("chunk_id", "path", "line")
    found = scored(spark, sf_dir).join(named, "chunk_id")
    return lexical.top(found, lexical.CANDIDATES, F.round("score", 9), "path", "line")


def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = classify.inferred(F.col("path"))["role"]
    gain = lexical.path_boost(F.col("path"), TERMS) + lexical.role_boost(role, classify.is_fixture(F.col("path")), TERMS)
    return hits(spark, sf_dir).withColumn("score", F.col("score") + gain)


def order() -> list:
    return [F.round("score", 9), F.col("path"), F.col("line")]


def out(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "path", "line", F.round("score", 6).alias("score"))


@register(SQL + " SELECT chunk_id, path, line, round(score, 6) AS score FROM hits ORDER BY round(hits.score, 9), path, line LIMIT 10")
def bm25_topk(spark, sf_dir):
    return out(hits(spark, sf_dir).orderBy(*order()).limit(10))


@register(SQL + " SELECT chunk_id, path, line, round(score, 6) AS score FROM boosted")
def bm25_boosted(spark, sf_dir):
    return out(boosted(spark, sf_dir))


@register(SQL + " SELECT term, field, df FROM df")
def bm25_field_df(spark, sf_dir):
    found = lexical.postings(corpus.chunks(spark, sf_dir), FIELDS).where(F.col("term").isin(TERMS))
    return found.groupBy("term", "field").agg(F.count("*").alias("df"))


@register(SQL + " SELECT n, round(mean_length, 6) AS mean_length FROM stats")
def corpus_statistics(spark, sf_dir):
    stats = lexical.corpus_stats(corpus.chunks(spark, sf_dir), FIELDS)
    return stats.select("n", F.round("mean_length", 6).alias("mean_length"))


@register(SQL + " SELECT field, term, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS total FROM post GROUP BY ALL")
def term_totals(spark, sf_dir):
    found = lexical.postings(corpus.chunks(spark, sf_dir), FIELDS).where(F.col("term").isin(TERMS))
    return found.groupBy("field", "term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("total"))


@register(f"WITH {corpus.SQL} SELECT chunk_id FROM (SELECT chunk_id, {sql_tokens('path')} AS p, {sql_tokens('body')} AS b FROM chunks) WHERE list_contains(b, 'rights') AND (list_contains(p, 'en') OR list_contains(b, 'en'))")
def match_all_terms(spark, sf_dir):
    return lexical.matches_all(corpus.chunks(spark, sf_dir), [["rights"], ["en"]], FIELDS).select("chunk_id")


@register(f"WITH {corpus.SQL} SELECT chunk_id, line FROM chunks WHERE contains(' ' || array_to_string({sql_tokens('body')}, ' ') || ' ', ' general public license ')")
def phrase_match(spark, sf_dir):
    return lexical.matches_all(corpus.chunks(spark, sf_dir), [["general", "public", "license"]], ("body",)).select("chunk_id", "line")


@register(SQL + ", cap AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(score, 9), path, line) AS in_file FROM boosted) SELECT chunk_id, path, CAST(in_file AS INTEGER) AS in_file FROM cap WHERE in_file <= 1")
def per_file_cap(spark, sf_dir):
    return lexical.per_file(boosted(spark, sf_dir), order(), 1).select("chunk_id", "path", "in_file")


BUDGET = 120


@register(SQL + f""", ranked AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9), path, line) AS rank FROM boosted),
page AS (SELECT r.chunk_id, rank, CAST(ceil(length(body) / 4) AS BIGINT) AS cost FROM ranked r JOIN chunks USING (chunk_id) WHERE rank <= 20),
spent AS (SELECT *, sum(cost) OVER (ORDER BY rank) AS spent FROM page)
SELECT chunk_id, CAST(rank AS INTEGER) AS rank, CAST(spent AS BIGINT) AS spent FROM spent WHERE spent <= {BUDGET} OR rank = 1""")
def token_budget_page(spark, sf_dir):
    page = lexical.page(boosted(spark, sf_dir), order(), 0, 20).select("chunk_id", "rank")
    bodies = corpus.chunks(spark, sf_dir).select("chunk_id", "body")
    page = bodies.join(F.broadcast(page), "chunk_id")  # 20 rows at most
    return lexical.within_budget(page, text.estimated_tokens(F.col("body")), BUDGET).select("chunk_id", "rank", "spent")


@register(SQL + """, ranked AS (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9), path, line) AS rank FROM boosted)
SELECT chunk_id, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank > 5 AND rank <= 10""")
def second_page(spark, sf_dir):
    return lexical.page(boosted(spark, sf_dir), order(), 5, 5).select("chunk_id", "rank")


@register(f"""WITH {corpus.SQL}, hit AS (SELECT chunk_id, body, strpos(lower(body), 'license') AS pos FROM chunks WHERE contains(lower(body), 'license')),
excerpts AS (SELECT *, greatest(pos - 1 - 20, 0) AS a, least(pos - 1 + 7 + 20, length(body)) AS z FROM hit)
SELECT chunk_id, (CASE WHEN a > 0 THEN '…' ELSE '' END) || substring(body, a + 1, z - a) || (CASE WHEN z < length(body) THEN '…' ELSE '' END) AS excerpt FROM excerpts""")
def excerpt_window(spark, sf_dir):
    found = corpus.chunks(spark, sf_dir).where(F.contains(F.lower("body"), F.lit("license")))
    return found.select("chunk_id", text.excerpt(F.col("body"), ["license"], 20).alias("excerpt"))


@register(f"WITH {corpus.SQL} SELECT path FROM files WHERE contains(lower(path), 'src1/e') ORDER BY path LIMIT 5")
def fallback_paths(spark, sf_dir):
    return corpus.files(spark, sf_dir).where(F.contains(F.lower("path"), F.lit("src1/e"))).select("path").orderBy("path").limit(5)


@register(f"WITH {corpus.SQL} SELECT path FROM files WHERE path GLOB 'src[1-2]/?n/*1.txt'")
def path_glob_filter(spark, sf_dir):
    """The filter's dialect: * and ? cross separators, classes in brackets."""
    return corpus.files(spark, sf_dir).where(F.col("path").rlike(text.glob_regex("src[1-2]/?n/*1.txt"))).select("path")


# vectors

QV = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
COS = f"SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS cosine FROM embeddings, {QV}"


def cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.scored(rows, rows.where("vec_id = 0").limit(1), "embedding")


@register(f"SELECT vec_id, round(cosine, 6) AS cosine FROM ({COS}) ORDER BY cosine DESC, vec_id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return vectors.top(cosines(spark, sf_dir), 20).select("vec_id", F.round("cosine", 6).alias("cosine"))


@register(f"SELECT vec_id, round(cosine, 6) AS cosine FROM ({COS}) WHERE label = 3 ORDER BY cosine DESC, vec_id LIMIT 10")
def cosine_filtered(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    found = vectors.scored(rows.where("label = 3"), rows.where("vec_id = 0").limit(1), "embedding")
    return vectors.top(found, 10).select("vec_id", F.round("cosine", 6).alias("cosine"))


@register(f"SELECT label, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM ({COS})) WHERE rank <= 3")
def query_space_ranks(spark, sf_dir):
    return vectors.ranked(cosines(spark, sf_dir), 3, "label").select("label", "vec_id", "rank")


@register("SELECT count(*) AS total, count(*) FILTER (len(embedding) = 64) AS usable FROM embeddings")
def vector_validity(spark, sf_dir):
    good = vectors.valid(F.col("embedding"), 64)
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("total"), F.count_if(good).alias("usable"))


HYBRID = SQL + f""", lex AS (SELECT CAST(split_part(chunk_id, ':', 1) AS BIGINT) AS doc_id, min(rank) AS rank FROM (SELECT chunk_id, row_number() OVER (ORDER BY round(score, 9), path, line) AS rank FROM boosted) GROUP BY 1),
vec AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY cosine DESC, vec_id) AS rank FROM ({COS}) QUALIFY rank <= 200)"""


@register(HYBRID + " SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM vec) GROUP BY doc_id")
def rrf_hybrid(spark, sf_dir):
    """Documents by lexical rank and by vector rank, fused; vec_id stands for doc_id."""
    lex = boosted(spark, sf_dir).withColumn("rank", F.row_number().over(W.orderBy(*order())))
    lex = lex.groupBy(F.substring_index("chunk_id", ":", 1).cast("long").alias("doc_id")).agg(F.min("rank").alias("rank"))
    vec = vectors.ranked(cosines(spark, sf_dir), 200).select(F.col("vec_id").alias("doc_id"), "rank")
    return vectors.fused([lex, vec], "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@register(f"SELECT vec_id, round(max(cosine), 6) AS cosine FROM (SELECT * FROM ({COS}) WHERE label < 5 UNION ALL SELECT * FROM ({COS}) WHERE label >= 5) GROUP BY vec_id ORDER BY max(cosine) DESC, vec_id LIMIT 15")
def vectors_only(spark, sf_dir):
    found = cosines(spark, sf_dir)
    both = found.where("label < 5").unionByName(found.where("label >= 5"))
    best = both.groupBy("vec_id").agg(F.max("cosine").alias("cosine"))
    return vectors.top(best, 15).select("vec_id", F.round("cosine", 6).alias("cosine"))


PHRASES = [["all"], ["rights", "reserved"]]


@register(f"""WITH {corpus.SQL}, tok AS (SELECT chunk_id, {sql_tokens('path')} AS p, {sql_tokens('body')} AS b FROM chunks
), stats AS (SELECT count(*) AS n, avg(len(p) + len(b)) AS mean_length FROM tok
), post AS (
  SELECT chunk_id, field, phrase, length, CASE phrase WHEN 'all' THEN len(list_filter(t, lambda x: x = 'all'))
    ELSE len(list_filter(range(1, len(t)), lambda i: t[i] = 'rights' AND t[i + 1] = 'reserved')) END AS tf FROM (
    SELECT chunk_id, 'path' AS field, p AS t, len(p) + len(b) AS length FROM tok UNION ALL SELECT chunk_id, 'body', b, len(p) + len(b) FROM tok), (SELECT unnest(['all', 'rights reserved']) AS phrase)
), held AS (SELECT * FROM post WHERE tf > 0
), df AS (SELECT phrase, field, count(*) AS df FROM held GROUP BY ALL
), g AS (SELECT chunk_id, phrase, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END
    * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)) AS gain FROM held JOIN df USING (phrase, field), stats)
SELECT chunk_id, round(-sum(gain), 6) AS score FROM g GROUP BY chunk_id HAVING count(DISTINCT phrase) = 2""")
def phrase_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the term "all" and the phrase "rights reserved", scored by positions, each with a frequency of its own."""
    chunks = corpus.chunks(spark, sf_dir)
    tokens = sorted({t for p in PHRASES for t in p})
    found = lexical.phrase_postings(lexical.positional(chunks, FIELDS).where(F.col("term").isin(tokens)), PHRASES)
    scores = lexical.bm25(found, lexical.corpus_stats(chunks, FIELDS), [" ".join(p) for p in PHRASES])
    return scores.select("chunk_id", F.round("score", 6).alias("score"))
