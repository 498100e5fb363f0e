"""Lexical search: postings, term matching, BM25 over fields, boosts, pages.

Postings are a table (chunk_id, field, term, tf, length of the whole row), built once and
clustered by term, so a query reads the rows of its terms only. Ranking never carries texts:
a page joins them by chunk at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B = 1.2, 0.75
CANDIDATES, PER_FILE = 400, 3
# Words that mark a question about history.
HISTORY_WORDS = ("why", "history", "plan", "planned", "decision", "decisions", "rationale", "changelog", "deprecated", "superseded", "originally")


def terms_of(query: str) -> list[str]:
    return query.split()


def tokenized(chunks: DataFrame, fields: tuple[str, ...], extra: tuple[str, ...] = (), key: str = "chunk_id") -> DataFrame:
    """(key, field, tokens, length): one row per chunk and field; ``extra`` fields count for the length only."""
    held = chunks.select(key, *[tokens(F.col(f)).alias(f) for f in (*fields, *extra)])
    length = reduce(lambda a, b: a + b, [F.size(f) for f in (*fields, *extra)])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("tokens")) for f in fields]))
    return held.select(key, length.cast("long").alias("length"), rows.alias("r")).select(key, "r.field", "r.tokens", "length")


def postings(chunks: DataFrame, fields: tuple[str, ...], extra: tuple[str, ...] = (), key: str = "chunk_id") -> DataFrame:
    """(term, field, key, tf, length). A filter on term is pushed below the count, so only its rows are shuffled."""
    rows = tokenized(chunks, fields, extra, key).select(key, "field", "length", F.explode("tokens").alias("term"))
    return rows.groupBy("term", "field", key, "length").agg(F.count("*").alias("tf"))


def positional(chunks: DataFrame, fields: tuple[str, ...], extra: tuple[str, ...] = (), key: str = "chunk_id") -> DataFrame:
    """``postings`` with ``positions``, where each term stands in its field, ascending from 0."""
    rows = tokenized(chunks, fields, extra, key).select(key, "field", "length", F.posexplode("tokens").alias("at", "term"))
    return rows.groupBy("term", "field", key, "length").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("at")).alias("positions"))


def phrase_postings(found: DataFrame, phrases: list[list[str]], key: str = "chunk_id") -> DataFrame:
    """(term, field, key, tf, length) of phrases, ``term`` being a phrase's tokens with spaces, from ``positional`` rows of their tokens.

    A phrase stands where the positions of its tokens, each less its place in the phrase, have a number in common; how
    often it does is its ``tf``. Only position lists of the query's tokens are read and shuffled, and no text. Phrases
    of one token are taken as they are; one that is named twice counts once, and empty ones are left out.
    """
    wanted = sorted({tuple(p) for p in phrases if p})
    places = [F.when(F.col("term") == t, F.struct(F.lit(" ".join(p)).alias("phrase"), F.lit(len(p)).alias("size"), F.lit(i).alias("i"))) for p in wanted for i, t in enumerate(p)]
    rows = found.withColumn("p", F.explode(F.array_compact(F.array(*places)))) if places else found.withColumn("p", F.expr("struct('' as phrase, 0 as size, 0 as i)")).limit(0)
    starts = F.transform("positions", lambda x: x - F.col("p.i"))
    lists = rows.groupBy("p.phrase", "p.size", "field", key, "length").agg(F.collect_list(starts).alias("lists"))
    # a phrase's tokens are as many lists of one field of one chunk
    common = F.aggregate(F.slice("lists", 2, F.size("lists")), F.get("lists", 0), F.array_intersect)
    met = lists.where(F.size("lists") == F.col("size")).withColumn("tf", F.size(common).cast("long"))
    return met.where("tf > 0").select(F.col("phrase").alias("term"), "field", key, "tf", "length")


def corpus_stats(chunks: DataFrame, fields: tuple[str, ...], extra: tuple[str, ...] = (), by: str | None = None) -> DataFrame:
    """One row: number of chunks, and their mean length over all fields; or a row for each value of ``by``, with all ``words``."""
    length = reduce(lambda a, b: a + b, [F.size(tokens(F.col(f))) for f in (*fields, *extra)])
    figures = F.count("*").alias("n"), F.avg(length).alias("mean_length")
    return chunks.groupBy(by).agg(*figures, F.sum(length).alias("words")) if by else chunks.agg(*figures)


def contributions(found: DataFrame, stats: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Adds ``gain``: each (term, field)'s share of a chunk's score.

    ``stats`` is one row. Document frequencies are a row per term and field of the query, so
    both are broadcast by their size; the frequencies' aggregate is shared by plan reuse.
    """
    df = found.groupBy("term", "field").agg(F.count("*").alias("df"))
    rated = found.join(df, ["term", "field"]).crossJoin(F.broadcast(stats))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    norm = K1 * (1 - B + B * F.col("length") / F.col("mean_length"))
    return rated.withColumn("gain", idf * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))


def bm25(found: DataFrame, stats: DataFrame, terms: list[str], key: str = "chunk_id") -> DataFrame:
    """(key, score) of chunks that hold every term in some field; lower is better."""
    scored = contributions(found, stats, key).groupBy(key).agg(F.sum("gain").alias("gain"), F.count_distinct("term").alias("held"))
    return scored.where(F.col("held") == len(set(terms))).select(key, (-F.col("gain")).alias("score"))


def holds_phrase(text: Column, phrase: list[str]) -> Column:
    """Whether a term that is cut into several tokens stands as a phrase; an empty phrase is never held."""
    if not phrase:
        return F.lit(False)
    if len(phrase) == 1:
        return F.array_contains(tokens(text), phrase[0])
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), F.lit(f" {' '.join(phrase)} "))


def matches_all(chunks: DataFrame, phrases: list[list[str]], fields: tuple[str, ...]) -> DataFrame:
    """Chunks where each phrase stands in one of the fields."""
    each = [reduce(lambda a, b: a | b, [holds_phrase(F.col(f), p) for f in fields]) for p in phrases]
    return chunks.where(reduce(lambda a, b: a & b, each)) if each else chunks.limit(0)


def path_boost(path: Column, terms: list[str]) -> Column:
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower(path), F.lit(t.lower())) for t in terms])
    return F.when(hit, -10.0).otherwise(0.0)


def heading_boost(heading: Column, terms: list[str]) -> Column:
    parts = F.transform(F.split(heading, " > "), F.lower)
    return F.when(F.arrays_overlap(parts, F.array(*[F.lit(t.lower()) for t in terms])), -4.0).otherwise(0.0)


def role_boost(role: Column, fixture: Column, terms: list[str]) -> Column:
    past = any(t.lower() in HISTORY_WORDS for t in terms)
    wanted = ("plan", "decision", "historical", "execution-record") if past else ("current-doc", "instruction")
    return F.when(~fixture & role.isin(*wanted), -2.0).otherwise(0.0)


def explained(path: Column, heading: Column, role: Column) -> Column:
    parts = [F.when(path < 0, "path match"), F.when(heading < 0, "heading match"), F.when(role < 0, "role match")]
    return F.array_join(F.array_compact(F.array(F.lit("lexical match"), *parts)), "; ")


def top(scored: DataFrame, n: int, *order) -> DataFrame:
    return scored.orderBy(*order).limit(n)


def per_file(hits: DataFrame, order: list, most: int = PER_FILE) -> DataFrame:
    """At most ``most`` hits of a path, in order."""
    rank = F.row_number().over(W.partitionBy("path").orderBy(*order))
    return hits.withColumn("in_file", rank).where(F.col("in_file") <= most)


def page(hits: DataFrame, order: list, offset: int = 0, size: int = 5) -> DataFrame:
    """Hits ``offset`` + 1 to ``offset`` + ``size``, with their rank. Ranks a bounded candidate list, so one task is enough."""
    ranked = hits.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + size))


def within_budget(hits: DataFrame, cost: Column, budget: int) -> DataFrame:
    """Hits in rank order while their running cost fits; the first always stays."""
    run = F.sum(cost).over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return hits.withColumn("spent", run).where((F.col("spent") <= budget) | (F.col("rank") == F.lit(1)))
