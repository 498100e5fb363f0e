"""BM25 against SQLite's own, and matching rules."""

import sqlite3

import pytest

from tomeforge.functions import text
from tomeforge.operators import lexical

ROWS = [
    ("c1", "docs/a.md", "The quick brown fox café jumps", "Intro"), ("c2", "docs/b.md", "quick quick slow", "Fox > Run"),
    ("c3", "src/fox.ts", "const foo_bar = quickFox(1)", ""), ("c4", "x/y.md", "nothing here but a fox and a quick end", "Quick"),
    ("c5", "x/z.md", "bar foo", ""), ("c6", "x/foo.md", "plain words only for the mean length", "Words"),
]
FIELDS = ("path", "heading", "body")


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, p, b, h, "ignored context") for i, p, b, h in ROWS], "chunk_id string, path string, body string, heading string, context string")


@pytest.mark.parametrize("terms", [["quick"], ["quick", "fox"], ["cafe"], ["foo"]])
def test_bm25_equals_sqlite(spark, chunks, terms):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(chunk_id UNINDEXED, path, heading, body, context, tokenize = 'unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, 'ignored context')", [(i, p, h, b) for i, p, b, h in ROWS])
    match = " AND ".join("(" + " OR ".join(f'{f}:"{t}"' for f in FIELDS) + ")" for t in terms)
    want = dict(db.execute("SELECT chunk_id, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
    found = lexical.postings(chunks, FIELDS, ("context",)).where(lexical.F.col("term").isin(terms))
    got = {r.chunk_id: r.score for r in lexical.bm25(found, lexical.corpus_stats(chunks, FIELDS, ("context",)), terms).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("terms", [["foo_bar"], ["quick-fox"], ["fox.ts", "quick"], ["quick quick"], ["brown-fox", "café"], ["a.md", "quick"], ["foo", "foo"], ["fox-quick"]])
def test_phrases_equal_sqlite(spark, chunks, terms):
    """A term that is cut into several tokens is a phrase with a frequency of its own."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(chunk_id UNINDEXED, path, heading, body, context, tokenize = 'unicode61')")
    rows = [*ROWS, ("c7", "q/quick/quick.md", "quick quick quick fox brown fox", "Quick quick"), ("c8", "a", "", "")]
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, 'ignored context')", [(i, p, h, b) for i, p, b, h in rows])
    match = " AND ".join("(" + " OR ".join(f'{f}:"{t}"' for f in FIELDS) + ")" for t in dict.fromkeys(terms))
    want = dict(db.execute("SELECT chunk_id, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
    held = spark.createDataFrame([(i, p, b, h, "ignored context") for i, p, b, h in rows], chunks.schema)
    phrases = [list(r) for r in spark.range(1).select(*[text.tokens(lexical.F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]).first()]
    found = lexical.positional(held, FIELDS, ("context",)).where(lexical.F.col("term").isin([t for p in phrases for t in p]))
    scored = lexical.bm25(lexical.phrase_postings(found, phrases), lexical.corpus_stats(held, FIELDS, ("context",)), [" ".join(p) for p in phrases])
    assert {r.chunk_id: r.score for r in scored.collect()} == pytest.approx(want)
    assert lexical.phrase_postings(found, [[]]).count() == 0


def test_phrases(chunks):
    held = lambda *p: {r.chunk_id for r in lexical.matches_all(chunks, list(p), FIELDS).collect()}
    assert held(["foo", "bar"]) == {"c3"}
    assert held(["bar"]) == {"c3", "c5"}
    assert held([]) == set()
    assert held(["fox"], ["quick"]) == {"c1", "c2", "c4"}
