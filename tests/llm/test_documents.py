"""Operators that judge each document for itself, against plain Python."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomeforge.llm import license, packing, pii, quality, queries, tokencount

tokenizers = pytest.importorskip("tokenizers")
PATH = queries.tokenizer_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
ALPHABET = st.text(st.sampled_from(list("abstrvle'  \t\n!19é日👍  ")), max_size=60)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def both(edge, spark, sf):
    return [*edge.select("doc_id", "text").collect(), *spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def rows(df):
    return collections.Counter(map(tuple, df.collect()))


# token counts


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, min_size=1, max_size=4))
def test_counts_equal_the_library(texts):
    assert tokencount.count_tokens(texts, tokencount.machine_for(PATH)).tolist() == [len(ids(t)) for t in texts]


def test_pieces_split_alike_at_every_character():
    texts = [f"a{chr(c)}1!{chr(c)}{chr(c)} 's" for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert tokencount.count_tokens(texts, tokencount.machine_for(PATH)).tolist() == [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_chunks_do_not_show():
    points = np.array([*map(ord, "It's  a \n\ntest we'll 've 12"), tokencount.END], np.uint32)
    assert all((tokencount.piece_starts(points, k) == tokencount.piece_starts(points)).all() for k in (1, 2, 3, 7))


def test_a_full_state_table_starts_anew():
    small = tokencount.PieceCounter(PATH, most_states=8)
    texts = ["hello wonderful world", "strange constellations"] * 3
    assert [tokencount.count_tokens([t], small)[0] for t in texts] == [len(ids(t)) for t in texts]


def test_token_counts_of_all_documents(spark, edge, empty, sf):
    got = rows(tokencount.with_token_counts(edge, PATH, 1024))
    assert got == collections.Counter((i, len((t or "").encode()), n := len(ids(t)), n > 1024) for i, t in edge.select("doc_id", "text").collect())
    assert rows(queries.op7_token_counts(spark, sf)) == collections.Counter((i, len(t.encode()), n := len(ids(t)), n > 1024) for i, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert tokencount.with_token_counts(empty, PATH, 1024).count() == 0


# packing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=60))
def test_assign_fills_every_sequence(lengths):
    pieces = packing.assign(np.array(lengths), 1024, 1.0, 1 / 1024)
    by, spans = collections.defaultdict(list), collections.defaultdict(list)
    for d, start, n, s, offset in pieces:
        by[s].append((offset, n))
        spans[d].append((start, n))
    for parts, total in [*((p, None) for p in by.values()), *((spans[d], n) for d, n in enumerate(lengths))]:
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
        assert at == total if total else at == 1024 or at & (at - 1) == 0


def test_large_documents_are_spread_over_sequences():
    pieces = packing.assign(np.array([500] * 8 + [20] * 6), 1024, 1.0, 1 / 1024)
    large = collections.Counter(s for d, _, n, s, _ in pieces if n == 500)
    assert max(large.values()) <= 2


@pytest.mark.parametrize("block", [1 << 21, 700])
def test_packing_keeps_every_id_once(edge, block):
    got = packing.pack(edge, PATH, block_tokens=block, at_once=100).collect()
    found = collections.defaultdict(bytes)
    for r in sorted(got, key=lambda r: (str(r.doc_id), r.doc_tokens, r.start)):
        assert len(r.ids) == 4 * r.length <= 4096
        found[r.doc_id] += bytes(r.ids)
    want = collections.defaultdict(bytes)
    for i, t in sorted(edge.select("doc_id", "text").collect(), key=lambda r: (str(r[0]), len(ids(r[1])))):
        want[i] += np.array([*ids(t), 0], "<u4").tobytes()
    assert found == want
    filled = collections.Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert all(n == 1024 or n & (n - 1) == 0 for n in filled.values())


def test_packing_query(spark, sf, empty):
    texts = dict(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    coded = {i: np.array([*ids(t), 0], "<u4") for i, t in texts.items()}
    got = queries.op10_packing(spark, sf).collect()
    assert sum(r.length for r in got) == sum(map(len, coded.values()))
    for r in got:
        assert r.doc_tokens == len(coded[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(coded[r.doc_id][r.start : r.start + r.length].tobytes())
    assert packing.pack(empty, PATH).count() == 0


# quality rules


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures(spark, edge, empty, sf):
    columns = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()
    docs = edge.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    for r in quality.judged(docs).collect():
        assert tuple(r[c] for c in columns) == measured(r.text)
        assert not (r.base_failed and r.kept)
    assert quality.judged(edge).columns[: len(edge.columns)] == edge.columns
    assert quality.judged(empty).count() == 0


def test_quality_verdicts(spark):
    words = [f"word{i}" for i in range(60)]
    good = " ".join(words) + "."
    texts = {
        "good": good, "one bad line": good + "\nHome | News | About | Contact | Help", "symbols": " ".join(w + "###" for w in words),
        "bars": " | ".join(words), "shout": good.upper(), "stutter": good[:-1] + " again" * 80 + ".", "boilerplate": good + "\nWe use it: accept cookies.",
    }
    got = {r.name: r for r in quality.judged(spark.createDataFrame(list(texts.items()), "name string, text string"), clean=True).collect()}
    assert {k for k, r in got.items() if r.kept} == {"good", "one bad line", "boilerplate"}
    assert got["one bad line"].clean_text == got["boilerplate"].clean_text == good


def test_quality_keeps_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.05 * len(bad)


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in span.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def spans_of(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m.group()))


def test_base_spans(spark, edge, empty, sf):
    hard = ["1 2 3 4 5 6 7 8 9 0 1 2 3 4", "a@b", "a@b..c", "x@y-.z.", "٤@b.c", "+1-", "+12 34 56 78 90.", "0.0.0.256.1.2.3", "001.02.3.4", "4111-1111-1111-1111 1", "4111  1111", "é4111111111111111", "a@b.c@d.e", "%@-.-", "1.2.3.4@h.io", "+1 2-3.4(5)6 7 8 9)"]
    docs = edge.select("text").union(spark.createDataFrame([(x,) for x in hard], "text string")).union(spark.read.parquet(f"{sf}/documents.parquet").select("text"))
    from pyspark.sql import functions as F

    for r in pii.with_spans(docs).select("text", pii.listed(F.col("found"), pii.BASE).alias("base")).collect():
        assert r.base == spans_of(r.text), r.text
    assert pii.with_spans(empty).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("a.@1+ -()%é")), max_size=40), min_size=40, max_size=40))
def test_base_spans_of_any_text(spark, texts):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in pii.with_spans(docs).select("text", pii.listed(F.col("found"), pii.BASE).alias("base")).collect():
        assert r.base == spans_of(r.text)


def test_very_long_runs_end(spark):
    runs = ["a." * 50000, "a" * 100000 + "@", "1 " * 50000, "9" * 100000, "1." * 50000, "+1" + "-1" * 50000, "a@b" + ".c" * 50000]
    assert pii.with_spans(spark.createDataFrame([(x,) for x in runs], "text string")).select("found").toLocalIterator().__next__() is not None


def test_own_kinds_are_learned():
    for kind, (trees, threshold) in pii.models().items():
        spans = pii.labelled_spans(kind, 400, 99)
        says = [sum(pii.leaf(t, pii.features_of(kind, s, b)) for t in trees) >= threshold for s, b, _ in spans]
        hits = sum(a and y for a, (*_, y) in zip(says, spans))
        assert hits >= 0.95 * sum(says) and hits >= 0.85 * sum(y for *_, y in spans), kind


def test_redaction(spark):
    text = 'é a@b.cc and 1.2.3.4, token = "0641917ea4e9feb9cda83477b57ac2654884f485" end'
    docs = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, found string")
    got = {r.doc_id: (r.text, r.found) for r in pii.redact(docs).collect()}
    assert got == {1: ('é [EMAIL] and [IP], token = "[SECRET]" end', "x"), 2: (None, "y"), 3: ("", "z")}


def test_long_secrets_are_redacted(spark):
    key = "".join(np.random.default_rng(8).choice(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 2000))
    docs = spark.createDataFrame([(1, f"token = {key} end"), (2, "=" * 2000)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "token = [SECRET] end", 2: "=" * 2000}


# license scans


def base_places(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words, places, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text), [], set()
    for phrase, label in license.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places, labels = places + at, labels | ({label} if at else set())
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, edge, empty, sf):
    docs = edge.select("doc_id", "text").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    want = collections.Counter((r.doc_id, *base_places(r.text)) for r in docs.collect())
    got = license.with_licenses(docs)
    assert rows(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == want
    for r in got.collect():
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert license.with_licenses(empty).count() == 0


def test_fuzzy_notices_are_those_of_a_full_search():
    import regex

    notice = "released under the mit license"
    k = license.edits_for(notice, 0.1)
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = list("some words " + notice + " more words")
        for _ in range(int(rng.integers(0, 6))):
            i = int(rng.integers(0, len(text)))
            text[i : i + 1] = [[], ["q"], [text[i], "z"]][int(rng.integers(3))]
        line = "".join(text)
        full = regex.search(f"(?b)(?:{notice}){{e<={k}}}", line) is not None
        assert bool([x for x in license.fuzzy(line, ((notice, "mit"),), 0.1)]) == full


def test_fuzzy_labels_and_words():
    got = license.scan(b"Hello. Licenced under the Apache Licence, Version 2.0!", license.PHRASES, license.NOTICES, 0.1)
    assert got[5] == "apache-2" and got[1] == 0 and 0.9 < got[6] < 1
    assert got[7] == [{"label": "apache-2", "first_word": 1, "last_word": 8, "edits": 2}]


def test_notices_beside_a_better_match():
    text = b"x released undr the mit license and released under the mit license y"
    assert [(s["first_word"], s["last_word"], s["edits"]) for s in license.scan(text, license.PHRASES, license.NOTICES, 0.1)[7]] == [(1, 5, 1), (7, 11, 0)]


# very long texts


def test_one_long_text_takes_time_in_proportion(spark):
    """100,000 lines, and tens of thousands of matches in a row, within seconds each."""
    import time

    from tomeforge.llm import chat, license, substring
    from tomeforge.llm.common import running

    n = 100_000
    lines = spark.createDataFrame([(1, "".join(f"w{i} a b c d e f g\n" for i in range(n)))], "doc_id long, text string")
    mails = spark.createDataFrame([(1, "".join(f"u{i}@host.org +49 (151) 555-{i % 9000 + 1000}, " for i in range(20_000)))], "doc_id long, text string")
    turns = spark.range(60_000).selectExpr("1L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id) as text")
    values = spark.range(1).select(F.array_repeat(F.lit(3), n).alias("v"))
    took = {}

    def timed(name, work):
        began = time.monotonic()
        out = work()
        took[name] = time.monotonic() - began
        return out

    sums = timed("running", lambda: values.select(running(F.col("v")).alias("s")).first().s)
    assert sums == [3 * k for k in range(1, n + 1)]
    found = timed("lines", lambda: substring.units(lines, "doc_id", "text", "line", 8).agg(F.count("*"), F.max("end")).first())
    assert tuple(found) == (n, len(lines.first().text))
    spans = timed("spans", lambda: pii.with_spans(mails).select("found").first().found)
    assert (len(spans["email"]), len(spans["phone"])) == (20_000, 20_000)
    clean = timed("redacted", lambda: pii.redact(mails).first().text)
    assert clean == "[EMAIL] [PHONE], " * 20_000
    form = timed("chat", lambda: chat.formatted(turns).first())
    assert len(form.loss_spans) == 30_000 and form.formatted[form.loss_spans[-1].start :].startswith("turn 59999<|im_end|>")
    back = timed("read back", lambda: chat.read_back(chat.formatted(turns)).select(F.size("turns").alias("n"), F.sha2("loss", 256).alias("h")).first())
    assert back.n == 60_000 and back.h == hashlib.sha256("".join(f"turn {i}" for i in range(1, 60_000, 2)).encode()).hexdigest()
    twice = lines.unionByName(lines.select(F.lit(2).cast("long").alias("doc_id"), F.concat(F.lit("x\n"), "text").alias("text"))).unionByName(lines.limit(0))
    cut = timed("without repeats", lambda: {r.doc_id: r.text for r in substring.without_repeats(twice, unit="line").collect()})
    assert cut == {1: lines.first().text, 2: "x\n"}
    notice = b"licensed under the gnu general public license and released under the mit license. " * 10_000
    result = timed("license", lambda: license.scan(notice, license.PHRASES, license.NOTICES, 0.1))
    assert result[1] == 10_000 and len(result[-1]) == 20_000
    assert max(v for k, v in took.items() if k != "license") < 30, took
    # some milliseconds a notice, which is more or less than a bound in seconds by machine: a quarter of them shows the growth
    timed("a quarter", lambda: license.scan(notice[: len(notice) // 4], license.PHRASES, license.NOTICES, 0.1))
    assert took["license"] < 8 * took["a quarter"], took
