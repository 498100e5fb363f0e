"""Toxicity scores: counts against a plain recount, probabilities that add up, held-out labels, and edges."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomeforge.llm import toxicity
from tomeforge.llm.toxicity import Model, counted, sampled, scored, stems

TEXTS = ["the cat sat on the mat", "a vile cat, a vile dog", "The dog sat; the dog ran", "vile vilest 日本 vile_ness", "", "cat"] * 3
LABELS = [0, 1, 0, 1, 0, 1] * 3


@pytest.fixture(scope="module")
def tiny(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(LABELS)], "doc_id long, toxic int")
    return docs, labels


def halves(spark, ids):
    hashed = spark.createDataFrame([(i,) for i in ids], "of long").select("of", (F.pmod(F.xxhash64("of", F.lit(12)), F.lit(2)) == 0).alias("one"))
    return {r.of: 1 if r.one else 2 for r in hashed.collect()}


def test_counts_equal_a_plain_recount(spark, tiny):
    docs, labels = tiny
    pairs, nodes, _ = counted(sampled(docs, labels, "doc_id", "text", "toxic", 100), 1)
    known = [i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 3 != 1]
    half = halves(spark, known)
    seen = {(h, c): set() for h in (1, 2, 3) for c in (0, 1)}
    for i in known:
        ws = ["", "", *[w for part in toxicity.words(TEXTS[i]) for w in part]]
        for h in (half[i], 3):
            seen[h, LABELS[i]] |= set(zip(ws, ws[1:], ws[2:]))
    for (h, c), grams in seen.items():
        want = collections.Counter((v, w) for _, v, w in grams if v)
        got = {(r.v, r.w): r[f"n{h}_{c}"] for _, r in pairs.iterrows() if r[f"n{h}_{c}"]}
        assert got == want
        alone = collections.Counter(w for _, w in {(v, w) for _, v, w in grams})
        begun = collections.Counter()
        for w, n in alone.items():
            for node in ["", *stems(w), w]:
                begun[node] += n
        assert {r.node: r[f"n{h}_{c}"] for _, r in nodes.iterrows() if r[f"n{h}_{c}"]} == begun


def test_probabilities_add_up(tiny):
    """Of each class, what goes on from a beginning adds up to it; an unseen form has one share of the backoff mass."""
    docs, labels = tiny
    pairs, nodes, totals = counted(sampled(docs, labels, "doc_id", "text", "toxic", 100), 1)
    model = Model.of(pairs, nodes, totals, 3, 1)
    words = [i for w, i in model.number.items() if w and not w.endswith("*")]
    assert np.allclose(model.alone[:, words].sum(1), 1)
    for v in {w for w, i in model.number.items() if model.busy[i]}:
        v = model.number[v]
        p = np.zeros(2)
        for w in words:
            k = np.searchsorted(model.pairs, v * len(model.busy) + w)
            hit = k < len(model.pairs) and model.pairs[k] == v * len(model.busy) + w
            p += [((model.count[c][k] if hit else 0) + model.backoff[v] * model.alone[c][w]) / (model.mass[c][v] + model.backoff[v]) for c in (0, 1)]
        assert np.allclose(p, 1)
    ratio = model.ratios("a vile the mat")
    assert ratio[1] > 0 > ratio[2]
    assert model.log_ratio[model.numbered("vilified")[0]] > 0  # known by its stem alone


def test_held_out_texts_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("toxic", "score", "predicted").toPandas()
    y, rank = rows.toxic.to_numpy(), rows.score.rank().to_numpy()
    n = y.sum()
    assert (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)) > 0.93
    assert rows.predicted[y == 1].mean() > 0.7 and rows.predicted[y == 0].mean() < 0.01
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.7)).all()


def test_held_out_labels_and_other_columns_are_not_read(tiny):
    docs, labels = tiny
    plain = {r.doc_id: r.score for r in scored(docs, labels, least=1).collect()}
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = {r.doc_id: r.score for r in scored(docs.withColumn("toxic", F.lit("1")).withColumn("source", F.lit("q")), turned, least=1).collect()}
    # the share of toxic labels is of learned ones too
    assert plain == pytest.approx(other)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored(docs, labels, least=1).collect())


def test_edges(spark, tiny, edge, empty):
    docs, labels = tiny
    assert scored(empty, labels).collect() == []
    got = scored(edge.unionByName(docs.select("doc_id", "text"), allowMissingColumns=True), labels, least=1)
    assert got.count() == edge.count() + docs.count() and got.where("score is null or not score between 0 and 1").count() == 0
    assert got.where("doc_id is null and held_out").count() == 0
    for some in (labels.limit(0), labels.where("toxic = 1"), labels.withColumn("toxic", F.lit(None).cast("int")), labels.withColumn("doc_id", F.lit(None).cast("long"))):
        assert scored(docs, some).select("score").distinct().count() == 1
    wordless = docs.withColumn("text", F.lit("1 2 3"))
    assert scored(wordless, labels).select("score").distinct().count() == 1


def test_long_texts_are_scored_whole(tiny, monkeypatch):
    docs, labels = tiny
    pairs, nodes, totals = counted(sampled(docs, labels, "doc_id", "text", "toxic", 100), 1)
    model = Model.of(pairs, nodes, totals, 3, 1)
    text = "the cat sat " * 5000 + "vile " + "the dog ran " * 5000
    whole = model.evidence(text)
    assert whole[1] > model.evidence(text.replace("vile ", ""))[1]
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert model.evidence(text) == pytest.approx(whole)
