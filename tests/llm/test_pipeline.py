"""The pipeline, stage by stage and as a whole."""

import collections
import os

import pytest

import corpus_pipeline as pipeline
from tomeforge.llm import shingles, simhash
from tests.llm.test_corpus import components_by_all_pairs, parts_of, plain_fingerprint
from tests.llm.test_documents import measured, spans_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows before the first stage and after each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], sf).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_quality(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[:2])
    assert set(after) <= {i for i, t in before.items() if not measured(t)[-1]}
    assert all(set(after[i].split("\n")) <= set(before[i].split("\n")) for i in after)


def test_one_of_each_group_of_fingerprints(stages):
    """``first_of_each`` with its own rule, 4 words and 4 bits, which is not that of the stage."""
    rows = stages[1].select("doc_id", "text").collect()
    want = set(components_by_all_pairs([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows]))
    assert collections.Counter(r.doc_id for r in simhash.first_of_each(stages[1]).collect()) == collections.Counter(want)


def test_one_of_each_group_of_near_copies(stages):
    """Five-word Jaccard similarity 0.8 or more, against all pairs."""
    rows = stages[1].select("doc_id", "text").collect()
    grams = []
    for _, t in rows:
        w = t.encode().lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    part = parts_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if alike(grams[i], grams[j])])
    low = {}
    for (i, _), p in zip(rows, part):
        low[p] = min(low.get(p, i), i)
    assert collections.Counter(r.doc_id for r in stages[2].collect()) == collections.Counter(low.values())


def test_near_copies_by_fingerprints_alone(spark):
    """Without any band, the grid of fingerprints brings sets together, and their exact similarity decides."""
    long = [f"w{i}" for i in range(400)]
    texts = [" ".join(long), " ".join(long[:-1] + ["end"]), "one two three four five " * 60 + "a b c d e f g h", "one two three four five " * 60 + "i j k l m n o p"]
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert all((fps[a] ^ fps[a + 1]).bit_count() <= 4 for a in (0, 2))
    docs = spark.createDataFrame(list(enumerate([*texts, "", None, texts[0].upper()])), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_copies(docs, miss=1.0).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 0}
    assert {r.doc_id: r.component_id for r in shingles.near_copies(docs).collect()} == got


def test_no_personal_data_is_left(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[2:4])
    assert set(before) == set(after) and not any(spans_of(r.text) for r in after.values())
    assert all(after[i].n_chars == len(after[i].text) for i in after)
    assert sum(after[i].text == before[i].text for i in after) > 0.8 * len(after)


def test_mixture_and_packing(stages):
    left = {r.doc_id: r.text for r in stages[3].collect()}
    mixed = collections.Counter(r.doc_id for r in stages[4].collect())
    assert set(mixed) <= set(left) and max(mixed.values()) <= 3
    pieces = stages[5].collect()
    assert {r.doc_id for r in pieces} == set(mixed)
    assert collections.Counter(r.doc_id for r in pieces if r.start == 0) == mixed


def test_run_equals_its_stages(spark, sf, stages):
    got, want = (collections.Counter((r.doc_id, r.doc_tokens) for r in df.collect() if r.start == 0) for df in (pipeline.run(spark, sf), stages[-1]))
    assert got == want


def test_edges(spark, edge, empty, sf):
    docs = edge.select(*COLUMNS)
    for _, stage in pipeline.STAGES:
        stage(spark, docs, sf).collect()
        assert stage(spark, empty.select(*COLUMNS), sf).count() == 0


def test_library_stands_without_the_operators():
    root = os.path.dirname(os.path.abspath(pipeline.__file__))
    for folder, _, names in os.walk(f"{root}/tomeforge"):
        if not folder.startswith(f"{root}/tomeforge/llm"):
            assert not any("tomeforge.llm" in open(f"{folder}/{n}").read() or "from .llm" in open(f"{folder}/{n}").read() for n in names if n.endswith(".py"))
