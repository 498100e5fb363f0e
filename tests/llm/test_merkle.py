"""The Merkle manifest against a plain recursion, and its proofs against changes of a row."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tomeforge.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, i int, path string, digest int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return digest(*[field(row[c]) for c in merkle.COLUMNS])


def plain_tree(nodes, run):
    """(root, siblings of each node as (left, right) from the bottom up)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for p, i in zip(paths, at):
            a = i // run * run
            p.append(("".join(level[a:i]), "".join(level[i + 1 : a + run])))
        level = [digest(*level[a : a + run]) for a in range(0, len(level), run)]
        at = [i // run for i in at]
    return level[0], paths


def plain_manifest(rows, run=3):
    """Sorted (id, leaf, subroot, root, proof) of all rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r["doc_id"], plain_leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    done = []
    for s in order:
        leaves = sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        done.append((leaves, *plain_tree([h for _, h in leaves], run)))
    root, tops = plain_tree([sub for _, sub, _ in done], run)
    out = []
    for (leaves, sub, paths), top in zip(done, tops):
        for (i, h), p in zip(leaves, paths):
            out.append((str(i), h, sub, root, digest(*[a + b for a, b in p + top])))
    return sorted(out)


def made(df, run=3):
    h = [merkle.hexed(F.col(c)) for c in ("leaf", "subroot", "root")]
    back = merkle.folded(F.col("found_leaf"), F.col("path"))
    rows = df.select(F.col("doc_id").cast("string"), *h, merkle.proof_digest(F.col("path")), back == h[2]).collect()
    return sorted(tuple("None" if x is None else x for x in r)[:5] for r in rows), [r[5] for r in rows]


@pytest.mark.parametrize("run", [2, 3])
def test_manifest_equals_a_plain_recursion(spark, run):
    sizes = {"b": 1, "é": 2, None: 4, "a": 85, "Z": 700, "": 3}
    rows = [(n * 10 + k if k % 11 else None, s, "en" if k % 3 else None, k if k % 5 else None, [None, "", "text\n" * k, "ü\0"][k % 4], "x", 1, "p", 2) for n, (s, size) in enumerate(sizes.items()) for k in range(size)]
    rows += rows[-300:-290]  # repeated rows
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got, verified = made(merkle.manifest(docs, run=run))
    assert got == plain_manifest([dict(zip(SCHEMA.replace(",", "").split()[::2], r)) for r in rows], run)
    assert all(verified)


def test_more_groups_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_GROUPS", 3)
    rows = [(k, f"s{k % 9}" if k % 7 else None, "en", k, "t", "x", 1, "p", 2) for k in range(60)]
    got, _ = made(merkle.manifest(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_manifest([dict(zip(SCHEMA.replace(",", "").split()[::2], r)) for r in rows])


def test_edges(spark, edge, empty):
    rows = [r.asDict() for r in edge.collect()]
    got, verified = made(merkle.manifest(edge))
    assert got == plain_manifest(rows) and all(verified)
    assert merkle.manifest(empty).collect() == []
    one = edge.where("doc_id = 4")
    (r,) = merkle.manifest(one).collect()
    assert r.leaf == r.subroot == r.root and r.path == []


def test_changed_rows_do_not_verify(spark, edge):
    """Each column counts, and a change of one row is no fault of the others."""
    for column, value in {"text": F.concat("text", F.lit(" ")), "n_chars": F.lit(None).cast("long"), "lang": F.lit("de"), "source": F.lit("q")}.items():
        now = F.when(F.col("doc_id") == 8, value).otherwise(F.col(column))
        found = merkle.manifest(edge, found={column: now})
        back = merkle.folded(F.col("found_leaf"), F.col("path")) == merkle.hexed(F.col("root"))
        assert {r.doc_id for r in found.where(~back).collect()} == {8}
