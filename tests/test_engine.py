"""The engine end to end on a small tree; sources, store and streams."""

import json

import pytest
from pyspark.sql import functions as F

from tomeforge.engine import Config, Engine
from tomeforge.operators import experiments, graph, policy
from tomeforge.functions import random as rnd
from tomeforge.sources import filesystem, git
from tomeforge.sources.store import Store
from tomeforge.streaming import events

TREE = {
    "README.md": "# Guide\n\nHow to tune the flux valve.\n\n## Safety\n\nKeep the flux low.\n",
    "docs/plans/next.md": "# Plan\n\nWhy the flux valve was planned.\n",
    "src/util.ts": "export function helper(x: number) {\n  return x;\n}\n",
    "src/main.ts": "import { helper } from './util';\n\nexport function flux() {\n  return helper(1);\n}\n",
    "node_modules/m/i.js": "flux", ".env": "KEY=1", "testdata/README.md": "# Flux\n\ncopied flux valve\n", "conf/a.toml": "[flux]\nvalve = 1\n",
}


@pytest.fixture()
def engine(spark, tmp_path):
    for path, body in TREE.items():
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(body)
    return Engine(spark, str(tmp_path / "src"), str(tmp_path / "store"))


def test_life_of_an_index(engine, tmp_path):
    assert engine.check() == "missing"
    first = engine.index()
    assert engine.check() == "ok" and engine.index() == first
    assert engine.check(require_vectors=True) == "coverage-not-met"
    paths = {r.path for r in engine.store.table("files").collect()}
    assert paths == {"README.md", "docs/plans/next.md", "src/util.ts", "src/main.ts", "testdata/README.md", "conf/a.toml"}

    hits, envelope = engine.search("flux valve")
    rows = hits.collect()
    assert envelope["mode"] == "lexical" and not envelope["degraded"] and len(rows) == envelope["hits"] > 1
    assert rows[0].path == "conf/a.toml" or rows[0].role in ("current-doc", "instruction")
    assert [r.path for r in engine.search("flux", role="code")[0].collect()] == ["src/main.ts"]
    assert [r.path for r in engine.search("flux", path="docs/*")[0].collect()] == ["docs/plans/next.md"]
    assert engine.search("->")[0].count() == 0

    page, envelope = engine.search("flux", size=2)
    seen = [r.chunk_id for r in page.collect()]
    while envelope["next_cursor"]:
        page, envelope = engine.search("flux", size=2, cursor=envelope["next_cursor"])
        seen += [r.chunk_id for r in page.collect()]
    assert len(seen) == len(set(seen)) >= 4
    with pytest.raises(ValueError):
        engine.search("valve", cursor=engine.search("flux", size=1)[1]["next_cursor"])

    chunk = engine.store.table("chunks").where("path = 'src/main.ts' and symbol = 'flux'").first().chunk_id
    found = {(r.relation, r.path) for r in engine.related(chunk).collect()}
    assert ("references", "src/util.ts") in found
    assert engine.read(chunk)["state"] == "fresh"

    (tmp_path / "src/src/main.ts").write_text(TREE["src/main.ts"] + "// more\n")
    assert engine.check() == "stale" and engine.read(chunk)["state"] == "stale"
    second = engine.index()
    assert second["generation_id"] == first["generation_id"] + 1
    (tmp_path / "src/conf/a.toml").unlink()
    engine.index()
    assert engine.store.generations() == [2, 3]
    fresh = Engine(engine.spark, engine.source, str(tmp_path / "clean"))
    fresh.index()
    ids = lambda e: {r.chunk_id for r in e.store.table("chunks").collect()}
    assert ids(fresh) == ids(engine)


def test_hybrid_and_vectors(engine):
    texts = engine.index() and engine.store.table("chunks").select(F.sha2("text", 256).alias("input_hash"), "path").collect()
    vectors = [(r.input_hash, [1.0, 0.0] if "plans" in r.path else [0.0, 1.0]) for r in texts]
    assert engine.search("flux", mode="hybrid", vector=[1.0, 0.0])[1]["degraded"]
    engine.config.excludes.append("*.toml")
    engine.index(embeddings=engine.spark.createDataFrame(vectors, "input_hash string, vector array<float>").distinct())
    hits, envelope = engine.search("flux", mode="vectors-only", vector=[1.0, 0.0])
    assert envelope["mode"] == "vectors-only" and hits.first().path == "docs/plans/next.md"
    assert engine.search("flux", mode="hybrid", vector=[1.0, 0.0])[1]["mode"] == "hybrid"
    assert engine.check(require_vectors=True) == "ok"


def test_explain_and_config(engine):
    assert not engine.explain("node_modules/a/b.js")["included"]
    assert engine.explain("src/.env")["rule"].kind == "secret" and engine.explain(".env.example")["included"] is True
    assert Config.load({"excludes": ["a"]}, {"excludes": ["b"], "rrf_k": 10}).__dict__ == {"includes": [], "excludes": ["a", "b"], "max_file_bytes": 1 << 20, "rrf_k": 10}
    with pytest.raises(ValueError):
        Config.load({"exclude": []})


def test_policy_dialect(spark):
    given = policy.rules(excludes=["/top.txt", "deep/**/x", "a?c", "only/"], native=[("", ["!*.log", "# note"]), ("sub", ["*.md", "!keep.md"])])
    paths = {"top.txt": False, "in/top.txt": True, "deep/1/2/x": False, "abc": True, "a?c": False, "only": True, "only/f": False, "z.log": True, "sub/a.md": False, "sub/keep.md": True, "a.md": True}
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", policy.decision(F.col("path"), given)["included"].alias("ok")).collect()
    assert {r.path: r.ok for r in rows} == paths


def test_contained():
    assert filesystem.contained("./a//b") == "a/b"
    for bad in ("../a", "a/../../b", "/a"):
        with pytest.raises(ValueError):
            filesystem.contained(bad)


def test_store_refuses_broken_references(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    chunks = spark.createDataFrame([("c1", None)], "chunk_id string, parent_chunk_id string")
    files = spark.createDataFrame([("p",)], "path string")
    bad = spark.createDataFrame([("s1", "missing")], "symbol_id string, chunk_id string")
    with pytest.raises(ValueError, match="symbols.chunk_id"):
        store.publish({"files": files, "chunks": chunks, "symbols": bad}, {"manifest_hash": "m", "config_fingerprint": "c"})
    assert store.current() is None and store.generations() == []


def test_git_exports(spark):
    log = "\x01abc\0p1 p2\0Ann\x001700000000\0fix (#12) and #0\0src/a.ts\ndocs/b.md\n\x01def\0\0Bob\x001700000100\0init\0"
    got = git.commits(spark.createDataFrame([(log,)], "log string"), "s").orderBy("committed_at_ms").collect()
    assert [(r.revision_id, list(r.parents), list(r.affected_paths), list(r.pr_hint)) for r in got] == [("abc", ["p1", "p2"], ["src/a.ts", "docs/b.md"], [12]), ("def", [], [], [])]
    diff = '--- a/x.ts\n+++ b/x.ts\n@@ -1,2 +1,3 @@ fn\n a\n-@@ -9,9 +9,9 @@\n+b\n+c\n@@ -9 +10 @@\n-x\n+y\n--- "a/\\303\\251"\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\n'
    assert list(git.hunks_of(diff)) == [("x.ts", 1, 2, 1, 3, "fn"), ("x.ts", 9, 1, 10, 1, ""), ("é", 1, 1, 0, 0, "")]
    assert git.unquoted('"a\\tb\\"\\\\"') == 'a\tb"\\' and git.unquoted("plain") == "plain"
    paths = spark.createDataFrame([(["src/a.ts", "b.md"],)], "p array<string>")
    assert paths.select(git.touches(F.col("p"), "src/*").alias("x"), git.touches(F.col("p"), "?.txt").alias("y")).first() == (True, False)


def test_splitmix_and_order():
    assert rnd.splitmix64(0) == 0xE220A8397B1DCDAF
    assert sorted(rnd.shuffled(7, 3)) == list(range(7)) and rnd.shuffled(7, 3) == rnd.shuffled(7, 3)


def test_bootstrap(spark):
    pairs = spark.createDataFrame([("c", f"t{i}", float(i)) for i in range(9)] + [("d", "t", 1.0)], "comparison string, task string, difference double")
    got = {r.comparison: (r.low, r.high) for r in experiments.bootstrap(pairs, 7, 200).collect()}
    assert got["c"][0] <= 4 <= got["c"][1] and got["d"][0] is None


def test_modules(spark):
    row = spark.createDataFrame([("a/b/c.ts", "../x/./y"), ("c.ts", "./d"), ("c.ts", "react")], "path string, module string")
    assert [r.b for r in row.select(graph.module_base(F.col("path"), F.col("module")).alias("b")).collect()] == ["a/x/y", "d", None]


def test_quiet_periods_of_a_stream(spark, tmp_path):
    rows = [("s", "a", "2024-01-01 00:00:00.000"), ("s", "b", "2024-01-01 00:00:00.100"), ("s", "a", "2024-01-01 00:00:05.000"), ("s", "z", "2024-01-01 01:00:00.000")]
    spark.createDataFrame(rows, "scope string, path string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("scope string, path string, ts timestamp").parquet(str(tmp_path / "in"))
    query = events.quiet_periods(stream).writeStream.format("memory").queryName("quiet").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert {(r.changes, tuple(r.paths)) for r in spark.table("quiet").collect()} == {(2, ("a", "b")), (1, ("a",))}


def test_envelopes(spark):
    rows = [("a", 0, "started"), ("a", 1, "completed"), ("b", 0, "started"), ("b", 2, "progress"), ("c", 0, "failed"), ("c", 1, "progress")]
    got = {r.run_id: (r.gapless, r.ended) for r in events.envelope_check(spark.createDataFrame(rows, "run_id string, sequence long, type string")).collect()}
    assert got == {"a": (True, True), "b": (False, False), "c": (True, False)}


def test_watch_publishes_once(engine, tmp_path):
    spark = engine.spark
    spark.createDataFrame([(json.dumps({"p": 1}),)], "value string").write.text(str(tmp_path / "changes"))
    stream = spark.readStream.format("text").load(str(tmp_path / "changes"))
    assert engine.watch(stream, str(tmp_path / "ck")).awaitTermination(120)
    assert engine.store.generations() == [1] and engine.check() == "ok"


def test_embedding_provider(spark):
    from tomeforge.operators import caches

    def provider(texts):
        if any("boom" in t for t in texts):
            raise OSError("no answer")
        return [[float(len(t)), 1.0] if t != "bad" else [float("nan"), 1.0] for t in texts]

    rows = spark.createDataFrame([("a", "xy"), ("b", "bad"), ("c", "boom")], "cache_key string, text string").repartition(3)
    got = {r.cache_key: r.vector for r in caches.embedded(rows, provider, 2, batch=1, retries=0).collect()}
    assert got == {"a": [2.0, 1.0], "b": None, "c": None}


def test_envelope_faults_of_a_stream(spark, tmp_path):
    """Two batches, so the state of a run is kept between them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parts = [[("a", 0, "started"), ("b", 0, "started")], [("a", 1, "completed"), ("a", 2, "progress"), ("b", 3, "progress")]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "run_id string, sequence long, type string").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema("run_id string, sequence long, type string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    query = events.envelope_faults(stream).writeStream.format("memory").queryName("faults").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    assert {tuple(r) for r in spark.table("faults").collect()} == {("a", 2, "after the end"), ("b", 3, "gap")}


def test_report(spark):
    from tomeforge.operators import grading
    from tomeforge.plans.experiments import trials

    rows = trials(spark, "/root/testdata/sf0.01")
    found = grading.report(rows, rows.select("trial", "condition"), "en", ["fr", "de"], 0.5, -9.0, iterations=50)
    assert found["gate"] == "pass" and {c["comparison"] for c in found["comparisons"]} == {"fr", "de"}
    assert all(c["low"] <= c["difference"] <= c["high"] for c in found["comparisons"])
    assert "# Verdict: pass" in grading.markdown(found)


def test_new_vectors_and_history_are_published(engine):
    """Also where no file has changed; vectors that are known stay when files change."""
    first = engine.index()
    texts = engine.store.table("chunks").select(F.sha2("text", 256).alias("input_hash")).distinct().collect()
    vectors = engine.spark.createDataFrame([(r.input_hash, [1.0, float(k)]) for k, r in enumerate(texts)], "input_hash string, vector array<float>")
    second = engine.index(embeddings=vectors)
    assert second["generation_id"] == first["generation_id"] + 1 and engine.check(require_vectors=True) == "ok"
    assert engine.index(embeddings=vectors) == second == engine.index()
    third = engine.index(history=engine.spark.createDataFrame([("r1", "message")], "revision_id string, message string"))
    assert third["generation_id"] == second["generation_id"] + 1 and engine.store.table("history").count() == 1
    engine.config.excludes.append("*.toml")
    engine.index()
    assert engine.check(require_vectors=True) == "ok" and engine.store.table("history").count() == 1


def test_ignore_files_and_errors(engine, tmp_path):
    (tmp_path / "src/.gitignore").write_text("# no plans\nplans/\n")
    (tmp_path / "src/src/.gitignore").write_text("util.ts\n")
    engine.store.fail("it broke")
    assert engine.status()["last_error"] == "it broke"
    engine.index()
    assert engine.status()["last_error"] is None
    assert {r.path for r in engine.store.table("files").collect()} == {"README.md", "src/main.ts", "testdata/README.md", "conf/a.toml"}
    assert engine.explain("src/util.ts")["rule"].source == "ignore:src"


def test_writers_take_numbers_of_their_own(spark, tmp_path):
    """A claim that was never published is passed over, and readers see the last published generation throughout."""
    store = Store(spark, str(tmp_path / "s"))
    tables = {"files": spark.createDataFrame([("p",)], "path string")}
    assert store._claim() == 1 and store.current() is None
    for k in range(4):
        assert store.publish(tables, {"manifest_hash": str(k), "config_fingerprint": "c"})["generation_id"] == k + 2
        assert store.current()["manifest_hash"] == str(k)
    assert store.generations() == [4, 5]


def rows_of(engine, name):
    df = engine.store.table(name)
    return sorted(map(str, df.select(*sorted(c for c in df.columns)).collect()))


ALL = ("files", "chunks", "symbols", "links", "refs", "postings")


def test_a_changed_file_rewrites_its_bucket_only(engine, tmp_path):
    """And everything is as a clean build has it: ids, references from files that did not change, and statistics."""
    from tomeforge.engine import bucket_of

    first = engine.index()
    assert first["outcome"] == {"new": 6, "changed": 0, "removed": 0, "unchanged": 0}
    bucket = lambda p: str(engine.spark.range(1).select(bucket_of(F.lit(p)).alias("b")).first().b)
    source = tmp_path / "src"

    def differs(after, before, name):
        return {b for b in {**after["parts"][name], **before["parts"][name]} if after["parts"][name].get(b) != before["parts"][name].get(b)}

    (source / "README.md").write_text("# Guide\n\nAnother valve.\n")
    second = engine.index()
    assert second["outcome"] == {"new": 0, "changed": 1, "removed": 0, "unchanged": 5}
    assert all(differs(second, first, n) <= {bucket("README.md")} for n in ALL) and differs(second, first, "chunks") == {bucket("README.md")}

    # what main.ts imports moves: its references change, though the file did not
    (source / "src/util.ts").write_text("// moved\n\n" + TREE["src/util.ts"])
    third = engine.index()
    assert differs(third, second, "chunks") == {bucket("src/util.ts")}
    assert differs(third, second, "refs") <= {bucket("src/util.ts"), bucket("src/main.ts")} and bucket("src/main.ts") in differs(third, second, "refs")
    (source / "src/util.ts").unlink()
    (source / "src/util").mkdir()
    (source / "src/util/index.ts").write_text(TREE["src/util.ts"])
    fourth = engine.index()
    assert fourth["outcome"] == {"new": 1, "changed": 0, "removed": 1, "unchanged": 5}

    fresh = Engine(engine.spark, engine.source, str(tmp_path / "clean"))
    clean = fresh.index()
    assert all(rows_of(fresh, n) == rows_of(engine, n) for n in ALL)
    assert (clean["chunks"], clean["mean_length"], clean["stats"]) == (fourth["chunks"], fourth["mean_length"], fourth["stats"])
    assert [r.asDict() for r in fresh.search("flux valve")[0].collect()] == [r.asDict() for r in engine.search("flux valve")[0].collect()]

    # tables that no kept generation names are gone, others stay
    needed = {(n, g) for r in (third, fourth) for n, part in r["parts"].items() for g in part.values()}
    have = {(p.parent.name, int(p.name.split("=")[1])) for p in (tmp_path / "store").glob("*/generation_id=*")}
    assert have == needed


def test_everything_goes_and_comes_back(engine, tmp_path):
    engine.index()
    for path in ("README.md", "docs/plans/next.md", "src/util.ts", "src/main.ts", "testdata/README.md", "conf/a.toml"):
        (tmp_path / "src" / path).unlink()
    gone = engine.index()
    assert gone["outcome"]["removed"] == 6 and gone["chunks"] == 0 and engine.store.table("chunks").count() == 0
    assert engine.search("flux")[0].count() == 0
    (tmp_path / "src/README.md").write_text(TREE["README.md"])
    assert engine.index()["outcome"]["new"] == 1 and engine.search("flux")[0].count() > 0


def test_a_build_that_died_is_swept(engine, tmp_path):
    engine.index()
    dead = engine.store._claim()
    engine.spark.range(1).write.parquet(str(tmp_path / f"store/chunks/generation_id={dead}/bucket=1"))
    (tmp_path / "src/README.md").write_text("# New\n")
    assert engine.index()["generation_id"] == dead + 1
    assert not (tmp_path / f"store/chunks/generation_id={dead}").exists() and not (tmp_path / f"store/claim-{dead}").exists()


def test_phrases_of_a_search(engine, tmp_path):
    """A cut term is a phrase: by positions, and across no border of fields."""
    (tmp_path / "src/docs/a.md").write_text("# A\n\nflux_valve and valve flux\n")
    (tmp_path / "src/docs/b.md").write_text("# B\n\nvalve, then flux\n")
    engine.index()
    assert {r.path for r in engine.search("flux_valve")[0].collect()} >= {"docs/a.md", "README.md"}
    assert "docs/b.md" not in {r.path for r in engine.search("flux_valve")[0].collect()}
    assert {r.path for r in engine.search("valve.then")[0].collect()} == {"docs/b.md"}


def test_forbidden_files_are_not_opened(spark, tmp_path):
    """By the scan's own count of files; names with spaces, signs and letters beyond ASCII are decided as they are."""
    names = {"a b.md": None, "é+ü%20.md": None, "x.txt": None, ".hidden": "unseen", "node_modules/i.js": "policy", "sub/secret.pem": "policy", "big.txt": "file_too_large"}
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (50 if name == "big.txt" else 5))
    given = policy.rules([], [])
    found = {r.path: r.skip for r in filesystem.intake(spark, str(tmp_path), given, 20).collect()}
    assert found == {n: s for n, s in names.items() if s != "unseen"}
    read = filesystem.intake(spark, str(tmp_path), given, 20).where("content_hash is not null").select("path", "text")
    assert read.count() == 3
    plan = read._jdf.queryExecution().executedPlan()
    read._jdf.collectToPython()
    files = [leaf.metrics().apply("numFiles").value() for leaf in map(plan.collectLeaves().apply, range(plan.collectLeaves().size())) if leaf.metrics().contains("numFiles")]
    assert files and max(files) <= 4  # the large one is left out by the reader itself


def test_exclusions_of_a_repository(engine, tmp_path):
    (tmp_path / "src/.git/info").mkdir(parents=True)
    (tmp_path / "src/.git/info/exclude").write_text("conf/\n*.ts\n")
    (tmp_path / "src/src/.gitignore").write_text("!main.ts\n")
    engine.index()
    assert {r.path for r in engine.store.table("files").collect()} == {"README.md", "docs/plans/next.md", "src/main.ts", "testdata/README.md"}


COMMITS = [(f"r{k:02d}", m, "Ann", 1000 + k, p, [k]) for k, (m, p) in enumerate([
    ("fix the flux valve (#1)", ["src/a.ts"]), ("flux flux flux", ["docs/b.md", "src/c.ts"]), ("valve of flux_valve", []), ("unrelated", ["src/flux.ts"]), (None, None), ("x" * 600 + " valve", ["z"]),
])]


def test_history_of_an_engine(engine):
    """Scores as SQLite has them over message, revision, paths and host; pages, filters, and history that stays."""
    import sqlite3

    engine.index()
    assert engine.history("flux")[1]["hits"] == 0 and engine.history("flux")[1]["lane"] == {"enabled": False, "items": 0}
    rows = engine.spark.createDataFrame(COMMITS, "revision_id string, message string, author string, committed_at_ms long, affected_paths array<string>, pr_hint array<int>")
    engine.index(history=rows)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(item_id UNINDEXED, revision_id, message, paths, host, tokenize = 'unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?, '')", [(r, r, m or "", " ".join(p or [])) for r, m, _, _, p, _ in COMMITS])
    for query in ("flux", "flux valve", "flux_valve", "r03", "src/a.ts", "valve"):
        match = " AND ".join("(" + " OR ".join(f'{f}:"{t}"' for f in ("message", "revision_id", "paths", "host")) + ")" for t in query.split())
        want = dict(db.execute("SELECT item_id, bm25(t) FROM t WHERE t MATCH ?", (match,)).fetchall())
        found, envelope = engine.history(query, size=20)
        assert {r.revision_id: r.score for r in found.collect()} == pytest.approx(want) and envelope["hits"] == len(want)
    assert {r.revision_id for r in engine.history("flux", path="src/*")[0].collect()} == {"r00", "r01", "r03"}
    assert max(len(r.message) for r in engine.history("valve")[0].collect()) == 501
    assert engine.history("")[1]["hits"] == 0 == engine.history("->")[1]["hits"]
    seen, cursor = [], None
    while cursor or not seen:
        page, envelope = engine.history("flux", size=2, cursor=cursor)
        seen, cursor = seen + [r.revision_id for r in page.collect()], envelope["next_cursor"]
    assert len(seen) == len(set(seen)) == 4
    with pytest.raises(ValueError):
        engine.history("valve", cursor=engine.history("flux", size=1)[1]["next_cursor"])
    engine.config.excludes.append("*.toml")
    engine.index()
    assert engine.history("flux", size=20)[1]["hits"] == 4  # taken over by the next generation


def test_related_within_a_budget(engine):
    engine.index()
    parts = engine.store.table("chunks").where("path = 'README.md' and parent_chunk_id is not null").first()
    chunk = parts.parent_chunk_id if parts else engine.store.table("chunks").where("path = 'src/main.ts' and symbol = 'flux'").first().chunk_id
    every = engine.related(chunk, budget=10**6).collect()
    assert every and [r["rank"] for r in every] == list(range(1, len(every) + 1))
    assert len(engine.related(chunk, budget=0).collect()) == 1  # the first always stays
    source = engine.store.table("chunks").where(F.col("chunk_id") == chunk).first()
    tokens = lambda s: -(-len(s) // 4)
    own = tokens(source.heading or source.path) + tokens(source.path) + 16
    for n in range(1, len(every) + 1):
        assert len(engine.related(chunk, budget=own + sum(r.tokens for r in every[:n])).collect()) == n
