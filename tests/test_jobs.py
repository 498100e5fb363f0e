"""The jobs over growing input, after crashes, with other settings, and from their command line."""

import datetime
import glob
import hashlib
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import functions as F

from jobs import common, event_ledger, refresh_index

DOCS = "doc_id long, text string, source string, lang string, n_chars long, path string, line int, run int"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string, day string, batch long"


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)  # the next file is of a later moment


def doc(i, text, source="1", lang="en"):
    return (i, text, source, lang, 0, "clash", 7, 9)


def index_rows(spark, output):
    return sorted((r.path, r.source, r.lang, r.line, r.text, r.tokens) for r in refresh_index.current(spark, output).collect())


def plain_index(docs):
    out = []
    for i, text, source, lang in docs:
        for n, line in enumerate((text or "").split("\n"), 1):
            if line.strip(" "):
                out.append((str(i), source or "unknown", lang, n, line, -(-len(line) // 4)))
    return sorted(out)


@pytest.fixture
def config():
    return common.settings("refresh_index")


def test_index_takes_only_what_is_new(spark, tmp_path, config):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    add(spark, docs, [doc(1, "one\n\ntwo"), doc(2, None), doc(3, "three", None), doc(4, "é" * 9), doc(None, "no id"), doc(5, "key AKIA" + "A" * 16)], DOCS)
    first = refresh_index.run(spark, docs, out, config)
    assert (first["run"], first["read"], first["without_id"], first["new"], first["chunks"]) == (1, 6, 1, 5, 4)
    was = index_rows(spark, out)
    assert was == plain_index([(1, "one\n\ntwo", "1", "en"), (3, "three", None, "en"), (4, "é" * 9, "1", "en")])
    files = {f: os.path.getmtime(f) for f in glob.glob(f"{out}/*/run=1/**/*.parquet", recursive=True)}
    # the same again changes nothing
    assert refresh_index.run(spark, docs, out, config) == first
    assert index_rows(spark, out) == was and not os.path.exists(f"{out}/files/run=2")
    # a changed, a moved, a new and an unchanged document in a new file
    add(spark, docs, [doc(1, "one\nTWO"), doc(4, "é" * 9, "2"), doc(6, "six", "007"), doc(3, "three", None)], DOCS)
    second = refresh_index.run(spark, docs, out, config)
    assert (second["run"], second["new"], second["changed"], second["unchanged"]) == (2, 1, 2, 3)
    assert second["read"] == 6 + 4  # the file of the mark's moment is looked at again
    assert index_rows(spark, out) == plain_index([(1, "one\nTWO", "1", "en"), (3, "three", None, "en"), (4, "é" * 9, "2", "en"), (6, "six", "007", "en")])
    assert {f: os.path.getmtime(f) for f in files} == files  # what was written stays as it was
    add(spark, docs, [doc(7, "seven")], DOCS)
    assert refresh_index.run(spark, docs, out, config)["read"] == 4 + 1  # older files are left out
    assert spark.read.schema(refresh_index.FILES).parquet(f"{out}/files").where("skip = 'secret_content'").count() == 1


def test_increments_equal_one_run_over_all(spark, tmp_path, config, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    grown, out = f"{tmp_path}/grown", f"{tmp_path}/out"
    for part in range(3):
        docs.where(F.col("doc_id") % 3 == part).coalesce(2).write.mode("append").parquet(grown)
        time.sleep(0.02)
        mark = refresh_index.run(spark, grown, out, config)
        assert mark["run"] == part + 1 and mark["changed"] == 0
    refresh_index.run(spark, grown, f"{tmp_path}/whole", config)
    assert index_rows(spark, out) == index_rows(spark, f"{tmp_path}/whole")
    ids = lambda o: {r.chunk_id for r in refresh_index.current(spark, o).collect()}
    assert ids(out) == ids(f"{tmp_path}/whole")


def test_a_run_that_died_is_written_over(spark, tmp_path, config):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    add(spark, docs, [doc(1, "a"), doc(2, "b", "x")], DOCS)
    refresh_index.run(spark, docs, out, config)
    add(spark, docs, [doc(3, "c", "y")], DOCS)
    spark.createDataFrame([("junk",)], "text string").write.parquet(f"{out}/chunks/run=2/source=z")
    spark.createDataFrame([("1",)], "path string").write.parquet(f"{out}/files/run=2")
    assert index_rows(spark, out) == plain_index([(1, "a", "1", "en"), (2, "b", "x", "en")])  # no mark, no run
    refresh_index.run(spark, docs, out, config)
    assert index_rows(spark, out) == plain_index([(1, "a", "1", "en"), (2, "b", "x", "en"), (3, "c", "y", "en")])


def test_ties_repeats_settings_and_empty_input(spark, tmp_path, config):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    add(spark, docs, [], DOCS)
    assert refresh_index.run(spark, docs, out, config)["chunks"] == 0
    assert index_rows(spark, out) == []
    add(spark, docs, [doc(1, "old"), doc(1, "old"), doc(2, "same"), doc(2, "same")], DOCS)
    add(spark, docs, [doc(1, "new")], DOCS)
    refresh_index.run(spark, docs, out, config)
    assert index_rows(spark, out) == plain_index([(1, "new", "1", "en"), (2, "same", "1", "en")])
    mark = refresh_index.run(spark, docs, out, config | {"max_bytes": 3, "excluded_sources": ["q"]})
    assert mark["read"] == 5 and mark["changed"] == 2  # other settings read everything anew
    assert index_rows(spark, out) == plain_index([(1, "new", "1", "en")])


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    context = spark.sparkContext
    scala, jvm = context._jsc.sc(), context._jvm
    scala.listenerBus().waitUntilEmpty()
    stages = scala.statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_once(spark, tmp_path, config):
    """A first load shuffles its documents once, not their chunks; reading the index shuffles no chunks while few documents are of several runs."""
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    texts = {i: "\n".join(hashlib.sha256(f"{i} {k}".encode()).hexdigest() for k in range(300)) for i in range(1, 41)}
    add(spark, docs, [doc(i, t, str(i % 3)) for i, t in texts.items()] + [doc(None, "no id"), doc(41, "key AKIA" + "A" * 16)], DOCS)
    before = shuffled(spark)
    refresh_index.run(spark, docs, out, config)
    once = sum(map(len, texts.values())) // 2  # half a byte a hexadecimal digit, were it packed well
    assert 0 < shuffled(spark) - before < 3 * once
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        want = [(i, t, str(i % 3), "en") for i, t in texts.items()]
        assert index_rows(spark, out) == plain_index(want)
        assert "Join" not in refresh_index.current(spark, out)._jdf.queryExecution().toString()
        add(spark, docs, [doc(1, "one\nline"), doc(2, "key AKIA" + "A" * 16), doc(3, " "), doc(42, "new"), doc(42, "new")], DOCS)
        assert refresh_index.run(spark, docs, out, config)["run"] == 2
        assert index_rows(spark, out) == plain_index([(1, "one\nline", "1", "en"), (42, "new", "1", "en"), *want[3:]])
        assert "SortMergeJoin" not in refresh_index.current(spark, out)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def ledger_rows(spark, output):
    return sorted((tuple(map(str, r)) for r in event_ledger.ledger(spark, output).select("day", "user_id", "event_type", "events", "without_value", "total", "first_ts", "last_ts").collect()))


def event(i, day, user="1", kind="a", value=0.1, hour=1):
    at = day and datetime.datetime(2024, 1, day, hour, i % 60)
    return (i, at, user and int(user), kind, value, None, "x", 3)


def test_ledger_takes_each_file_once(spark, tmp_path):
    events, out, mark = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/mark"
    settings = common.settings("event_ledger") | {"files_a_batch": 1}
    first = [event(1, 1), event(2, 1, hour=5), event(3, 2, value=None), event(4, None, kind=None), event(5, 3, user=None, value=float("nan"))]
    add(spark, events, first, EVENTS)
    assert event_ledger.run(spark, events, out, mark, settings) == 4
    was = ledger_rows(spark, out)
    assert ("2024-01-01", "1", "a", "2", "0", "0.200000", "2024-01-01 01:01:00", "2024-01-01 05:02:00") in was
    assert ("2024-01-02", "1", "a", "1", "1", "0.000000", "2024-01-02 01:03:00", "2024-01-02 01:03:00") in was
    assert ("None", "1", "None", "1", "0", "0.100000", "None", "None") in was and len(was) == 4
    days = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{out}/ledger/*/*.parquet")}
    before = days()
    assert event_ledger.run(spark, events, out, mark, settings) == 0 and ledger_rows(spark, out) == was and days() == before
    add(spark, events, [event(6, 1, hour=0)], EVENTS)
    add(spark, events, [event(7, 1, hour=9), event(8, 4)], EVENTS)
    assert event_ledger.run(spark, events, out, mark, settings) == 2
    now = ledger_rows(spark, out)
    assert ("2024-01-01", "1", "a", "4", "0", "0.400000", "2024-01-01 00:06:00", "2024-01-01 09:07:00") in now and len(now) == 5
    assert all(f in days() for f in before if "day=2024-01-01" not in f)  # other days were not written again
    # a fold that died, and a batch that is replayed, change nothing
    spark.createDataFrame([("x",)], "note string").write.mode("overwrite").json(f"{out}/folded/batch=0")
    for f in glob.glob(f"{out}/folded/batch=[1-9]*/*"):
        os.remove(f)
    last = max(int(os.path.basename(f)) for f in glob.glob(f"{mark}/commits/[0-9]*"))
    for f in (f"{mark}/commits/{last}", f"{mark}/commits/.{last}.crc"):
        os.remove(f)
    event_ledger.run(spark, events, out, mark, settings)
    assert ledger_rows(spark, out) == now


def test_ledger_in_parts_equals_the_whole(spark, tmp_path, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    grown, settings = f"{tmp_path}/grown", common.settings("event_ledger")
    for part in range(2):
        events.where(F.col("event_id") % 2 == part).coalesce(2).write.mode("append").parquet(grown)
        event_ledger.run(spark, grown, f"{tmp_path}/out", f"{tmp_path}/mark", settings)
    event_ledger.run(spark, f"{sf}/events.parquet", f"{tmp_path}/out2", f"{tmp_path}/mark2", settings)
    assert ledger_rows(spark, f"{tmp_path}/out") == ledger_rows(spark, f"{tmp_path}/out2")


def test_command_line(spark, tmp_path, config):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    add(spark, docs, [doc(1, "from a command")], DOCS)
    over = tmp_path / "over.json"
    over.write_text('{"scope": "mine"}')
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-m", "jobs.refresh_index", "--documents", docs, "--output", out, "--config", str(over)], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "1 chunks" in done.stderr, done.stderr[-2000:]
    (row,) = refresh_index.current(spark, out).collect()
    body = hashlib.sha256(b"from a command").hexdigest()
    assert row.chunk_id == "chunk-" + hashlib.sha256("\n".join(["mine", "lines-1", "1", "line:1", body]).encode()).hexdigest()
    with pytest.raises(ValueError):
        over.write_text('{"colour": 1}')
        common.settings("refresh_index", str(over))
