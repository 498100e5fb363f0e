"""Keep a chunk index of a growing documents table, taking only what is new.

Each run reads the input files that are not older than the high-water mark, tells new and changed
documents from unchanged ones by their content, cuts those into chunks and writes them as a run of their
own:

    OUTPUT/files/run=K/            one row for each new or changed document, with the reason if it is left out
    OUTPUT/chunks/run=K/source=S/  the chunks of those that are taken
    OUTPUT/marks/run=K/            the mark: newest input time, settings, counts; written last

A run counts once its mark is there, so one that died is written over by the next under the same number,
and a rerun without new input writes nothing. ``current`` reads the index as it stands: of each document the
rows of its last run. Other settings make the next run read everything anew. A document is known by its id;
of several rows of one id the one of the newest file stays, and rows without an id are counted, not indexed.
Documents that disappear from the input stay, as files are only added.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from tomeforge.functions import text
from tomeforge.operators import policy, reconcile
from tomeforge.sources import corpus

log = logging.getLogger("refresh_index")

# Schemas are given, so that partition values keep their types.
FILES = "path string, content_hash string, parser_version string, state string, size long, skip string, run int"
CHUNKS = "chunk_id string, path string, lang string, line int, text string, tokens long, run int, source string"
MARK = "run int, newest long, settings string, read long, without_id long, new long, changed long, unchanged long, chunks long"
#: Documents whose ids are broadcast when the index is read.
FEW = 100_000


def marks(spark: SparkSession, output: str) -> DataFrame | None:
    return common.written(spark, f"{output}/marks", MARK, "json")


def last_mark(spark: SparkSession, output: str) -> dict | None:
    have = marks(spark, output)
    row = have.orderBy(F.desc("run")).first() if have is not None else None
    return row.asDict() if row else None


def finished(spark: SparkSession, path: str, schema: str, upto: int) -> DataFrame:
    """The rows of a table's finished runs; a partition is read or left out as a whole."""
    return spark.read.schema(schema).parquet(path).where(F.col("run") <= upto)


def latest(spark: SparkSession, output: str, upto: int) -> DataFrame:
    """(path, run, ...) of each document as its last run left it."""
    files = finished(spark, f"{output}/files", FILES, upto)
    rows = F.struct("run", *[c for c in files.columns if c not in ("path", "run")])
    return files.groupBy("path").agg(F.max_by(rows, "run").alias("r")).select("path", "r.*")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The chunks of the index as it stands."""
    mark = last_mark(spark, output)
    if mark is None:
        raise LookupError(f"no finished run in {output}")
    chunks = finished(spark, f"{output}/chunks", CHUNKS, mark["run"])
    if mark["run"] == 1:
        return chunks
    # only documents of several runs leave chunks behind; while they are few, the chunks need no shuffle
    runs = finished(spark, f"{output}/files", FILES, mark["run"]).groupBy(F.col("path").alias("redone")).agg(F.min("run").alias("first"), F.max("run").alias("last"))
    redone = runs.where("first < last").select("redone", "last")
    redone = F.broadcast(redone) if redone.count() <= FEW else redone
    return chunks.join(redone, (F.col("path") == F.col("redone")) & (F.col("run") < F.col("last")), "left_anti")


def run(spark: SparkSession, documents: str, output: str, config: dict) -> dict:
    """One run; returns its mark, or the last one's if nothing was new."""
    mark = last_mark(spark, output)
    wanted = json.dumps(config, sort_keys=True)
    since = mark["newest"] if mark and mark["settings"] == wanted else None

    given = spark.read.parquet(documents)
    changed = F.unix_micros(F.col("_metadata.file_modification_time")).alias("at")
    rows = given.select("doc_id", "text", "source", "lang", changed)
    if since is not None:
        # the reader leaves older files out; files of the mark's own moment are read again, as more may have come then
        rows = rows.where(F.col("_metadata.file_modification_time") >= F.timestamp_micros(F.lit(since)))
    body = F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat_ws("\0", F.coalesce("source", F.lit("\1")), F.coalesce("lang", F.lit("\1")), body), 256)
    size = F.octet_length(F.encode(body, "UTF-8")).cast("long")
    reason = F.when(F.coalesce("source", F.lit("")).isin(*config["excluded_sources"]), "policy").otherwise(
        policy.skip_reason(size, F.lit(True), F.coalesce(text.has_secret(body), F.lit(False)), config["max_bytes"])
    )
    rows = rows.select("*", F.col("doc_id").cast("string").alias("path"), digest.alias("content_hash"))
    # of each text a few numbers are kept, so that it is read once to decide and once more if it is taken
    seen = rows.select("path", "content_hash", "at", size.alias("size"), reason.alias("skip")).persist()
    try:
        counted = seen.agg(F.count("*").alias("read"), F.count_if(F.col("path").isNull()).alias("without_id"), F.max("at").alias("newest")).first()
        log.info("read %d rows of %s%s", counted["read"], documents, f", changed since {since}" if since is not None else "")
        if mark and counted["read"] == 0:
            return mark

        number = mark["run"] + 1 if mark else 1
        newest = F.max_by(F.struct("content_hash", "size", "skip"), F.struct("at", "content_hash")).alias("r")
        now = seen.where("path is not null").groupBy("path").agg(newest).select("path", "r.*").withColumn("parser_version", F.lit(config["parser"] + wanted))
        before = latest(spark, output, mark["run"]) if mark else now.limit(0)
        states = reconcile.reconciled(now, before.select("path", "content_hash", "parser_version")).where("state != 'removed'")
        tally = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
        if mark and not (tally.get("new", 0) or tally.get("changed", 0)) and mark["settings"] == wanted:
            log.info("%d documents are unchanged; nothing to write", tally.get("unchanged", 0))
            return mark if counted["newest"] == mark["newest"] else _put(spark, output, mark | {"newest": counted["newest"]})
        # what is decided is written first, and the chunks are made of what was written
        decided = now.join(states.where("state != 'unchanged'"), "path")
        decided.select(*[c.split()[0] for c in FILES.split(", ")[:-1]]).write.mode("overwrite").parquet(f"{output}/files/run={number}")
    finally:
        seen.unpersist()
    if counted["read"] - counted["without_id"] == tally.get("new", 0) + tally.get("changed", 0):
        # every id is there once and is to be written, so each row says itself whether it is taken
        taken = rows.where("path is not null").where(reason.isNull())
    else:
        wanted_hash = spark.read.schema(FILES).parquet(f"{output}/files/run={number}").where("skip is null").select("path", F.col("content_hash").alias("taken"))
        # rows of one id and content are alike, so it does not matter which one stays
        taken = rows.join(wanted_hash, "path").where("content_hash = taken").dropDuplicates(["path"])
    whole = taken.select("path", F.coalesce("source", F.lit("unknown")).alias("source"), "lang", body.alias("text"))
    # a large source is several files, a small one few; documents are dealt whole, as their chunks' ids would double what is shuffled
    dealt = whole.repartition("source", F.pmod(F.xxhash64("path"), F.lit(config["files_a_source"])))
    cut = corpus.lines(dealt)
    chunks = cut.select("path", "source", "lang", "line", F.concat(F.lit("line:"), "line").alias("address"), F.col("body").alias("text"))
    chunks = reconcile.chunk_ids(chunks, config["scope"], config["parser"]).withColumn("tokens", text.estimated_tokens(F.col("text"))).drop("address")
    chunks.write.mode("overwrite").option("compression", "zstd").partitionBy("source").parquet(f"{output}/chunks/run={number}")
    made = spark.read.schema(CHUNKS).parquet(f"{output}/chunks/run={number}").count()
    counts = {k: tally.get(k, 0) for k in ("new", "changed", "unchanged")}
    log.info("run %d: %s; %d chunks to %s", number, counts, made, output)
    newest = max(counted["newest"] or 0, since or 0)
    return _put(spark, output, {"run": number, "newest": newest, "settings": wanted, "read": counted["read"], "without_id": counted["without_id"], **counts, "chunks": made})


def _put(spark: SparkSession, output: str, mark: dict) -> dict:
    row = spark.createDataFrame([tuple(mark[c.split()[0]] for c in MARK.split(", "))], MARK)
    row.drop("run").coalesce(1).write.mode("overwrite").json(f"{output}/marks/run={mark['run']}")
    return mark


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents after two runs, the second of which finds nothing new."""
    output, config = common.new_folder(spark, "refresh_index"), common.settings("refresh_index")
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", output, config)
    columns = [F.col(c) for c in "chunk_id path source lang line tokens run".split()]
    return current(spark, output).select(*columns, F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, coalesce(source, 'unknown') AS source, lang, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
taken AS (SELECT * FROM d WHERE strlen(text) <= 1048576
  AND NOT regexp_matches(text, 'AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z_]{36}|github_pat_[0-9A-Za-z_]{22}|xoxb-[0-9A-Za-z-]{10}|xoxp-[0-9A-Za-z-]{10}|AIza[0-9A-Za-z_-]{35}')
  AND NOT (contains(text, '-----BEGIN') AND contains(text, 'PRIVATE KEY-----'))),
cut AS (SELECT path, source, lang, generate_subscripts(lines, 1) AS line, unnest(lines) AS body FROM (SELECT *, string_split(text, chr(10)) AS lines FROM taken))
SELECT 'chunk-' || sha256('documents' || chr(10) || 'lines-1' || chr(10) || path || chr(10) || 'line:' || line || chr(10) || sha256(body)) AS chunk_id, path, source, lang, CAST(line AS INTEGER) AS line,
  CAST((length(body) + 3) // 4 AS BIGINT) AS tokens, 1 AS run, sha256(body) AS text_sha256
FROM cut WHERE trim(body, ' ') <> ''
"""


if __name__ == "__main__":
    common.command("refresh_index", lambda spark, a, config: run(spark, a.documents, a.output, config), {"documents": "the documents table", "output": "the index, made or refreshed"})
