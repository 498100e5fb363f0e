"""Generations: each build is checked, and made current by one rename; what did not change is not written again.

A writer claims its generation's number by a file that only one can create. What a generation writes is Parquet
under ``TABLE/generation_id=N/bucket=B``; of buckets that it takes over from the served generation it only keeps
the number that wrote them. Its pointer is a JSON file with those numbers and the tables' schemas, written aside
and renamed to a name that was not there before; the highest one is served. So a reader sees the old or the new
generation at every moment, also if the writer stops half-way, and what no pointer names is never read and is
swept by the next build. Pointers are read through the file system, without a Spark job.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGING_SECONDS = 7 * 86_400
TABLES = ("files", "chunks", "symbols", "links", "refs", "chunk_vec", "history", "history_postings", "postings")


class Store:
    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}".rstrip("/"))
        self._fs = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        if not self._fs.exists(self._path(name)):
            return None
        opened = self._fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
        finally:
            opened.close()

    def _put(self, path, value: dict) -> None:
        out = self._fs.create(path, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()

    def _point(self, number: int, value: dict) -> None:
        aside = self._path(f"aside-{uuid.uuid4().hex}")
        self._put(aside, value)
        if not self._fs.rename(aside, self._path(f"current-{number}.json")):
            raise OSError(f"could not publish generation {number}")

    def _numbers(self, prefix: str) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[len(prefix) :].split(".")[0]) for n in names if n.startswith(prefix))

    def _claim(self) -> int:
        """The next number, which no other writer has: only one can create its file."""
        number = max([0, *self._numbers("claim-"), *self._numbers("current-")])
        while True:
            number += 1
            if self._fs.createNewFile(self._path(f"claim-{number}")):
                return number

    def current(self) -> dict | None:
        """The record of the generation that is served."""
        pointers = self._numbers("current-")
        return self._read(f"current-{pointers[-1]}.json") if pointers else None

    def parts(self, name: str, record: dict | None = None) -> dict[str, int]:
        """By bucket, the generation that wrote it; empty for a table that there is not."""
        record = self.current() if record is None else record
        return (record or {}).get("parts", {}).get(name, {})

    def table(self, name: str, record: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of the served generation or of another record, whole or some of its buckets; with the column ``bucket``."""
        record = self.current() if record is None else record
        if record is None:
            raise LookupError("nothing is published")
        if name not in record["schemas"]:
            raise LookupError(f"there is no table {name!r}")
        wanted = {b: g for b, g in self.parts(name, record).items() if buckets is None or int(b) in buckets}
        schema = f"{record['schemas'][name]}, bucket int, generation_id int"
        if not wanted:
            return self.spark.createDataFrame([], schema).drop("generation_id")
        paths = [f"{self.root}/{name}/generation_id={g}/bucket={b}" for b, g in sorted(wanted.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths).drop("generation_id")

    def has(self, name: str) -> bool:
        return name in (self.current() or {}).get("schemas", {})

    def generations(self) -> list[int]:
        return self._numbers("current-")

    def _written(self, name: str, number: int) -> list[str]:
        """The buckets that a generation wrote of a table."""
        at = self._path(f"{name}/generation_id={number}")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return [n.split("=")[1] for n in names if n.startswith("bucket=")]

    def publish(self, tables: dict[str, DataFrame], record: dict, kept: dict[str, dict[str, int]] | None = None) -> dict:
        """Write what is new of the tables as the next generation, check it, flip the pointer, drop what none needs.

        ``tables`` have a column ``bucket``, or are one bucket; ``kept`` names by table the buckets that are taken over,
        with the generations that wrote them, as ``parts`` gives them. A record equal to the served one publishes
        nothing, so a replayed batch is harmless.
        """
        served = self.current()
        if served and all(served.get(k) == record.get(k) for k in ("manifest_hash", "config_fingerprint", "vectors", "history_head")):
            return served
        number, kept = self._claim(), kept or {}
        schemas = {n: s for n, s in (served or {}).get("schemas", {}).items() if n in kept}
        for name, df in tables.items():
            df = df if "bucket" in df.columns else df.withColumn("bucket", F.lit(0))
            df.write.partitionBy("bucket").parquet(f"{self.root}/{name}/generation_id={number}")
            schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "bucket")
        parts = {n: kept.get(n, {}) | dict.fromkeys(self._written(n, number), number) for n in {**kept, **tables}}
        record = record | {"generation_id": number, "built_at_ms": int(time.time() * 1000), "tables": sorted(parts), "parts": parts, "schemas": schemas}
        if broken := self.violations({n: self.table(n, record) for n in parts}):
            for name in tables:
                self._fs.delete(self._path(f"{name}/generation_id={number}"), True)
            self._fs.delete(self._path(f"claim-{number}"), False)
            raise ValueError(f"not published: {', '.join(broken)}")
        self._point(number, record)
        self.sweep()
        return record

    def staged(self, folder: str, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a build as they are settled, in a folder of its own: what follows reads them, and makes nothing of them twice."""
        rows.write.parquet(f"{self.root}/staging-{folder}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/staging-{folder}/{name}")

    def unstage(self, folder: str) -> None:
        self._fs.delete(self._path(f"staging-{folder}"), True)

    def sweep(self) -> None:
        """Delete old pointers, and what no pointer names: of old generations, and of builds that died.

        A build of a higher number than the served one may still run, so its tables stay; one of a lower
        number could not be served any more.
        """
        pointers = self._numbers("current-")
        for old in pointers[: -self.keep]:
            self._fs.delete(self._path(f"current-{old}.json"), False)
        needed = {(n, g, b) for k in pointers[-self.keep :] for n, part in self._read(f"current-{k}.json")["parts"].items() for b, g in part.items()}
        for name in TABLES:
            if not self._fs.exists(self._path(name)):
                continue
            numbers = [int(s.getPath().getName().split("=")[1]) for s in self._fs.listStatus(self._path(name)) if "=" in s.getPath().getName()]
            for g in [g for g in numbers if g <= pointers[-1]]:
                unused = [b for b in self._written(name, g) if (name, g, b) not in needed]
                if len(unused) == len(self._written(name, g)):
                    self._fs.delete(self._path(f"{name}/generation_id={g}"), True)
                else:
                    for b in unused:
                        self._fs.delete(self._path(f"{name}/generation_id={g}/bucket={b}"), True)
        for found in self._fs.listStatus(self._path("")):  # a build that is that old has died
            if found.getPath().getName().startswith("staging-") and found.getModificationTime() < (time.time() - STAGING_SECONDS) * 1000:
                self._fs.delete(found.getPath(), True)
        for number in self._numbers("claim-"):
            if number < pointers[-1]:
                self._fs.delete(self._path(f"claim-{number}"), False)

    @staticmethod
    def violations(tables: dict[str, DataFrame]) -> list[str]:
        """Names of reference checks that fail; each is an anti-join or a count of repeats."""
        out = []
        chunks = tables.get("chunks")
        if chunks is not None:
            if not chunks.groupBy("chunk_id").count().where("count > 1").isEmpty():
                out.append("chunk ids repeat")
            ids = chunks.select("chunk_id")
            for name, column in (("symbols", "chunk_id"), ("refs", "chunk_id"), ("chunk_vec", "chunk_id"), ("chunks", "parent_chunk_id")):
                if name in tables and column in tables[name].columns:
                    rows = tables[name].where(F.col(column).isNotNull()).select(F.col(column).alias("chunk_id"))
                    if not rows.join(ids, "chunk_id", "left_anti").isEmpty():
                        out.append(f"{name}.{column} without a chunk")
        if "refs" in tables and "symbols" in tables:
            targets = tables["refs"].where("target_symbol_id is not null").select(F.col("target_symbol_id").alias("symbol_id"))
            if not targets.join(tables["symbols"].select("symbol_id"), "symbol_id", "left_anti").isEmpty():
                out.append("refs.target_symbol_id without a symbol")
        if "chunk_vec" in tables:
            v = F.col("vector")
            good = (F.size(v) == F.col("dimension")) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            if not tables["chunk_vec"].where(~F.coalesce(good, F.lit(False))).isEmpty():
                out.append("vectors are not valid")
        return out

    def purge(self) -> None:
        """Everything of this store."""
        self._fs.delete(self._fs.makeQualified(self._path(".")), True)

    def fail(self, message: str | None) -> None:
        """Record the last error, or clear it."""
        self._put(self._path("last_error.json"), {"message": message, "at_ms": int(time.time() * 1000)})

    def last_error(self) -> str | None:
        return (self._read("last_error.json") or {}).get("message")
