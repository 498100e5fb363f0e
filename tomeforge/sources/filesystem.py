"""Directories as sources: metadata first, content only of what the policy accepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, text
from ..operators import policy


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files under a root, paths relative; the content column is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(relative(F.col("path"), root).alias("path"), F.col("length").alias("size"))


def relative(path: Column, root: str) -> Column:
    """The part of a full path after the root, whatever scheme the reader puts before it."""
    tail = root.split("://", 1)[-1].rstrip("/") + "/"
    bare = F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    tail = tail if tail.startswith("/") else "/" + tail.split("/", 1)[-1]
    return F.when(F.startswith(bare, F.lit(tail)), F.substring(bare, F.lit(len(tail) + 1), F.length(bare)))


def contained(path: str) -> str:
    """A relative path, normalised; paths that leave the root are refused."""
    parts: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part == "..":
            raise ValueError(f"{path!r} leaves the root")
        if part not in ("", "."):
            parts.append(part)
    if path.startswith("/"):
        raise ValueError(f"{path!r} is not relative")
    return "/".join(parts)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def content_hash(spark: SparkSession, root: str, path: str) -> str | None:
    """The hash of one file's content, null if it is gone; no other file is looked at."""
    at, fs = _file_system(spark, f"{root}/{contained(path)}")
    if not fs.exists(at):
        return None
    return spark.read.format("binaryFile").load(f"{root}/{contained(path)}").select(F.sha2("content", 256).alias("h")).first().h


def ignore_files(spark: SparkSession, root: str, name: str = ".gitignore", most: int = 1 << 20) -> list[tuple[str, list[str]]]:
    """(directory, lines) of each ignore file; the readers pass hidden files over, so each directory with files is asked for its own.

    A repository's own list of exclusions comes first, so that the ignore files can say otherwise.
    Larger files than ``most`` bytes are refused, as none that people write is.
    """
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    found = inventory(spark, root).select(F.explode(F.transform(F.sequence(F.lit(0), F.size(F.split(parent, "/"))), lambda n: F.array_join(F.slice(F.split(parent, "/"), 1, n), "/"))).alias("base")).distinct()
    out = []
    at, fs = _file_system(spark, f"{root}/.git/info/exclude")
    if fs.exists(at):
        out.append(("", _lines(spark, fs, at, most)))
    for base in sorted({"", *(r.base for r in found.collect())}):  # directories, not files
        at, fs = _file_system(spark, "/".join(filter(None, [root, base, name])))
        if fs.exists(at):
            out.append((base, _lines(spark, fs, at, most)))
    return out


def _lines(spark: SparkSession, fs, at, most: int) -> list[str]:
    if fs.getFileStatus(at).getLen() > most:
        raise ValueError(f"{at} has more than {most} bytes")
    opened = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8").split("\n")
    finally:
        opened.close()


def intake(spark: SparkSession, root: str, rules: list[policy.Rule], most: int = 1 << 20) -> DataFrame:
    """Every file with the decision on it: ``skip`` is the reason it is left out, null for accepted ones.

    Size and policy are decided on metadata: by conditions on the file's path and size alone, with which Spark
    leaves files out before it opens any, so what the policy forbids is never read. ``text`` is null for files that are skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # the path in a file's metadata is written as in an address
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    files = files.withColumn("relative", relative(named, root))
    decided = files.withColumn("decision", policy.decision(F.col("relative"), rules))
    wanted = decided.where(F.col("decision.included") & (F.col("length") <= most))
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    reason = policy.skip_reason(F.col("length"), body.isNotNull(), F.coalesce(text.has_secret(body), F.lit(False)), most)
    read = wanted.select(F.col("relative").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("content_hash"), reason.alias("skip"), F.when(reason.isNull(), body).alias("text"))
    left = decided.where(~F.col("decision.included") | (F.col("length") > most))
    why = F.when(~F.col("decision.included"), "policy").otherwise("file_too_large")
    rest = left.select(F.col("relative").alias("path"), F.col("length").alias("size"), F.lit(None).cast("string").alias("content_hash"), why.alias("skip"), F.lit(None).cast("string").alias("text"))
    return read.unionByName(rest)


def classified(files: DataFrame) -> DataFrame:
    """Accepted files with language, role, lifecycle and where those come from."""
    rows = files.where("skip is null").withColumn("c", classify.classified(F.col("path"), F.col("text")))
    return rows.select(
        "path", "size", "content_hash", "text", classify.language(F.col("path")).alias("language"),
        F.col("c.role").alias("role"), F.col("c.lifecycle").alias("lifecycle"), F.col("c.source").alias("classification_source"),
    )
