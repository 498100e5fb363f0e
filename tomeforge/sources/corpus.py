"""The corpus adapter: tables of documents as files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per document."""
    path = F.format_string("%s/%s/doc_%06d.txt", "source", "lang", "doc_id").alias("path")
    return table(spark, sf_dir, "documents").select("doc_id", path, "source", "lang", F.coalesce("text", F.lit("")).alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """Each line that is not blank as ``body``, with its number ``line``, in place of ``text``."""
    held = [c for c in files.columns if c != "text"]
    cut = files.select(*held, F.posexplode(F.split("text", "\n", -1)).alias("at", "body")).where(F.trim("body") != "")
    return cut.select(*held, (F.col("at") + 1).cast("int").alias("line"), "body")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per line that is not blank, with its line number; the first line of a file is its heading."""
    cut = lines(files(spark, sf_dir).select("doc_id", "path", "text"))
    return cut.select(F.concat(F.col("doc_id"), F.lit(":"), F.col("line")).alias("chunk_id"), "doc_id", "path", "line", "body")


#: The same rows in SQL, for oracles: ``files`` and ``chunks``.
SQL = """
files AS (
  SELECT doc_id, printf('%s/%s/doc_%06d.txt', source, lang, doc_id) AS path, source, lang, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT doc_id, path, generate_subscripts(lines, 1) AS line, unnest(lines) AS body
  FROM (SELECT doc_id, path, string_split(text, chr(10)) AS lines FROM files)
), chunks AS (
  SELECT doc_id || ':' || line AS chunk_id, doc_id, path, CAST(line AS INTEGER) AS line, body FROM cut WHERE trim(body, ' ') <> ''
)"""
