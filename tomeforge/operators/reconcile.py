"""Identity, reconciliation, retention and coverage of index generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sha(*parts: Column, sep: str = "\n") -> Column:
    return F.sha2(F.concat_ws(sep, *parts), 256)


def manifest_hash(files: DataFrame) -> DataFrame:
    """One row: the hash of path, content hash and size of all files in path order.

    The order needs all entries of a snapshot in one string, some 100 bytes a file; texts are
    hashed where they are and never gathered.
    """
    entry = F.struct("path", F.concat("path", F.lit("\0"), "content_hash", F.lit("\0"), "size", F.lit("\0")).alias("line"))
    lines = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["line"])
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("manifest_hash"), F.count("*").alias("files"))


def chunk_ids(chunks: DataFrame, scope: str, parser: str) -> DataFrame:
    key = sha(F.lit(scope), F.lit(parser), F.col("path"), F.col("address"), F.sha2("text", 256))
    return chunks.withColumn("chunk_id", F.concat(F.lit("chunk-"), key))


def reconciled(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, state): unchanged, changed, new or removed, by path, content hash and parser version."""
    now = current.select("path", F.col("content_hash").alias("h1"), F.col("parser_version").alias("p1"), F.lit(True).alias("now"))
    was = previous.select("path", F.col("content_hash").alias("h0"), F.col("parser_version").alias("p0"), F.lit(True).alias("was"))
    same = F.col("h1").eqNullSafe(F.col("h0")) & F.col("p1").eqNullSafe(F.col("p0"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return now.join(was, "path", "full_outer").select("path", state.alias("state"))


def changed_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths whose content differs between two snapshots, sorted; each side holds a path once."""
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    both = a.select("path", F.col("content_hash").alias("a")).join(b.select("path", F.col("content_hash").alias("b")), "path", "full_outer")
    return both.where(differ).select("path").orderBy("path")


def latest(generations: DataFrame, keep: int = 2) -> DataFrame:
    """The newest generations of each worktree."""
    rank = F.row_number().over(W.partitionBy("repo_id", "worktree_id").orderBy(F.desc("generation_id")))
    return generations.withColumn("age", rank).where(F.col("age") <= keep)


def unreferenced(cache: DataFrame, referenced: DataFrame, cutoff: Column) -> DataFrame:
    """Cache entries made up to the cutoff that no generation refers to: those to delete."""
    return cache.where(F.col("created") <= cutoff).join(referenced, ["input_hash", "fingerprint"], "left_anti")


def newest_first(cache: DataFrame, most: int) -> DataFrame:
    """What stays of a bounded cache; ties by key."""
    return cache.orderBy(F.desc("mtime"), "key").limit(most)


def pending(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Paths with a chunk that has no vector."""
    return chunks.join(vectors, "chunk_id", "left_anti").select("path").distinct().orderBy("path")


def coverage(chunks: DataFrame, vectors: DataFrame, eligible: Column) -> DataFrame:
    """One row: total, eligible, vectors, pending and the level they make."""
    have = vectors.select("chunk_id").distinct().withColumn("has", F.lit(1))
    counted = chunks.join(have, "chunk_id", "left").agg(
        F.count("*").alias("total"), F.count_if(eligible).alias("eligible"), F.count("has").alias("vectors")
    )
    left = F.greatest(F.col("eligible") - F.col("vectors"), F.lit(0))
    level = F.when(F.col("vectors") == 0, "none").when(left > 0, "partial").otherwise("complete")
    return counted.withColumns({"pending": left, "level": level})


def freshness(mode: Column, served_mode: Column, manifest: Column, served_manifest: Column, config: Column, served_config: Column) -> Column:
    """(state, reasons): unknown without a served generation."""
    reasons = F.array_compact(F.array(
        F.when(~mode.eqNullSafe(served_mode), "mode"), F.when(~manifest.eqNullSafe(served_manifest), "manifest"), F.when(~config.eqNullSafe(served_config), "config")
    ))
    state = F.when(served_manifest.isNull(), "unknown").when(F.size(reasons) == 0, "fresh").otherwise("stale")
    return F.struct(state.alias("state"), reasons.alias("reasons"))


def embed_batches(chunks: DataFrame, order: str, size: int = 32, requests: int = 500, characters: int = 1_000_000) -> DataFrame:
    """``batch`` and ``sent``: what one build embeds, in order, within its request and character budgets.

    Only lengths are ranked, and only of the candidates that the request budget allows.
    """
    run = W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    cost = chunks.select("chunk_id", order, F.length("text").alias("chars"))
    # at most requests * size rows can be sent, so the window sees a bounded candidate list
    first = cost.orderBy(order).limit(requests * size)
    ranked = first.withColumn("batch", F.floor((F.row_number().over(W.orderBy(order)) - 1) / size)).withColumn("spent", F.sum("chars").over(run))
    return ranked.withColumn("sent", (F.col("spent") <= characters) & (F.col("batch") < requests))
