"""The graph of symbols and references: edge resolution and neighbours, one hop at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import first_cover

# What is tried after a relative module name, in order.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def covering_chunk(points: DataFrame, chunks: DataFrame, line: str = "line") -> DataFrame:
    """``points`` (path, ref_id, line) with the first chunk, by ``ord``, whose lines cover it; null if none does."""
    return first_cover(points, chunks, ["path"], line, "line_start", "line_end", F.col("ord"), "chunk_id")


def local_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``refs`` (ref_id, path, name, line) with ``symbol_id``: the first same-named symbol declared at or above, else the first below.

    A declaration covers all lines from its own on. If none does, all are below, so the first of the name is meant.
    """
    named = symbols.select("path", "name", F.col("line_start").alias("declared"), F.lit((1 << 31) - 1).alias("forever"), "ord", "symbol_id")
    found = first_cover(refs, named, ["path", "name"], "line", "declared", "forever", F.col("ord"), "symbol_id").withColumnRenamed("symbol_id", "above")
    first = named.groupBy("path", "name").agg(F.min_by("symbol_id", F.struct("ord", "symbol_id")).alias("below"))
    out = found.join(first, ["path", "name"], "left").withColumn("symbol_id", F.coalesce("above", F.when(F.col("line").isNotNull(), F.col("below"))))
    return out.select(*refs.columns, "symbol_id")


def module_base(importer: Column, module: Column) -> Column:
    """The path a relative module name means, without an extension; null for other names."""
    start = F.slice(F.split(importer, "/"), 1, F.greatest(F.size(F.split(importer, "/")) - 1, F.lit(0)))

    def walk(at: Column, part: Column) -> Column:
        up = F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", at).otherwise(F.concat(at, F.array(part)))

    whole = F.array_join(F.aggregate(F.split(module, "/"), start, walk), "/")
    return F.when(F.startswith(module, F.lit(".")), whole)


def resolved_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (ref_id, path, module) with ``target``: the first candidate path that exists."""
    tries = F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(module_base(F.col("path"), F.col("module")), s))
    tried = imports.select("ref_id", F.posexplode(tries).alias("pos", "target"))
    found = tried.join(files.select(F.col("path").alias("target")).distinct(), "target")
    return imports.join(found.groupBy("ref_id").agg(F.min_by("target", "pos").alias("target")), "ref_id", "left")


def importers(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Files with an import that means, or could mean, one of ``paths``: what a change there may concern."""
    tries = F.transform(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.concat(module_base(F.col("path"), F.col("module")), s))
    tried = imports.select(F.col("path").alias("importer"), F.explode(tries).alias("path"))
    return tried.join(paths.select("path").distinct(), "path", "left_semi").select(F.col("importer").alias("path")).distinct()


def edges_out(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(chunk_id, target_chunk_id, kind, name): from a chunk's references to the chunks that declare what they mean."""
    to = symbols.select(F.col("symbol_id").alias("target_symbol_id"), F.col("chunk_id").alias("target_chunk_id"))
    out = refs.join(to, "target_symbol_id").where("chunk_id != target_chunk_id")
    return out.select("chunk_id", "target_chunk_id", "kind", "name")


def related(source: str, edges: DataFrame, parents: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    """Neighbours of a chunk by relation (references, referenced-by, children, parent), each chunk once, in order."""
    one = lambda df, c, rank, name: df.select(F.lit(rank).alias("kind_rank"), F.lit(name).alias("relation"), F.col(c).alias("chunk_id"))
    every = one(edges.where(F.col("chunk_id") == source), "target_chunk_id", 0, "references")
    every = every.unionByName(one(edges.where(F.col("target_chunk_id") == source), "chunk_id", 1, "referenced-by"))
    every = every.unionByName(one(parents.where(F.col("parent_chunk_id") == source), "chunk_id", 2, "children"))
    every = every.unionByName(one(parents.where((F.col("chunk_id") == source) & F.col("parent_chunk_id").isNotNull()), "parent_chunk_id", 3, "parent"))
    placed = every.where(F.col("chunk_id") != source).join(chunks.select("chunk_id", "path", "line_start"), "chunk_id")
    first = F.row_number().over(W.partitionBy("chunk_id").orderBy("kind_rank", "path", "line_start"))
    kept = placed.withColumn("first", first).where("first = 1").drop("first")
    return kept.orderBy("kind_rank", "path", "line_start", "chunk_id").limit(limit)
