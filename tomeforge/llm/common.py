"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import in_parts, pieces, running, with_value  # noqa: F401  # for the operators

#: A word is a run of characters other than ASCII white space; this class is that white space.
SPACE = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own(name: str) -> str:
    """A column name that no input column has."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session's spark.checkpoint.dir names it.

    Only where that is unset and the session runs on one machine, as in tests, a local folder is
    made; on a cluster its executors would lose what they write, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if context.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand texts to Python at most ``rows`` at a time, in this session, unless it says fewer.

    Spark's own bound in bytes is 64 MB a batch by default, and a worker holds a text several times over: as
    Arrow, as Python's string and as arrays of its words. The setting stays, as the query runs after this returns.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give memory that a finished task has freed back to the system; workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def words(text: Column) -> Column:
    """The words of a text, as an array; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup sorted Arrow batches so that no run of equal keys is cut.

    Holds one batch and the run that reaches beyond it, so the caller bounds the runs.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            values = batch.column(k).to_numpy(zero_copy_only=False)
            changed |= values[1:] != values[:-1]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cut = np.flatnonzero(changed)
        if len(cut):
            held.append(batch.slice(0, int(cut[-1]) + 1))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(cut[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def find(parent: dict, x):
    """The root of x in a union-find forest kept as a dictionary."""
    root = x
    while (up := parent.get(root, root)) != root:
        root = up
    while (up := parent.get(x, x)) != root:
        parent[x] = root
        x = up
    return root


def in_blocks(cells: DataFrame, keys: list[str], spread: Column, most: int) -> DataFrame:
    """Deal each key's rows into units of at most about 2 * ``most`` rows that cover all its pairs.

    A key with more than ``most`` rows is cut into blocks by ``spread``; each unit is a
    pair of blocks (``__i`` <= ``__j``), and a row goes to every unit of its block, so any
    two rows of a key meet in exactly one unit off the diagonal or in their block's own.
    Other keys are one unit. Adds ``__i``, ``__j`` and ``__block``. No row is dropped and
    no task gets an unbounded group; only the keys above the limit are shuffled, as counts.
    """
    large = cells.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    large = large.select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__blocks"))
    out = cells.join(large, keys, "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    out = out.withColumn("__block", F.pmod(spread, F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    out = out.select("*", other.alias("__other")).withColumns(
        {"__i": F.least("__block", "__other"), "__j": F.greatest("__block", "__other")}
    )
    return out.drop("__blocks", "__other")


#: Values of the filter that spares the shuffle of rows that are not wanted: one row each, so it is broadcast safely.
MARKS = 1 << 18


def wanted_rows(rows: DataFrame, key: str, wanted: DataFrame, named: str) -> DataFrame:
    """``rows`` joined to ``wanted`` where ``key`` equals its column ``named``, nulls alike.

    A broadcast of at most ``MARKS`` digests of the wanted keys drops most other rows before the shuffle
    while few are wanted; the join is exact whatever passes.
    """
    mark = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(MARKS))
    marks = F.broadcast(wanted.select(mark(named).alias("__mark")).distinct())
    return rows.withColumn("__mark", mark(key)).join(marks, "__mark", "left_semi").drop("__mark").join(wanted, F.col(key).eqNullSafe(F.col(named)))


#: Links that one task joins by itself. The number is fixed, so that no task grows with the input.
TOGETHER = 1 << 16


def _stars(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The links of a partition, ``most`` at a time, as stars: each node with the smallest one it is joined to by them."""

    def stars(parent: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([find(parent, x) for x in list(parent)], pa.int64())], names=["u", "v"])

    parent: dict = {}
    seen = 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if seen == most:
                yield stars(parent)
                parent, seen = {}, 0
            seen += 1
            p, q = find(parent, a), find(parent, b)
            if p != q:
                parent[max(p, q)] = min(p, q)
    yield stars(parent)


def connected_components(edges: DataFrame, most: int = TOGETHER) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), longs: the smallest node reachable.

    Links are first made stars, ``most`` at a time, within each partition and then within partitions put
    together to about that many. Links that are not more than that are done by then.
    Others alternate the large-star and small-star steps until the edges no longer change. Each
    step is a minimum a node (partially aggregated) and an equi-join, so a node with very
    many links is a skewed join that adaptive execution splits, never a collected group.
    The state is checkpointed each round. Self-links, repeats and nulls are ignored.
    """
    join = lambda batches: _stars(batches, most)
    links = checkpointed(edges.where(F.col("a") != F.col("b")).select("a", "b").mapInArrow(join, "u long, v long"))
    n = links.count()
    state = links.coalesce(max(1, -(-n // most))).mapInArrow(join, "u long, v long")
    state = checkpointed(state.distinct() if n > most else state)

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")), "u")

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    before = sign(state) if n > most else (0,)
    while before[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lowest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        found = lowest(large)
        small = found.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = checkpointed(small.unionByName(found.select("u", F.col("m").alias("v"))).distinct())
        after = sign(state)
        if after == before:
            break
        before = after
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
