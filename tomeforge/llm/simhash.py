"""SimHash near-dedup by a segment-popcount embedding and a grid range-join.

Each 64-bit fingerprint is cut into 32 segments of two bits, and mapped to the vector of
their bit counts. The Manhattan distance of two such vectors is a lower bound of the
Hamming distance. The 32 coordinates form groups, more of them the more fingerprints there
are; if two vectors are within Manhattan distance d, all but d groups at least hold no
difference, so the two share a cell of one of the grids that choose so many groups. Cells are
joined by sorting, the bound filters, and the exact Hamming distance decides. Each cell yields
a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARKS, bounded_batches, checkpointed, connected_components, find, in_blocks, release, runs

EVEN = 0x5555555555555555
SEED = 42
SEGMENTS = 32
#: Chance that two random segments have the same bit count, and what a row in a grid costs against a comparison.
ALIKE, ROW_COST = 0.375, 100


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan_groups(n: int, max_distance: int) -> int:
    """Groups for which rows in grids and comparisons within cells of ``n`` random fingerprints cost least; any number is exact."""

    def cost(groups: int) -> float:
        kept = SEGMENTS * (groups - max_distance) / groups
        return math.comb(groups, max_distance) * (ROW_COST + n * ALIKE**kept)

    return min(range(max_distance + 2, max_distance + 9), key=cost)


def _masks(max_distance: int, groups: int) -> list[int]:
    """One mask for each choice of groups, as many as are alike at least at up to ``max_distance`` differences."""
    if not 0 <= max_distance < groups <= SEGMENTS:
        raise ValueError("max_distance must be from 0 to one less than the groups")
    bounds = [SEGMENTS * k // groups for k in range(groups + 1)]
    masks = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(bounds, bounds[1:])]
    return [sum(chosen) for chosen in combinations(masks, groups - max_distance)]


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """The XXH64 of each word shingle in order, repeats included; a text of fewer words is one shingle, none without words."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found))
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority(found: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 14):
        bits = np.unpackbits(found[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority of the bits of the XXH64 of each word shingle, repeats included; 0 without words."""
    return majority(hashes(text, shingle))


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) for each row; a null text counts as empty."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])
        release()

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return source.mapInArrow(apply, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def _forest(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[pa.RecordBatch]:
    """Links of each unit of a cell that join what is not joined yet."""
    for t in runs(batches, ["pair", "cell", "__i", "__j"]):
        keys = np.stack([t.column(k).to_numpy().astype(np.int64) for k in ("pair", "cell", "__i", "__j")])
        fp = t.column("fp").to_numpy().view(np.uint64)
        n = len(fp)
        end = np.flatnonzero(np.concatenate(((keys[:, 1:] != keys[:, :-1]).any(0), [True]))) + 1
        last = np.repeat(end, np.diff(np.concatenate(([0], end))))
        low = fp & np.uint64(EVEN), (fp >> np.uint64(1)) & np.uint64(EVEN)
        unary = (low[0] | low[1]) | ((low[0] & low[1]) << np.uint64(1))  # bit counts 0, 1, 2 as 00, 01, 11
        label = np.arange(n)
        parent: dict[int, int] = {}
        left, right = [], []
        at, d = np.arange(n), 0
        while True:
            d += 1
            at = at[at + d < last[at]]
            if not len(at):
                break
            b = at + d
            near = (label[at] != label[b]) & (np.bitwise_count(unary[at] ^ unary[b]) <= max_distance)
            x, y = at[near], b[near]
            exact = np.bitwise_count(fp[x] ^ fp[y]) <= max_distance
            x, y = x[exact], y[exact]
            for i, j in zip(x.tolist(), y.tolist()):
                p, q = find(parent, i), find(parent, j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    left.append(i)
                    right.append(j)
            if len(x):
                known = np.fromiter(parent, np.int64, len(parent))
                label[known] = [find(parent, i) for i in known.tolist()]
        signed = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[left]), pa.array(signed[right])], names=["a", "b"])


def linked(fps: DataFrame, max_distance: int = 4, most: int = 4096, groups: int | None = None) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints at up to ``max_distance`` bits."""
    groups = groups or plan_groups(fps.count(), max_distance)
    f = F.col("fp")
    odd = F.shiftrightunsigned(f, 1)
    unary = (f.bitwiseOR(odd).bitwiseAND(F.lit(EVEN))).bitwiseOR(F.shiftleft(f.bitwiseAND(odd).bitwiseAND(F.lit(EVEN)), 1))
    masks = F.array(*[F.lit(_signed(m)) for m in _masks(max_distance, groups)])
    cells = fps.select("fp", unary.alias("unary"), F.posexplode(masks).alias("pair", "mask"))
    cells = cells.select("pair", F.col("unary").bitwiseAND(F.col("mask")).alias("cell"), "fp")
    units = in_blocks(cells, ["pair", "cell"], F.xxhash64("fp", F.lit(1)), most).drop("__block")
    keys = ["pair", "cell", "__i", "__j"]
    units = units.repartition(*keys).sortWithinPartitions(*keys)
    return units.mapInArrow(lambda batches: _forest(batches, max_distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4, shingle: int = 4, most: int = 4096) -> DataFrame:
    """One row per input row: the id column, ``fingerprint`` (16 hex digits) and ``component_id``.

    component_id is the smallest id reachable over links of at most ``max_distance`` bits.
    Equal fingerprints are one class, so copies are never paired. Null and empty texts have
    fingerprint zero and link like any other; texts below ``shingle`` words are hashed whole.
    Null ids are kept but never name a component unless nothing else is in it. Repeated rows
    stay. Extra columns are not read. An empty table gives an empty result.
    """
    fps = checkpointed(with_fingerprints(docs, id_col, text_col, shingle))
    classes = fps.groupBy("fp").agg(F.min("id").alias("first"))
    parts = connected_components(linked(checkpointed(fps.select("fp").distinct()), max_distance, most))
    classes = classes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("component", "fp").alias("part"))
    classes = checkpointed(classes)
    # from a checkpoint, so that adaptive execution can split the join where one component has very many classes
    named = checkpointed(classes.groupBy("part").agg(F.min("first").alias("component_id")))
    return (
        fps.join(classes.select("fp", "part").join(named, "part"), "fp")
        .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups_of=near_duplicates, **options) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near duplicates: the one of the smallest id.

    ``groups_of`` is what names the groups, with its ``options``. Rows of one id are told apart by a digest of all their columns, and of rows alike in every
    column one stays. Groups whose ids are all null keep one row as well. ``docs`` is read again for
    the rows that stay. A broadcast of at most ``MARKS`` digests of the keys that go or are repeated says which
    rows stay for certain; only the texts of the others are shuffled, and their keys decide.
    """
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    digest = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest"))
    keyed = docs.select(key.alias("key"), *columns)
    text = f"c{docs.columns.index(text_col)}"
    groups = groups_of(keyed, "key", text, **options)
    keep = checkpointed(groups.groupBy("key").agg(F.count("*").alias("n"), F.bool_or(F.col("key") == F.col("component_id")).alias("stays")))
    mark = F.pmod(F.xxhash64("key"), F.lit(MARKS)).alias("__mark")
    marks = F.broadcast(keep.where("n > 1 or not stays").select(mark).distinct())
    marked = keyed.select("*", mark)
    others = marked.join(marks, "__mark", "left_semi").drop("__mark")
    kept = marked.join(marks, "__mark", "left_anti").drop("__mark").unionByName(others.join(keep.where("n = 1 and stays").select("key"), "key", "left_semi"))
    if not (again := keep.where("n > 1 and stays").select("key")).isEmpty():
        kept = kept.unionByName(others.join(again, "key", "left_semi").dropDuplicates(["key"]))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
