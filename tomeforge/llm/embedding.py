"""Embedding near-dedup: sign hashing in several tables, exact cosines, connected components.

Vectors are hashed to the signs of random projections, ``bits`` to a table. Vectors that
share a bucket in any table are compared exactly, in double precision. A pair that meets in
several tables counts in the first only, which both rows can tell from their own signatures,
so links are counted and never listed. Equal vectors are one class with a multiplicity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, find, in_blocks, runs


def plan_tables(n: int, threshold: float, miss: float, bucket: int = 256) -> tuple[int, int]:
    """(bits, tables): buckets of about ``bucket`` random vectors, and a pair at the threshold missed with chance ``miss``."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / bucket)))) if n > bucket else 4
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def usable(v: Column) -> Column:
    """Whether a vector can link: no null or non-finite component and not all zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0), F.lit(False))


def _signatures(batches: Iterator[pa.RecordBatch], bits: int, tables: int, seed: int) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    weights = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        vectors = batch.column(2)
        sizes = np.diff(vectors.offsets.to_numpy())
        signs = np.zeros((batch.num_rows, tables), np.int32)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        for dim in np.unique(sizes):
            if dim not in planes:
                planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), tables * bits))
            rows = np.flatnonzero(sizes == dim)
            v = flat[starts[rows][:, None] + np.arange(dim)].astype(np.float64)
            v /= np.abs(v).max(1, keepdims=True)
            signs[rows] = ((v @ planes[dim]) > 0).reshape(len(rows), tables, bits) @ weights
        out = pa.ListArray.from_arrays(np.arange(0, signs.size + 1, tables, dtype=np.int32), pa.array(signs.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, out], names=["class", "copies", "vector", "signs"])


def _links(batches: Iterator[pa.RecordBatch], threshold: float, block: int = 2048) -> Iterator[pa.RecordBatch]:
    """(class, links, other): vectors linked in each unit, and links that join what is not joined yet."""
    keys = ["dim", "tbl", "bucket", "__i", "__j"]
    for t in runs(batches, keys):
        key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in keys])
        starts = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(0))))
        ids, copies, part = (t.column(k).to_numpy() for k in ("class", "copies", "__block"))
        vectors, signs = t.column("vector").combine_chunks(), t.column("signs").combine_chunks()
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        sign = signs.flatten().to_numpy().reshape(len(ids), -1)
        offsets = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
        found: dict[int, int] = {}
        parent: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            if b - a < 2:
                continue
            dim, tbl, _, i, j = key[:, a]
            v = flat[offsets[a] : offsets[b]].astype(np.float64).reshape(b - a, dim)
            unit = v / np.linalg.norm(v / (top := np.abs(v).max(1, keepdims=True)), axis=1, keepdims=True) / top
            for lo in range(0, b - a, block):
                for hi in range(lo, b - a, block):
                    x, y = np.nonzero(unit[lo : lo + block] @ unit[hi : hi + block].T >= threshold - 1e-9)
                    x, y = x + lo, y + hi
                    ok = x < y
                    if i != j:
                        ok &= part[a + x] != part[a + y]
                    x, y = x[ok], y[ok]
                    if tbl:
                        ok = ~(sign[a + x, :tbl] == sign[a + y, :tbl]).any(1)
                        x, y = x[ok], y[ok]
                    exact = (unit[x] * unit[y]).sum(1) >= threshold
                    x, y = x[exact] + a, y[exact] + a
                    if not len(x):
                        continue
                    ends, more = np.concatenate((x, y)), np.concatenate((copies[y], copies[x]))
                    near, at = np.unique(ends, return_inverse=True)
                    for k, m in zip(ids[near].tolist(), np.bincount(at, more).astype(np.int64).tolist()):
                        found[k] = found.get(k, 0) + m
                    for p, q in zip(ids[x].tolist(), ids[y].tolist()):
                        r, s = find(parent, p), find(parent, q)
                        if r != s:
                            parent[max(r, s)] = min(r, s)
                            edges.append((p, q))
        left = [*found, *(p for p, _ in edges)]
        count = [*found.values(), *[0] * len(edges)]
        other = [*[None] * len(found), *(q for _, q in edges)]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(count, pa.int64()), pa.array(other, pa.int64())], names=["class", "links", "other"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 1e-4, seed: int = 7, most: int = 4096) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id`` and ``kept``.

    Links are pairs of rows whose vectors have a cosine of at least ``threshold``, found with
    a chance of at least 1 - ``miss`` each, higher the closer they are; equal vectors always
    link. Null, zero and non-finite vectors link with nothing and are their own component;
    vectors of different lengths never link. Repeated ids are rows like any other. A null id
    names no component unless nothing else is in it. Extra columns are not read. An empty
    table gives an empty result. Class numbers are fixed by a checkpoint.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = rows.where(usable(F.col("vector")))
    classes = good.groupBy("vector").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("class"), "copies", "first", "vector"))
    bits, tables = plan_tables(classes.count(), threshold, miss)

    signed = classes.select("class", "copies", F.col("vector").cast("array<float>").alias("vector"))
    exact = classes.select(F.col("vector").cast("array<float>").cast("array<double>").alias("v"), "vector").where("v != vector").isEmpty()
    if not exact:
        signed = classes.select("class", "copies", "vector")
    kind = signed.schema["vector"].dataType.simpleString()
    signed = signed.mapInArrow(lambda b: _signatures(b, bits, tables, seed), f"class long, copies long, vector {kind}, signs array<int>")
    cells = signed.select("*", F.size("vector").alias("dim"), F.posexplode("signs").alias("tbl", "bucket"))
    keys = ["dim", "tbl", "bucket"]
    units = in_blocks(cells, keys, F.xxhash64("class", F.lit(1)), most)
    keys += ["__i", "__j"]
    units = units.repartition(*keys).sortWithinPartitions(*keys)
    found = checkpointed(units.mapInArrow(lambda b: _links(b, threshold), "class long, links long, other long"))

    links = found.where("other is null").groupBy("class").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    members = (
        classes.join(links, "class", "left")
        .join(parts, F.col("class") == F.col("node"), "left")
        .select("vector", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("part"))
    )
    named = members.groupBy("part").agg(F.min("first").alias("component_id"))
    linked = good.join(members.select("vector", "n_links", "part").join(named, "part"), "vector").select("id", "n_links", "component_id")
    alone = rows.where(~usable(F.col("vector"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
