"""A Merkle manifest of a dataset: one root digest for all rows, and a proof for each.

A row is a leaf: the digest of its columns, each with its length, so no two rows read alike. The
leaves of a group stand in order of their id; every ``run`` consecutive nodes become one node of
the next level until one is left, and the groups' last nodes become one root in the same way.

Proofs are found by coordinates. Where a leaf's siblings stand follows from its index and its group's
size alone, so each leaf lists the coordinates (group, level, index) that it needs and joins the
table of nodes. Nodes near a root would be asked for by all leaves; so levels are taken six at a
time, a leaf asks within its own block of ``run`` ** 6 leaves, the block asks likewise for its
own levels above, and a leaf takes over its block's proof. No key of any join has more rows than
that block, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

#: Levels that are built and looked up together.
LEVELS = 6
#: Groups up to which their numbers, some 100 bytes each, are broadcast and their tree is one task's; beyond, both are shuffled.
BROADCAST_GROUPS = 10_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that fields can't run into each other; ``-`` if null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def joined(digests: Column) -> Column:
    """Digests one after the other."""
    return F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``at``, their place from 0 in that order, nulls first.

    Rows are dealt by range and sorted where they are; only the partitions' sizes are summed in one task.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = checkpointed(placed).withColumn("__part", F.shiftright("__id", 33))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.join(F.broadcast(sizes), "__part")  # a row a partition
    return out.withColumn("at", within + F.col("__before")).drop("__id", "__part", "__before")


def height(n: Column, run: int) -> Column:
    """Levels above ``n`` leaves."""
    powers = [run**k for k in range(64) if run**k < 1 << 63]
    return F.size(F.filter(F.array(*[F.lit(p) for p in powers]), lambda p: p < n))


def rising(nodes: DataFrame, run: int) -> list[DataFrame]:
    """Blocks (g, n, block, h, levels) of ever higher nodes, from ``nodes`` (g, n, i, digest): the materialised tables of nodes.

    ``levels`` are the nodes of the block's levels, its own up to the block's one node at last.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    size, out = run**LEVELS, []
    while most > 0:
        grouped = nodes.groupBy("g", "n", F.floor(F.col("i") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("rows"))
        grouped = grouped.withColumn("h", F.least(height(F.col("n"), run), F.lit(LEVELS)))
        of = lambda a, k: digest_of(hexed(joined(F.slice(a, k * run + 1, run))))
        up = lambda a: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / run).cast("int") - 1), lambda k: of(a, k))
        steps = F.filter(F.sequence(F.lit(1), F.lit(LEVELS)), lambda k: k <= F.col("h"))
        levels = F.aggregate(steps, F.array(F.transform("rows", lambda r: r["digest"])), lambda a, _: F.concat(a, F.array(up(F.element_at(a, -1)))))
        blocks = checkpointed(grouped.select("g", "n", "block", "h", levels.alias("levels")))
        out.append(blocks)
        if most <= size:
            break
        most = -(-most // size)
        nodes = blocks.select("g", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("i"), F.element_at("levels", -1)[0].alias("digest"))
    return out


def tops(blocks: DataFrame) -> DataFrame:
    """(g, digest): the one node of each group."""
    return blocks.select("g", F.element_at("levels", -1)[0].alias("digest"))


def own_paths(entries: DataFrame, blocks: DataFrame, run: int) -> DataFrame:
    """(g, n, i, path): what stands left and right of each entry on the levels of its block."""
    power = lambda k: F.get(F.array(*[F.lit(run**j) for j in range(LEVELS + 1)]), k)
    size = run**LEVELS
    at = lambda k: F.floor(F.col("i") / power(k))
    levels = F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: k < F.col("h"))

    def needed(k: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.lit(run - 1)), lambda j: F.floor(at(k) / run) * run + j)
        real = F.filter(every, lambda c: (c != at(k)) & (c < F.ceil(F.col("n") / power(k))))
        return F.transform(real, lambda c: F.struct(k.alias("level"), c.alias("at")))

    entries = entries.select("g", "n", "i").withColumn("h", F.least(height(F.col("n"), run), F.lit(LEVELS)))
    asked = entries.select("g", "n", "i", "h", F.explode_outer(F.flatten(F.transform(levels, needed))).alias("c"))
    asked = asked.select("g", "n", "i", "h", F.col("c.level").alias("level"), F.col("c.at").alias("at"))
    nodes = blocks.select("g", "block", F.posexplode(F.slice("levels", 1, F.col("h"))).alias("level", "digests"))
    nodes = nodes.select("g", "block", "level", F.posexplode("digests").alias("k", "digest"))
    nodes = nodes.select("g", "level", (F.col("block") * F.lit(size) / power(F.col("level")) + F.col("k")).cast("long").alias("at"), "digest")
    met = asked.join(nodes, ["g", "level", "at"], "left")
    found = met.groupBy("g", "n", "i", "h").agg(F.sort_array(F.collect_list(F.struct("level", "at", "digest"))).alias("s"))
    side = lambda k, mine: joined(F.transform(F.filter("s", lambda s: (s["level"] == k) & mine(s["at"])), lambda s: s["digest"]))
    path = F.transform(levels, lambda k: F.struct(side(k, lambda c: c < at(k)).alias("left"), side(k, lambda c: c > at(k)).alias("right")))
    return found.select("g", "n", "i", path.alias("path"))


def with_paths(entries: DataFrame, tiers: list[DataFrame], above: DataFrame, run: int) -> DataFrame:
    """``entries`` (g, n, i, ...) with ``path`` and the columns of ``above``, a row for each g whose ``path`` goes on from its one node."""
    size = run**LEVELS
    for k in range(len(tiers) - 1, -1, -1):
        at = entries
        if k:
            at = tiers[k - 1].select("g", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("i"))
        found = at.join(own_paths(at, tiers[k], run), ["g", "n", "i"])
        above = above.withColumnRenamed("path", "rest")
        if k == len(tiers) - 1:
            above = found.join(above, "g")
        else:
            found = found.withColumn("block", F.floor(F.col("i") / size))
            above = found.join(above.drop("n").withColumnRenamed("i", "block"), ["g", "block"]).drop("block")
        above = above.withColumn("path", F.concat("path", "rest")).drop("rest")
        if k:
            above = checkpointed(above)
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings make."""
    return F.aggregate(path, hexed(leaf), lambda a, p: F.sha2(F.concat(hexed(p["left"]), a, hexed(p["right"])), 256))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: hexed(F.concat(p["left"], p["right"]))), ""), 256)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = COLUMNS, found: dict[str, Column] | None = None, run: int = 3) -> DataFrame:
    """(id, ``leaf``, ``found_leaf``, ``subroot``, ``root``, ``path``): one row for each of ``docs``.

    ``found`` gives columns as they are found now, where they may differ from what the manifest is
    of; ``found_leaf`` is the leaf of those. ``path`` has for each level the siblings left and right
    of the row's node, up to the root; ``folded`` and ``proof_digest`` use it. Digests are binary.

    A null group is one of its own and the first; null ids come first in a group, and rows of equal
    id stand in order of their digest, so repeated rows, which are alike, have proofs of their own.
    Null and empty texts differ. A single leaf is its group's subroot, a single subroot the root, and
    a run of one node still is hashed anew. An empty table gives an empty result. Extra columns are
    not read. A text of any length is hashed where it is; only digests are shuffled.
    """
    leaf = lambda now: digest_of(F.concat(*[field(now.get(c, F.col(c))) for c in columns]))
    leaves = docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf({}).alias("leaf"), leaf(found or {}).alias("found_leaf"))
    leaves = numbered(checkpointed(leaves), "group", "id", "leaf", "found_leaf")
    groups = leaves.groupBy("group").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    groups = checkpointed(groups)
    few = (count := groups.count()) <= BROADCAST_GROUPS
    if few:
        groups = F.broadcast(groups.withColumn("g", (F.row_number().over(W.orderBy("group")) - 1).cast("long")))
    else:
        groups = checkpointed(numbered(groups, "group").withColumnRenamed("at", "g"))
    named = leaves.join(groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of")))
    leaves = checkpointed(named.select("id", "leaf", "found_leaf", "g", "n", (F.col("at") - F.col("start")).alias("i")))

    tiers = rising(leaves.select("g", "n", "i", F.col("leaf").alias("digest")), run)
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    if not tiers:
        out = leaves.select("*", F.lit(b"").alias("subroot"), F.lit(b"").alias("root"), none.alias("path"))
    else:
        # the groups' roots are the leaves of the last tree, which has one group
        subroots = tops(tiers[-1]).select(F.lit(0).cast("long").alias("g"), F.lit(count).cast("long").alias("n"), F.col("g").alias("i"), "digest")
        subroots = checkpointed(subroots.coalesce(1)) if few else subroots
        last = rising(subroots, run)
        root = tops(last[-1]).select("g", F.col("digest").alias("root"), none.alias("path"))
        above = with_paths(subroots, last, root, run).select(F.col("i").alias("g"), F.col("digest").alias("subroot"), "root", "path")
        out = with_paths(leaves, tiers, checkpointed(above), run)
    return out.select(F.col("id").alias(id_col), "leaf", "found_leaf", "subroot", "root", "path")
