"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is to be taken r times on average, r being the source's target over
its size. The whole copies in r are certain. For the rest, p = r - floor(r), documents are
ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), with u a hash of the
document, and taken from the front; one that does not fit in what is left of the source's words
is passed over, until no ranked document fits. One last place goes to the document, or to none,
whose size comes nearest to what is left.

A source may hold a third of all rows, so ranks are not sorted in one task: words are summed by
source and bin of rank, the bin where the target falls is found from those sums, and only that
bin is ranked row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, words

BINS = 1 << 12
#: Sources up to which their rules, some 200 bytes each, are broadcast; beyond, documents are shuffled by source.
BROADCAST_SOURCES = 10_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    Sources take ``weights`` in order of code point, null last, repeating, and share all words.
    A target above ``most`` times its source's size stops there, and the excess is shared by
    weight among the others, until none is above; if all stop, the excess is lost. Stopping is
    in order of most * size / weight, so the final share follows from running sums: the sources
    that stop are those whose quotient is below what the share would be with it still open.
    The order by code point numbers all sources in one task: rows there are sources, not documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    every, order = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    total, all_weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    share = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumns({"share": share, "quotient": F.col("cap") / F.col("weight")})
    # the first source in this order that does not stop sets the share of all that do not
    ranked = ranked.withColumn("open", F.min(F.when(F.col("quotient") >= F.col("share"), F.struct("quotient", "rank", "share"))).over(every)["share"])
    return ranked.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("open")), "cap").alias("target"))


def odds_of(key: Column, p: Column, seed: int) -> Column:
    """Random odds over inclusion odds, from a hash of the key; infinite where p is 0."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.when(p > 0, (u / (1 - u)) / (p / (1 - p))).otherwise(F.lit(float("inf")))


def bin_of(odds: Column) -> Column:
    """Equal steps of odds / (1 + odds), which maps the ranks onto (0, 1]."""
    return F.when(odds < float("inf"), F.floor(F.lit(BINS) * odds / (1 + odds))).otherwise(F.lit(BINS)).cast("int")


def place(odds: Column | str = "odds") -> Column:
    """Where a document stands in its source's order."""
    return F.struct((F.col(odds) if isinstance(odds, str) else odds).alias("odds"), F.col("id").alias("id"))


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def small(by_source: DataFrame) -> DataFrame:
    """A checkpointed table with a row per source, to be broadcast if it is measured to be small."""
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_SOURCES else by_source


def rules(rows: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """One row per source of ``rows`` (id, source, size): its target, and which of its documents get how many copies.

    A document gets ``certain`` copies, and one more if for one of ``taken`` its (odds, id) is
    between ``after`` and ``before`` and its size at most ``most``, or if its id is in ``last_ids``.
    """
    rates = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = rates.withColumn("certain", F.floor(rate + 1e-12)).withColumn("p", F.greatest(rate - F.col("certain"), F.lit(0.0)))
    rest = F.greatest(F.col("target") - F.col("certain") * F.col("source_size"), F.lit(0.0))
    rates = checkpointed(rates.withColumn("rest", rest).withColumnRenamed("source", "s"))

    ids = rows.schema["id"].dataType.simpleString()
    place_type = f"struct<odds:double,id:{ids}>"
    drawn = rows.where("size > 0").join(small(rates.select("s", "p")), same("source", "s")).where("p > 0").drop("s")
    drawn = drawn.withColumn("odds", odds_of(F.col("id"), F.col("p"), seed)).withColumn("bin", bin_of(F.col("odds")))
    drawn = checkpointed(drawn.select("source", "size", "bin", place().alias("place")))
    found = rates.withColumns({"left": F.col("rest"), "after": F.lit(None).cast(place_type), "open": F.col("p") > 0})
    found = checkpointed(found.withColumn("taken", F.array().cast(f"array<struct<after:{place_type},before:{place_type},most:double>>")))

    # each round takes what fits up to the first document that does not, passes over that one, and goes on after it
    while not (now := checkpointed(found.where("open").select("s", "left", "after"))).isEmpty():
        fit = drawn.join(small(now), same("source", "s")).where((F.col("size") <= F.col("left")) & (F.col("after").isNull() | (F.col("place") > F.col("after"))))
        bins = fit.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        run = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        bins = checkpointed(bins.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0))))
        edge = bins.where((F.col("before") <= F.col("left")) & (F.col("before") + F.col("words") > F.col("left")))
        edge = checkpointed(edge.select(F.col("source").alias("e"), F.col("bin").alias("edge"), "before"))

        # only the bin where the target falls is ranked row by row
        order = W.partitionBy("source").orderBy("place").rangeBetween(W.unboundedPreceding, 0)
        inside = fit.join(small(edge), same("source", "e") & (F.col("bin") == F.col("edge")))
        inside = inside.withColumn("upto", F.col("before") + F.sum("size").over(order))
        over = F.col("upto") > F.col("left")
        stop = inside.groupBy("source").agg(F.min(F.when(over, F.col("place"))).alias("stop"), F.max(F.when(~over, F.col("upto"))).alias("upto"), F.first("before").alias("before"))
        stop = stop.select(F.col("source").alias("c"), "stop", F.coalesce("upto", "before").alias("upto"))
        seen = bins.groupBy("source").agg(F.sum("words").alias("words")).withColumnRenamed("source", "b")
        got = F.coalesce("upto", "words", F.lit(0))
        one = F.array(F.struct("after", F.col("stop").alias("before"), F.col("left").alias("most")))
        found = found.join(seen, same("s", "b"), "left").join(stop, same("s", "c"), "left").select(
            "s", "source_size", "target", "certain", "p", "rest", (F.col("left") - got).alias("left"),
            F.when(got > 0, F.concat("taken", one)).otherwise(F.col("taken")).alias("taken"),
            F.coalesce("stop", "after").alias("after"), (F.col("open") & F.col("stop").isNotNull()).alias("open"),
        )
        found = checkpointed(found)

    # the last place: the document left over whose size is nearest to what is still missing, if nearer than none; it goes beyond
    found = found.drop("after", "open").withColumn("last_ids", F.array().cast(f"array<{ids}>"))
    off = F.abs(F.col("size") - F.col("left"))
    rest = with_copies(rows.where("size > 0"), found, seed).where((F.col("copies") == F.col("certain")) & (off < F.col("left")) & (F.col("p") > 0))
    last = rest.groupBy("source").agg(F.min(F.struct(off.alias("off"), "id")).alias("last")).select(F.col("source").alias("l"), F.array("last.id").alias("new"))
    more = F.coalesce("new", "last_ids")
    return checkpointed(found.join(last, same("s", "l"), "left").withColumn("last_ids", more).drop("l", "new"))


def with_copies(rows: DataFrame, found: DataFrame, seed: int) -> DataFrame:
    """``rows`` (id, source, size, and others) with their source's rule and ``copies``."""
    joined = rows.join(small(found), same("source", "s"), "left").drop("s")
    at = place(odds_of(F.col("id"), F.col("p"), seed))
    within = lambda t: (t["after"].isNull() | (at > t["after"])) & (t["before"].isNull() | (at < t["before"])) & (F.col("size") <= t["most"])
    taken = F.exists("taken", within) | F.exists("last_ids", lambda x: x.eqNullSafe(F.col("id")))
    return joined.withColumn("copies", F.col("certain") + F.coalesce(taken, F.lit(False)).cast("long")).drop("taken", "last_ids")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 11) -> DataFrame:
    """One row per input row: id, ``source``, ``size`` (words), ``source_size``, ``target``, ``copies``, ``taken`` (words, repeats counted).

    Null and empty texts have size 0 and take nothing. A null source is a source of its own,
    last in order. Ties in rank go by id; rows of one id and size are taken together, so reruns agree.
    No document is taken more than ``most`` times, rounded up. Extra columns are not read; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    rows = checkpointed(rows)
    out = with_copies(rows, rules(rows, weights, most, seed), seed)
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", "taken")


def resampled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, all columns, each as many times as the mix takes it.

    Texts are not shuffled unless there are too many sources for their rules to be broadcast,
    which adaptive execution decides by the rules' measured size.
    """
    source, text = F.col(f"c{docs.columns.index(source_col)}").cast("string"), F.col(f"c{docs.columns.index(text_col)}")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    found = rules(checkpointed(rows), weights, most, seed)
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    plain = plain.withColumns({"id": F.col(f"c{docs.columns.index(id_col)}"), "source": source, "size": F.size(words(text)).cast("long")})
    again = with_copies(plain.where(text.rlike(r"[^\x20\x09-\x0D]")), found, seed)
    again = again.where("copies > 0").withColumn("again", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
