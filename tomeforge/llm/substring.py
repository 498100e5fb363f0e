"""Substring dedup by hashing lines, sentences, runs of sentences, and windows of words.

Digests of passages with enough words are grouped over all documents, the occurrence of the
lowest rank stays, and the others are removed. By default passages are lines, runs of sentences,
and whatever of ``passages.WINDOW`` words or more is repeated, wherever it starts: of every such
window one anchor is chosen by its words alone, so a repeated window has a repeated anchor, and
only windows about those are hashed, and not those of whole copies. Every passage keeps its place in its original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, checkpoint_folder, checkpointed, own, pieces, release, running, runs, wanted_rows, with_value
from .passages import ANCHOR, WINDOW, Words

#: Where units end: zero-width, so the units of a text add up to it.
CUTS = {"line": r"(?<=\n)", "sentence": r"(?<=\n)|(?<=[.!?。！？])(?=[\x20\t])"}


def normalised(unit: Column) -> Column:
    """Lower case; runs of ASCII characters other than letters and digits, and of spaces, as one space."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{85}\x{A0}\x{2000}-\x{200B}\x{2028}\x{2029}\x{3000}]++", " "))


def units(docs: DataFrame, id_col: str, text_col: str, unit: str, min_words: int) -> DataFrame:
    """(id, start, end, n_words, d1, d2) of each unit of ``min_words`` words or more; places in code points, end exclusive."""
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), CUTS[unit], -1)
    array = "array<struct<start:int,end:int,norm:string>>"

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, F.length))
        each = lambda e: F.transform(p, lambda x, i: F.struct((F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), normalised(x).alias("norm")))
        return with_value(ends, each).cast(array)

    found = docs.select(F.col(id_col).alias("id"), F.explode(with_value(parts, placed)).alias("u")).select("id", "u.*")
    found = found.withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(F.size(F.split("norm", " "))))
    found = found.where(F.col("n_words") >= min_words)
    return found.select("id", "start", "end", "n_words", F.xxhash64("norm").alias("d1"), F.xxhash64(F.lit(7), F.col("norm")).alias("d2"))


def stored(rows: DataFrame) -> DataFrame:
    """Rows as a Parquet table in the shared folder, which is compressed, as a checkpoint is not."""
    path = f"{checkpoint_folder(rows.sparkSession)}/passages-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def later(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose digests stand at a lower (id, word) that does not overlap, with ``first``.

    A digest that very many rows have is aggregated before the shuffle. The join back reads that from a
    checkpoint: adaptive execution splits a large key only where both sides come straight from shuffles.
    """
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("id", "word", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    out = found.join(checkpointed(first.drop("n")), ["d1", "d2"])
    return out.where(~F.col("id").eqNullSafe(F.col("first.id")) | (F.col("word") >= F.col("first.word") + F.col("n_words")))


def ranges(w: Words, a: np.ndarray, b: np.ndarray, start=None, end=None) -> dict[str, np.ndarray]:
    """The places and digests of ranges of a text's words."""
    d1, d2 = w.digests(a, b)
    return {"word": a, "start": w.start[a] if start is None else start, "end": w.end[b - 1] if end is None else end, "n_words": b - a, "d1": d1, "d2": d2}


def listed(parts: list[dict[str, np.ndarray]], fields: dict[str, pa.DataType]) -> pa.ListArray:
    """A list of structs for each of ``parts``."""
    columns = [pa.array(np.concatenate([p[f] for p in parts]).astype(t.to_pandas_dtype()), t) if parts else pa.array([], t) for f, t in fields.items()]
    size = [len(next(iter(p.values()))) for p in parts]
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), pa.StructArray.from_arrays(columns, list(fields)))


UNIT = dict.fromkeys(("word", "start", "end", "n_words"), pa.int32()) | dict.fromkeys(("d1", "d2"), pa.int64())
ANCHOR_ROW = {"word": pa.int32(), "d": pa.int64()}


def named(fields: dict[str, pa.DataType]) -> str:
    return "array<struct<" + ",".join(f"{f}:{'int' if t == pa.int32() else 'long'}" for f, t in fields.items()) + ">>"


def own_windows(w: Words, at: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
    """The windows of the anchors ``at``, each window with its one anchor, in lists of windows in a row.

    A list has an anchor's digest ``d`` and its windows' own; places are the first window's, and differences of 16 bits
    to it. Neighbours of equal digest are one anchor, so words that repeat over and over are a few lists, not one each.
    """
    chosen = w.chosen()
    first = np.flatnonzero(np.isin(chosen, at))
    start, end = w.start[first], w.end[first + WINDOW - 1]
    digest = w.digests(chosen[first], chosen[first] + ANCHOR)[0]
    new = np.concatenate(([True], (np.diff(digest) != 0) | (np.diff(first) != 1)))[: len(first)]
    head = np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
    for place in (start, end):  # a list ends before a difference gets too large
        step = (place - place[head]) >> 14
        new[1:] |= np.diff(step) != 0
    far = np.maximum.accumulate(np.where(new, np.arange(len(first)), 0))
    lists = np.flatnonzero(new)
    anchor = chosen[first[lists]]
    return {
        "d": digest[lists], "hot": hot[np.searchsorted(at, anchor)], "word": first[lists], "start": start[lists], "end": end[lists],
        "size": np.diff(np.append(lists, len(first))), "digest": w.digests(first, first + WINDOW)[0], "starts": start - start[far], "ends": end - end[far],
    }


LISTS = ("digest", "starts", "ends")
OF_ANCHOR = {"d": pa.int64(), "hot": pa.bool_(), "word": pa.int32(), "start": pa.int32(), "end": pa.int32(), "digest": pa.int64(), "starts": pa.int16(), "ends": pa.int16()}


def first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lists of windows sorted by anchor, id and word: runs of windows that stand earlier as well, with where they do."""
    for t in runs(batches, ["d"]):
        size = pc.list_value_length(t.column("digest")).to_numpy()
        flat = {c: pc.list_flatten(t.column(c)).to_numpy() for c in LISTS}
        n = int(size.sum())
        of = np.repeat(np.arange(len(size)), size)
        nth = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        word = t.column("word").to_numpy()[of] + nth
        start, end = t.column("start").to_numpy()[of] + flat["starts"], t.column("end").to_numpy()[of] + flat["ends"]
        ids = t.column("id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()[of]
        d = t.column("d").to_numpy()[of]
        order = np.lexsort((flat["digest"], d))  # stable: of equal windows the earliest comes first
        new = np.concatenate(([True], (d[order][1:] != d[order][:-1]) | (flat["digest"][order][1:] != flat["digest"][order][:-1])))[:n]
        first = np.empty(n, np.int64)
        first[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        again = np.flatnonzero((ids != ids[first]) | (word >= word[first] + WINDOW))
        if not len(again):
            continue
        to = first[again]
        follows = (np.diff(again) == 1) & (of[again][1:] == of[again][:-1]) & (of[to][1:] == of[to][:-1])
        head = np.flatnonzero(np.concatenate(([True], ~follows)))
        tail = np.append(head[1:], len(again)) - 1
        a, b, x = again[head], again[tail], to[head]
        take = lambda c, i: t.column(c).combine_chunks().take(pa.array(of[i]))
        numbers = [pa.array(v.astype(np.int32)) for v in (word[a], word[b], start[a], end[b], word[x], start[x])]
        yield pa.RecordBatch.from_arrays([take("row", a), take("id", a), take("id", x), *numbers], names=["row", "id", "first_id", "word", "last", "start", "end", "first_word", "first_start"])


def hot_windows(lists: DataFrame) -> DataFrame:
    """What ``first_windows`` finds, for anchors that stand very often, without bringing one anchor's lists together.

    Equal lists are one class, which its earliest stands for; windows are compared between classes.
    """
    same = [F.xxhash64("digest").alias("h1"), F.xxhash64(F.lit(7), "digest").alias("h2")]
    lists = lists.withColumns({"h1": same[0], "h2": same[1]})
    classes = lists.groupBy("d", "h1", "h2").agg(F.min(F.struct("id", "word", "start", "starts", "digest")).alias("rep")).select("d", "h1", "h2", "rep.*")
    classes = checkpointed(classes)
    each = classes.select("*", F.explode(F.array_distinct("digest")).alias("x")).withColumn("k", (F.array_position("digest", F.col("x")) - 1).cast("int"))
    at = F.struct("id", (F.col("word") + F.col("k")).alias("word"), (F.col("start") + F.get("starts", F.col("k"))).alias("start"), F.col("word").alias("list"))
    each = checkpointed(each.select("d", "h1", "h2", F.col("x").alias("digest"), at.alias("at")))
    first = checkpointed(each.groupBy("d", "digest").agg(F.min("at").alias("first")))
    # neighbours of one anchor repeat their words, so a list has some fifty different windows at most
    firsts = each.join(first, ["d", "digest"]).groupBy("d", "h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("digest", "first"))).alias("firsts"))

    def cut(f: Column) -> Column:
        """Runs of windows whose first ones stand in one list."""
        new = lambda k: (k == 0) | ~(F.get(f, k)["id"].eqNullSafe(F.get(f, k - 1)["id"]) & (F.get(f, k)["list"] == F.get(f, k - 1)["list"]))
        heads = F.filter(F.sequence(F.lit(0), F.size(f) - 1), new)
        run = lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.array_min(F.slice(f, a + 1, b - a + 1)).alias("first"), F.transform(F.slice(f, a + 1, b - a + 1), lambda x: x["word"]).alias("words"))
        return with_value(heads, lambda h: F.transform(h, lambda a, i: run(a, F.coalesce(F.get(h, i + 1), F.size(f)) - 1)))

    known = classes.select("d", "h1", "h2", "digest").join(firsts, ["d", "h1", "h2"])
    known = checkpointed(known.select("d", "h1", "h2", with_value(F.transform("digest", lambda x: F.col("firsts")[x]), cut).alias("runs")))
    out = lists.join(known, ["d", "h1", "h2"]).withColumn("r", F.explode("runs"))
    # in the text where the first ones stand, each window counts for itself, where it does not overlap its first
    own = F.col("id").eqNullSafe(F.col("r.first.id"))
    each = out.where(own).select("*", F.posexplode("r.words").alias("i", "f")).where(F.col("word") + F.col("r.a") + F.col("i") >= F.col("f") + WINDOW)
    each = each.withColumns({"a": F.col("r.a") + F.col("i"), "b": F.col("r.a") + F.col("i")}).drop("i", "f")
    out = out.where(~own).withColumns({"a": F.col("r.a"), "b": F.col("r.b")}).unionByName(each)
    place = lambda c, k: F.col(c) + F.get(f"{c}s", F.col(k))
    return out.select("row", "id", F.col("r.first.id").alias("first_id"), (F.col("word") + F.col("a")).alias("word"), (F.col("word") + F.col("b")).alias("last"), place("start", "a").alias("start"), place("end", "b").alias("end"), F.col("r.first.word").alias("first_word"), F.col("r.first.start").alias("first_start"))


def repeated_windows(lists: DataFrame, kind: str) -> DataFrame:
    """Ranges of windows that stand earlier as well, from rows of ``own_windows``; ranges that overlap at one distance, or in one text, are one."""
    cold = lists.where("not hot").drop("hot").repartition("d").sortWithinPartitions("d", "id", "word", "row")
    found = cold.mapInArrow(first_windows, f"row long, id {kind}, first_id {kind}, word int, last int, start int, end int, first_word int, first_start int")
    if not (hot := lists.where("hot")).isEmpty():
        found = found.unionByName(hot_windows(hot))
    by = F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("word") - F.col("first_word")).otherwise(0)
    found = found.withColumn("by", by)
    line = W.partitionBy("row", "first_id", "by").orderBy("word")
    before = F.max("last").over(line.rowsBetween(W.unboundedPreceding, -1))
    found = found.withColumn("new", F.coalesce(F.col("word") > before + WINDOW, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(line))
    return found.groupBy("row", "id", "first_id", "by", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("last") - F.min("word") + WINDOW).cast("int").alias("n_words"), F.min("first_start").alias("first_start")
    )


def repeated_passages(docs: DataFrame, id_col: str, text_col: str, sentences: bool, min_words: int, most: int = 4096) -> DataFrame:
    """``repeats`` of lines, of runs of sentences if asked, and of windows; an anchor that stands over ``most`` times is hot."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    whole_text = lambda w: (np.array([0]), np.array([w.n]))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, size, wholes, units, anchors = [], [], [], [], [], []
            for i, x in enumerate(batch.column(1)):
                if not (w := Words(x.as_py())).n:
                    continue
                row.append(i)
                n.append(w.n)
                size.append(w.size)
                wholes.append([int(d[0]) for d in w.digests(*whole_text(w))])
                units.append(ranges(w, *w.units(min_words, sentences)))
                at = w.anchors()
                anchors.append({"word": at, "d": w.digests(at, at + ANCHOR)[0]})
            d1, d2 = (pa.array([d[k] for d in wholes], pa.int64()) for k in (0, 1))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), d1, d2, pa.array(n, pa.int32()), pa.array(size, pa.int32()), listed(units, UNIT), listed(anchors, ANCHOR_ROW)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "d1", "d2", "n_words", "end", "units", "anchors"])
        release()

    def window_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = [], []
            for i, (x, d1, at, hot) in enumerate(zip(*batch.columns[2:])):
                w = Words(x.as_py())
                if w.n >= WINDOW and int(w.digests(*whole_text(w))[0][0]) == d1.as_py():
                    word = np.array(at.as_py(), np.int64)
                    order = np.argsort(word)
                    parts.append(own_windows(w, word[order], np.array(hot.as_py(), bool)[order]))
                    rows.append(np.full(len(parts[-1]["d"]), i))
            if not parts:
                continue
            join = lambda k: np.concatenate([p[k] for p in parts])
            offsets = np.concatenate(([0], np.cumsum(join("size")))).astype(np.int32)
            made = {k: pa.array(join(k).astype(v.to_pandas_dtype()), v) for k, v in OF_ANCHOR.items()}
            made |= {k: pa.ListArray.from_arrays(offsets, made[k]) for k in LISTS}
            rows = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *made.values()], names=["row", "id", *made])
        release()

    found = source.mapInArrow(first_pass, f"id {kind}, d1 long, d2 long, n_words int, end int, units {named(UNIT)}, anchors {named(ANCHOR_ROW)}")
    found = stored(found.withColumn("row", F.monotonically_increasing_id()))
    places = ("id", "start", "end", "n_words", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))
    units = later(found.select("id", F.explode("units").alias("u")).select("id", "u.*")).select(*places)
    wholes = found.where(F.col("n_words") >= min(min_words, WINDOW)).select("row", "id", "d1", "d2", "n_words", "end", F.lit(0).alias("word"), F.lit(0).alias("start"))
    copies = checkpointed(later(wholes))

    # windows of copies of whole texts need no search: the copy is one passage
    originals = found.where(F.size("anchors") > 0).select("row", "anchors").join(copies.select("row"), "row", "left_anti")
    anchors = originals.select("row", F.explode("anchors").alias("a")).select("row", F.col("a.word").alias("word"), F.col("a.d").alias("d"))
    again = checkpointed(anchors.groupBy("d").agg(F.count("*").alias("times")).where("times > 1").select("d", (F.col("times") > most).alias("hot")))
    near = anchors.join(again, "d").groupBy("row").agg(F.collect_list(F.struct("word", "hot")).alias("at"))
    near = checkpointed(found.select("row", F.col("id").alias("n"), "d1").join(near, "row"))
    texts = wanted_rows(source, "id", near, "n").select("row", "id", "text", "d1", F.col("at.word").alias("at"), F.col("at.hot").alias("hot"))
    schema = f"row long, id {kind}, d long, hot boolean, word int, start int, end int, digest array<long>, starts array<smallint>, ends array<smallint>"
    lists = stored(texts.mapInArrow(window_pass, schema))
    out = units.unionByName(copies.select(*places)).unionByName(repeated_windows(lists, kind).select("id", "start", "end", "n_words", "first_id", "first_start"))
    return out.withColumnRenamed("id", id_col)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "passage", min_words: int = 8) -> DataFrame:
    """One row per unit to remove: id, ``start``, ``end``, ``n_words``, ``first_id``, ``first_start``.

    ``unit`` is "line", "sentence", "line_or_window" (lines, and windows of words wherever they
    start) or "passage" (runs of sentences as well); the rows of the last two may overlap.
    The unit that stays is the one of the lowest (id, start), nulls first. Units below
    ``min_words`` words are never removed, nor are null and empty texts. Rows of one id count
    as one document, so a repeated row removes nothing from itself. Extra columns are not
    read; an empty table gives an empty result. A digest that a third of all rows hold is
    pre-aggregated before the shuffle, and its join is split by adaptive execution.
    """
    if unit in ("passage", "line_or_window"):
        return repeated_passages(docs, id_col, text_col, unit == "passage", min_words)
    found = checkpointed(units(docs, id_col, text_col, unit, min_words))
    place = F.struct("id", "start")
    first = found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    out = found.join(first.select("d1", "d2", "first"), ["d1", "d2"]).where(place != F.col("first"))
    return out.select(F.col("id").alias(id_col), "start", "end", "n_words", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "passage", min_words: int = 8) -> DataFrame:
    """``docs`` with repeated units cut from the text, and ``kept_spans``: (start, end) of what is left, in the original text.

    A null text stays null, and it and an empty one have no spans. Extra columns stay as they are; an empty table gives an empty result.
    """
    spans, source = own("spans"), own("source")
    gone = repeats(docs, id_col, text_col, unit, min_words)
    gone = gone.groupBy(F.col(id_col).alias(source)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(spans))
    text = F.coalesce(F.col(text_col), F.lit(""))

    def left(s: Column) -> Column:
        """What stands between each span's start and the end of all before it."""
        since = lambda ends, i: F.coalesce(F.get(ends, i - 1), F.lit(0))
        between = lambda ends: F.transform(s, lambda x, i: F.struct(since(ends, i).alias("start"), x["start"].alias("end")))
        return F.filter(with_value(running(F.transform(s, lambda x: x["end"]), F.greatest), between), lambda x: x["end"] > x["start"])

    tail = F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end")))
    kept = with_value(F.concat(F.coalesce(F.col(spans), F.array().cast("array<struct<start:int,end:int>>")), tail), left)
    out = docs.join(gone, F.col(id_col).eqNullSafe(F.col(source)), "left").withColumn("kept_spans", kept)
    cut = F.array_join(pieces(text, F.transform("kept_spans", lambda s: F.struct(s["start"].alias("start"), (s["end"] - s["start"]).alias("length")))), "")
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), cut)).select(*docs.columns, "kept_spans")
