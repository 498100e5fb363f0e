"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own: symbols, navigation bars, one word over and over, shouting,
boilerplate phrases, and missing end punctuation beside other signs. Failing lines are
removed; a document that loses too large a share of its words is rejected, and so is one that
fails the base rules on its whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, own, with_value, words

SYMBOLS = r"#*$%&|<>"
#: Phrases that mark a boilerplate line, in lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum",
    "log in to", "privacy policy", "read more", "sign up for", "subscribe to", "terms of service", "terms of use",
)


def repeat_words(w: Column) -> Column:
    """Words that stand in a three-word window found twice or more in the text.

    Windows are compared by their 64-bit digests, which are sorted with their places; places of
    digests with an equal neighbour are the repeated ones, and each covers three words.
    """
    last = F.size(w) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def places(s: Column) -> Column:
        same = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        each = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    found = with_value(with_value(F.sort_array(windows), places), covered)
    return F.when(last < 0, F.lit(0).cast("long")).otherwise(found)


def line_fails(line: Column, repeats: Column) -> Column:
    """Whether a line breaks a rule. Blank lines pass. ``repeats``: whether the text repeats windows at all.

    Rules that need counts stand behind a plain search for the signs they count.
    """
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    n_words = F.regexp_count(bare, F.lit(r"[^\x20\x09-\x0D]+"))

    def marked(counts: Column) -> Column:
        symbols = counts["symbols"] * 2 >= counts["words"]
        ragged = ~bare.rlike(r"[.!?:;…。！？\"'’”»)\]]$") & (counts["symbols"] > 0) & (counts["symbols"] * 8 >= counts["words"])
        return symbols | (counts["bars"] >= 3) | ragged

    signs = F.struct(
        n_words.alias("words"),
        F.regexp_count(bare, F.lit(f"[{SYMBOLS}]")).alias("symbols"),
        F.regexp_count(bare, F.lit(r"[|·»›]")).alias("bars"),
    )
    stutter = bare.rlike(r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D])){5}")
    shouting = ~bare.rlike(r"[a-zß-öø-ÿ]") & (F.upper(bare) == bare) & (F.lower(bare) != bare) & (n_words >= 3)
    boilerplate = (F.length(bare) <= 160) & F.lower(bare).rlike("|".join(BOILERPLATE))
    return (bare != "") & (shouting | boilerplate | (bare.rlike(f"[{SYMBOLS}·»›]") & with_value(signs, marked)) | (repeats & stutter))


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "base_failed", "kept")


def verdict(text: Column, max_loss: float, clean: bool) -> Column:
    """All measures of a text, and whether it is kept, as one struct; each value is bound once and then used.

    With ``clean``, also ``clean_text``: the text without its failing lines.
    """
    body = F.coalesce(text, F.lit(""))
    count = lambda a, x: a + F.when(x["bad"], F.size(words(x["line"]))).otherwise(0)
    with_words = lambda x: x.rlike(r"[^\x20\x09-\x0D]")

    def measured(w: Column, repeats: Column, lines: Column) -> Column:
        seen = F.transform(F.filter(lines, lambda x: with_words(x["line"])), lambda x: x["line"])
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            with_value(seen, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
            F.aggregate(lines, F.lit(0), count).cast("long").alias("n_lost_words"),
            *([F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("clean_text")] if clean else []),
        )

    def judged(m: Column) -> Column:
        base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
        kept = ~base & (m["n_lost_words"] <= max_loss * m["n_words"])
        names = FIELDS[:6] + (("clean_text",) if clean else ())
        return F.struct(*[m[n].alias(n) for n in names], base.alias("base_failed"), kept.alias("kept"))

    flagged = lambda r: F.transform(F.split(body, "\n", -1), lambda x: F.struct(x.alias("line"), line_fails(x, r >= 6).alias("bad")))
    whole = lambda w: with_value(repeat_words(w), lambda r: with_value(flagged(r), lambda lines: with_value(measured(w, r, lines), judged)))
    return with_value(words(body), whole)


def judged(docs: DataFrame, text_col: str = "text", max_loss: float = 0.4, clean: bool = False, only_kept: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``n_lost_words``, ``base_failed``, ``kept``.

    With ``clean``, also ``clean_text``: the text without its failing lines. With
    ``only_kept``, the rows that are kept. Null and empty texts have no words, so they fail
    the base rules. Rows are judged each for itself, in one pass without a shuffle; other
    columns pass through, but those of the names above are replaced. An empty table gives an
    empty result.
    """
    found = own("verdict")
    result = verdict(F.col(text_col), max_loss, clean)
    # a filter on the verdict would be pushed below it and judge each text twice; a generator judges once
    out = docs.withColumn(found, F.explode(F.filter(F.array(result), lambda v: v["kept"])) if only_kept else result)
    names = [*FIELDS, *(["clean_text"] if clean else [])]
    return out.withColumns({n: F.col(found)[n] for n in names}).drop(found)
