"""License scans: fuzzy search for short notices.

A notice may differ from a text by a few edits. By the pigeonhole principle, a notice cut
into one part more than the edits allowed has a part that stands in the text unchanged. So
exact seeds, found by one automaton pass, locate candidates, and only those windows go to
bounded-error matching, which verifies the edits and says where the notice stands.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases found exactly, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices found with edits, as lower-case words, with their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache-2"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)


def edits_for(notice: str, share: float) -> int:
    return max(1, int(len(notice) * share))


@lru_cache(4)
def compiled(notices: tuple, share: float):
    """The automaton of seeds, and for each notice its bounded-error pattern, edits and label."""
    import ahocorasick
    import regex

    seeds: dict[str, list] = {}
    patterns = []
    for i, (notice, label) in enumerate(notices):
        k = edits_for(notice, share)
        cuts = [len(notice) * j // (k + 1) for j in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            seeds.setdefault(notice[a:b], []).append((i, a))
        patterns.append((regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}"), k, label, len(notice)))
    automaton = ahocorasick.Automaton()
    for seed, where in seeds.items():
        automaton.add_word(seed, (len(seed), where))
    automaton.make_automaton()
    return automaton, patterns


class Places:
    """Intervals as a union of disjoint ones."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i, j = bisect.bisect_right(self.ends, a), bisect.bisect_left(self.starts, b)
        if i < j:
            a, b = min(a, self.starts[i]), max(b, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [a], [b]


def every(pattern, line: str, a: int, b: int, most: int) -> list[tuple[int, int, int]]:
    """(edits, start, end): the best match of a window, then those of what stands before and after it.

    The best match is looked for in the whole window each time, so a window longer than 8 * ``most``
    is cut into ones that overlap by ``most``; of matches that overlap the one with fewer edits stays.
    """
    found = set()
    cut = range(a, max(a + 1, b - most), 7 * most) if b - a > 8 * most else [a]
    for lo in cut:
        todo = [(lo, min(b, lo + 8 * most))]
        while todo:
            x, y = todo.pop()
            if m := pattern.search(line, x, y):
                found.add((sum(m.fuzzy_counts), m.start(), m.end()))
                todo += [(x, m.start()), (m.end(), y)]
    taken, kept = Places(), []
    for hit in sorted(found):
        if not taken.meets(*hit[1:]):
            taken.add(*hit[1:])
            kept.append(hit)
    return kept


def fuzzy(line: str, notices: tuple, share: float) -> list[tuple[str, int, int, int, int]]:
    """(label, start, end, edits, length of the notice) of each notice found in ``line``, best matches of a window first."""
    automaton, patterns = compiled(notices, share)
    windows: dict[int, list[list[int]]] = {}
    for end, (size, where) in automaton.iter(line):
        for i, at in where:
            start, k, n = end + 1 - size - at, patterns[i][1], patterns[i][3]
            a, b = max(0, start - k), start + n + k
            mine = windows.setdefault(i, [])
            if mine and a <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], b)
            else:
                mine.append([a, b])
    found = []
    for i, mine in windows.items():
        pattern, k, label, n = patterns[i]
        for a, b in mine:
            found += [(label, *m[1:], m[0], n) for m in every(pattern, line, a, min(b, len(line)), n + 2 * k)]
    # where notices of several kinds match one place, the one with the smallest share of edits stands for it
    best, places = [], {label: Places() for label, *_ in found}
    for hit in sorted(found, key=lambda h: (h[3] / h[4], -h[4], h[0], h[1])):
        if not any(p.meets(*hit[1:3]) for label, p in places.items() if label != hit[0]):
            places[hit[0]].add(*hit[1:3])
            best.append(hit)
    return best


def scan(text: bytes, phrases: tuple, notices: tuple, share: float) -> tuple:
    words = WORD.findall(text.lower())
    line = b" ".join(words)
    padded = b" " + line + b" "
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    word_at = lambda at: int(np.searchsorted(spaces, at))
    places, labels = [], set()
    for phrase, label in phrases:
        needle, at = f" {phrase} ".encode(), -1
        while (at := padded.find(needle, at + 1)) >= 0:
            places.append(word_at(at))
            labels.add(label)
    spans, score = [], 1.0 if places else 0.0
    for label, a, b, edits, n in fuzzy(line.decode("latin-1"), notices, share):
        first = word_at(a + (line[a : a + 1] == b" "))
        last = word_at(b - (line[b - 1 : b] == b" "))
        spans.append({"label": label, "first_word": first, "last_word": last, "edits": edits})
        score = max(score, 1 - edits / n)
    spans.sort(key=lambda s: (s["first_word"], s["last_word"], s["label"], s["edits"]))
    join = lambda x: ",".join(sorted(x))
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        join(labels), join(labels | {s["label"] for s in spans}), score, spans,
    )


def with_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES, share: float = 0.1) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``spans``.

    ``spans`` holds each fuzzy match: label, first and last word (from 0), edits. A notice may
    differ by ``share`` of its length in edits, one at least. ``score`` is 1 where a phrase
    stands exactly, else the best share of a notice without edits, else 0. Null and empty
    texts have no words and no labels. Of notices that tie in one place, the longer stands, then
    the first by label. Whole texts are scanned in one pass without a shuffle.
    Repeated rows stay, null ids pass, extra columns are not read, an empty table gives none.
    """
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    long, span = pa.int64(), pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])
    types = [long, long, long, long, pa.string(), pa.string(), pa.float64(), pa.list_(span)]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(x.as_py() or b"", phrases, notices, share) for x in batch.column(1)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *names])

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,last_word:long,edits:long>>"
    return source.mapInArrow(apply, schema).withColumnRenamed("id", id_col)
