"""Token counts by compiled finite-state transducers.

Two deterministic machines read a text. The first is the byte-level pre-tokenizer as an
automaton over character classes whose transitions say where pieces begin. Texts are cut into
chunks of one length; each chunk's map from entry state to exit state is computed, the maps
compose through a parallel prefix scan, and the chunks then run in step from their known
entry states. The second is the byte-pair encoding of one piece: its states are compiled as
they are first reached, and each transition holds the change of the number of tokens, so a
piece's count is the sum along its path. Pieces run in step as well, byte by byte, through a
transition table.

That the second machine is finite and exact rests on a property of byte-pair encoding: a
sequence of tokens is the encoding of its text if and only if each two neighbours are the
encoding of their own concatenation. So each prefix of a piece has one last token, the one
that is compatible with the last token of what stands before it; and only as many prefixes
matter as tokens may still reach back over.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Character classes and states of the pre-tokenizer.
CLASSES = dict.fromkeys("letter number other space blank quote s_t_m_d r v l e end".split())
CLASSES = {k: i for i, k in enumerate(CLASSES)}
STATES = "start letter number other quote quote_r quote_v quote_l space blank spaces blanks".split()
NEW, BACK = 1, 2  # a piece begins at this character; at the one before
LETTERS = ("letter", "s_t_m_d", "r", "v", "l", "e")


def _pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, where pieces begin) by state and class."""
    to = np.zeros((len(STATES), len(CLASSES)), np.uint8)
    out = np.zeros_like(to)

    def step(state: str, kind: str) -> tuple[str, int]:
        if kind == "end":  # between texts
            return "start", NEW | (BACK if state in ("quote_r", "quote_v", "quote_l") else 0)
        if state in ("quote_r", "quote_v", "quote_l"):
            if kind == {"quote_r": "e", "quote_v": "e", "quote_l": "l"}[state]:
                return "start", 0  # a contraction is complete
            then, marks = step("letter", kind)
            return then, marks | BACK
        letter = kind in LETTERS
        same = {"letter": letter, "number": kind == "number", "other": kind in ("other", "quote"), "quote": kind in ("other", "quote")}
        if same.get(state):
            return ("other" if state in ("other", "quote") else state), 0
        if state == "quote" and letter and kind not in ("letter", "e"):
            return ("start", 0) if kind == "s_t_m_d" else (f"quote_{kind}", 0)
        run = state in ("space", "blank", "spaces", "blanks")
        if kind in ("space", "blank"):
            return kind + "s" * run, 0 if run else NEW
        marks = {"space": 0, "spaces": BACK, "blank": NEW, "blanks": NEW | BACK}.get(state, NEW)
        if letter:
            return "letter", marks
        if kind == "number":
            return "number", marks
        return ("quote" if kind == "quote" and state not in ("space", "spaces") else "other"), marks

    for i, state in enumerate(STATES):
        for kind, c in CLASSES.items():
            then, marks = step(state, kind)
            to[i, c], out[i, c] = STATES.index(then), marks
    return to, out


TO, OUT = _pretokenizer()
END = 0x110000


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of each code point, and of END."""
    found = np.full(END + 1, CLASSES["other"], np.uint8)
    for i in range(END):
        c = chr(i)
        kind = unicodedata.category(c)[0]
        if kind == "L":
            found[i] = CLASSES["letter"]
        elif kind == "N":
            found[i] = CLASSES["number"]
        elif kind == "Z" or c in "\t\n\x0b\x0c\r\x85":
            found[i] = CLASSES["blank"]
    found[ord(" ")], found[ord("'")], found[END] = CLASSES["space"], CLASSES["quote"], CLASSES["end"]
    for c in "stmd":
        found[ord(c)] = CLASSES["s_t_m_d"]
    for c in "rvle":
        found[ord(c)] = CLASSES[c]
    return found


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Compose chunk maps [chunk, state] -> state: row i becomes the map of chunks 0 to i."""
    done, width = maps.copy(), 1
    while width < len(done):
        done[width:] = np.take_along_axis(done[width:], done[:-width], 1)
        width *= 2
    return done


def piece_starts(points: np.ndarray, chunk: int = 128) -> np.ndarray:
    """For code points with END after each text: whether a piece begins at each."""
    kinds = _classes()[points]
    n = len(kinds)
    pad = -n % chunk
    grid = np.concatenate((kinds, np.full(pad, CLASSES["end"], np.uint8))).reshape(-1, chunk).T.copy()
    maps = np.repeat(np.arange(len(STATES), dtype=np.uint8)[None], grid.shape[1], 0)
    flat, width, head = TO.ravel(), TO.shape[1], 12
    for row in grid[:head]:
        maps = flat[maps.astype(np.intp) * width + row[:, None]]
    # a map that has become constant stays so, and needs one run from here; the few others need all
    open_ = np.flatnonzero((maps != maps[:, :1]).any(1))
    one, rest = maps[:, 0], maps[open_]
    for row in grid[head:]:
        one = flat[one.astype(np.intp) * width + row]
        if len(open_):
            rest = flat[rest.astype(np.intp) * width + row[open_, None]]
    maps = np.repeat(one[:, None], len(STATES), 1)
    maps[open_] = rest
    state = np.concatenate(([0], prefix_scan(maps)[:-1, 0])).astype(np.intp)
    marks, emit = np.empty_like(grid), OUT.ravel()
    for i, row in enumerate(grid):
        at = state * width + row
        marks[i] = emit[at]
        state = flat[at].astype(np.intp)
    marks = marks.T.ravel()[:n]
    begins = (marks & NEW) > 0
    begins[:-1] |= (marks[1:] & BACK) > 0
    return begins


class PieceCounter:
    """The byte-pair encoding of one piece as a transducer whose states are compiled on first use."""

    def __init__(self, path: str, most_states: int = 1 << 18):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or spec.get("post_processor"):
            raise ValueError("only byte-level BPE without a normalizer, prefix space or post-processor is compiled")
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word limits are not compiled")
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        raw = lambda token: bytes(byte[c] for c in token)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        # only tokens that merging can reach count; a token is reachable if it encodes to itself
        self.tokens = {raw(t) for t in model["vocab"] if t in byte or all(c in byte for c in t)}
        self.tokens = {t: t for t in self.tokens if len(t) == 1 or len(self._merge(t)) == 1}
        self.prefixes = {t[:k]: t[:k] for t in self.tokens for k in range(1, len(t))}
        self.byte = [bytes((b,)) for b in range(256)]
        self.most = most_states
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _merge(self, text: bytes) -> list[bytes]:
        """Plain byte-pair encoding, for compiling only."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (pair := (parts[best], parts[best + 1])) not in self.rank:
                break
            merged, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    merged.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def _fit(self, a: bytes, b: bytes) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= 1 << 18:
                self.fits.clear()
            known = self.fits[a, b] = self._merge(a + b) == [a, b]
        return known

    def _clear(self) -> None:
        # a state: for each start a token may still reach back to, the bytes since it, the last token before it, and its count less the count now
        self.states: list[tuple] = [((b"", b"", 0),)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        # transitions, in a table with open addressing: state << 8 | byte to the next state and the change of the count
        self.bits, self.used = 12, 0
        self._table(1 << self.bits)

    def _table(self, n: int) -> None:
        self.key, self.to, self.change = np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int16)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place in the table, or the free place where it belongs."""
        mask = len(self.key) - 1
        slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.key[slot]
        odd = np.flatnonzero((held != keys) & (held >= 0))
        while len(odd):
            slot[odd] = at = (slot[odd] + 1) & mask
            held = self.key[at]
            odd = odd[(held != keys[odd]) & (held >= 0)]
        return slot

    def _insert(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        self.used += len(keys)
        if 2 * self.used > len(self.key):
            kept = self.key >= 0
            keys, to, change = (np.concatenate((a[kept], b)) for a, b in ((self.key, keys), (self.to, to), (self.change, change)))
            self.bits = max(self.bits + 1, int(4 * self.used - 1).bit_length())
            self._table(1 << self.bits)
        while len(keys):
            slot = self._slots(keys)
            _, first = np.unique(slot, return_index=True)  # two new keys may want one place
            at = slot[first]
            self.key[at], self.to[at], self.change[at] = keys[first], to[first], change[first]
            keys, to, change = (np.delete(x, first) for x in (keys, to, change))

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        c, token, change, alive = self.byte[byte], None, 0, []
        for since, last, less in self.states[state]:
            s = since + c
            if token is None and (t := self.tokens.get(s)) and (not last or self._fit(last, t)):
                token, change = t, less + 1
            if s := self.prefixes.get(s):
                alive.append((s, last, less))
        key = (*((s, last, less - change) for s, last, less in alive), (b"", token, 0))
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        return to, change

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:end]."""
        total = np.zeros(len(start), np.int64)
        order = np.argsort(start - end, kind="stable")  # longest first, so those still running come first
        at, size = start[order], (end - start)[order]
        if len(self.states) > self.most:
            self._clear()
        state, sums = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        left, k = int((size > 0).sum()), 0
        while left:
            byte = data[at[:left] + k]
            keys = (state[:left] << 8) | byte
            slot = self._slots(keys)
            if (new := np.unique(keys[self.key[slot] < 0])).size:
                made = np.array([self._compile(x >> 8, x & 255) for x in new.tolist()])
                self._insert(new, made[:, 0].astype(np.int32), made[:, 1].astype(np.int16))
                slot = self._slots(keys)
            sums[:left] += self.change[slot]
            state[:left] = self.to[slot]
            k += 1
            left = int(np.searchsorted(-size[:left], -k, "left"))
        total[order] = sums
        return total


class Cut:
    """Texts cut into pieces: piece i is raw[start[i]:stop[i]]; text t has pieces first[t] to first[t + 1].

    A string of an added token is a part of its own, as the library takes it by default:
    ``special`` has the token's text by the number of the part's first piece, and its other
    pieces are void.
    """

    def __init__(self, texts: list[str], added: list[str]):
        parts, firsts, tagged = [], [], []
        split = re.compile("(" + "|".join(map(re.escape, added)) + ")").split if added else None
        for text in texts:
            firsts.append(len(parts))
            if split and any(x in text for x in added):
                for k, part in enumerate(split(text)):
                    if k % 2:
                        tagged.append(len(parts))
                    parts.append(part)
            else:
                parts.append(text)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        joined = "\x00".join([*parts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        ends = np.cumsum(lengths + 1) - 1
        points[ends] = END
        begins = piece_starts(points)
        begins[ends] = True  # the place after each part ends its last piece
        self.raw = joined.encode("utf-8")
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        width[ends] = 1
        offset = np.concatenate(([0], np.cumsum(width)))
        where = np.flatnonzero(begins)
        real = np.ones(len(points), bool)
        real[ends] = False
        real = real[where]
        count = np.concatenate(([0], np.cumsum(real)))
        stop = offset[np.concatenate((where[1:], [len(points)]))]
        self.start, self.stop = offset[where][real], stop[real]
        part_first = count[np.searchsorted(where, np.concatenate(([0], ends + 1))[: len(parts) + 1])]
        self.first = np.append(part_first[firsts], len(self.start)).astype(np.int64)
        self.special = {int(part_first[t]): parts[t] for t in tagged}
        self.void = [i for t in tagged for i in range(int(part_first[t]) + 1, int(part_first[t + 1]))]


def count_tokens(texts: list[str], machine: PieceCounter) -> np.ndarray:
    """Tokens of each text."""
    cut = Cut(texts, machine.added)
    tokens = machine.count(np.frombuffer(cut.raw, np.uint8), cut.start, cut.stop)
    tokens[list(cut.special)] = 1
    tokens[cut.void] = 0
    return np.diff(np.concatenate(([0], np.cumsum(tokens)))[cut.first])


@lru_cache(2)
def machine_for(path: str) -> PieceCounter:
    return PieceCounter(path)


def with_token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", at_once: int = 1 << 21) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row, in one pass without a shuffle.

    ``path`` is the tokenizer's file, at the same place on every executor. Null and empty
    texts have no bytes and no tokens. Repeated rows stay; ids are not read, so nulls pass.
    Texts are run about ``at_once`` characters at a time, a longer text by itself, whole.
    Extra columns are not read. An empty table gives an empty result.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_for(path)
        for batch in batches:
            counts, held, size = [], [], 0
            for text in batch.column(1):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= at_once:
                    counts.append(count_tokens(held, machine))
                    held, size = [], 0
            counts.append(count_tokens(held, machine) if held else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.concatenate(counts))], names=["id", "n_bytes", "n_tokens"])

    bounded_batches(docs.sparkSession)
    text = F.col(text_col)
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = source.mapInArrow(apply, f"id {source.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
