"""Cost-balanced packing of tokenized documents into training sequences.

A document costs ``linear`` * n + ``quadratic`` * n * n for its n tokens, as attention within
documents does. Documents are taken in descending order of cost, and each goes to the
sequence of least cost that has room for it. Whole multiples of the capacity are sequences of
their own, and a document that fits nowhere is cut.

A task packs blocks of consecutive rows, about ``block_tokens`` tokens each, so memory is
bounded, nothing is shuffled and a lost task is simply run again. The tokens of a block that
are left beyond full sequences go to sequences whose sizes are the powers of two in their
number, so no sequence needs padding.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, release
from .tokencount import Cut


class Memory:
    """Pieces and their token ids.

    Pieces of up to 16 bytes are found many at a time, by their bytes as two numbers, in a
    table with open addressing; longer ones in a dictionary.
    """

    def __init__(self):
        self.pieces, self.length = 0, 0
        self._table(16)
        self.long: dict[bytes, int] = {}
        self.first, self.number = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)

    def _table(self, bits: int) -> None:
        self.bits = bits
        self.low, self.high = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.size, self.entry = np.zeros(1 << bits, np.int8), np.zeros(1 << bits, np.int32)

    def slots(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Each piece's place in the table, or the free place where it belongs."""
        mixed = (low ^ (high * np.uint64(0xC2B2AE3D27D4EB4F)) ^ size.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        slot = (mixed >> np.uint64(64 - self.bits)).astype(np.int64)
        odd = np.arange(len(slot))
        while True:
            at = slot[odd]
            taken = self.size[at] > 0
            other = taken & ((self.low[at] != low[odd]) | (self.high[at] != high[odd]) | (self.size[at] != size[odd]))
            odd = odd[other]
            if not len(odd):
                return slot
            slot[odd] = (slot[odd] + 1) & (len(self.size) - 1)

    def insert(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, entry: np.ndarray) -> None:
        if 2 * self.pieces > len(self.size):
            kept = self.size > 0
            low, high, size, entry = (np.concatenate((a[kept], b)) for a, b in ((self.low, low), (self.high, high), (self.size, size), (self.entry, entry)))
            self._table(int(4 * self.pieces - 1).bit_length())
        while len(low):
            slot = self.slots(low, high, size)
            _, one = np.unique(slot, return_index=True)  # two new pieces may want one place
            at = slot[one]
            self.low[at], self.high[at], self.size[at], self.entry[at] = low[one], high[one], size[one], entry[one]
            low, high, size, entry = (np.delete(x, one) for x in (low, high, size, entry))

    def store(self, count: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The entries of new pieces, of so many ids each."""
        new = np.arange(self.pieces, self.pieces + len(count), dtype=np.int32)
        while self.pieces + len(count) > len(self.first):
            self.first, self.number = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.number))
        while self.length + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.first[new], self.number[new] = self.length + np.cumsum(count) - count, count
        self.pool[self.length : self.length + len(ids)] = ids
        self.pieces, self.length = self.pieces + len(count), self.length + len(ids)
        return new

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each entry has, and all of them in a row."""
        count = self.number[entry].astype(np.int64)
        ends = np.cumsum(count)
        return count, self.pool[np.repeat(self.first[entry] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Token ids by the tokenizers library, which is asked once for each distinct piece while it is remembered.

    Pieces live in two memories of ``most`` / 2 each. When the young one is full it becomes the
    old one, and what is still in use moves over from there.
    """

    def __init__(self, path: str, most: int):
        # a task has one core; the library's own threads would only take those of other tasks
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.most = most
        self.young, self.old = Memory(), Memory()

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Ask the library for pieces that neither memory has; their new entries."""
        found = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        count = np.fromiter(map(len, found), np.int32, len(found))
        return self.young.store(count, np.fromiter((i for f in found for i in f), np.uint32, int(count.sum())))

    def _recall(self, entry: np.ndarray) -> np.ndarray:
        """Entries of the old memory, each once, as new entries of the young one."""
        return self.young.store(*self.old.ids(entry))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        if 2 * self.young.pieces > self.most:
            self.young, self.old = Memory(), self.young
        young, old = self.young, self.old
        cut = Cut(texts, sorted(self.added, key=len, reverse=True))
        raw = cut.raw + bytes(16)
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))  # the eight bytes from each place on
        n = cut.stop - cut.start
        mask = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        low, high = eight[cut.start] & mask[np.minimum(n, 8)], eight[cut.start + 8 * (n > 8)] & mask[np.clip(n - 8, 0, 8)]
        entry = np.full(len(n), -1, np.int64)
        short = np.flatnonzero(n <= 16)
        size = n.astype(np.int8, casting="unsafe")
        start, stop = cut.start, cut.stop

        def known(memory: Memory, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Entries of those pieces that a memory has, and whether it has each."""
            slot = memory.slots(low[which], high[which], size[which])
            has = memory.size[slot] > 0
            return memory.entry[slot[has]], has

        def place(which: np.ndarray, number: np.ndarray, made: np.ndarray) -> None:
            """Give pieces the new entries, by number, and remember one of each."""
            entry[which] = made[number]
            one = which[np.unique(number, return_index=True)[1]]
            young.insert(low[one], high[one], size[one], made)

        at, has = known(young, short)
        entry[short[has]] = at
        missed = short[~has]
        if old.pieces and len(missed):
            at, has = known(old, missed)
            if len(at):
                again, number = np.unique(at, return_inverse=True)
                place(missed[has], number, self._recall(again))
                missed = missed[~has]
        new: dict[bytes, int] = {}
        number = [new.setdefault(raw[start[i] : stop[i]], len(new)) for i in missed.tolist()]
        if new:
            place(missed, np.array(number), self._learn(list(new)))
        rest = np.flatnonzero(n > 16).tolist()
        long = [raw[start[i] : stop[i]] for i in rest]
        unknown = {p for p in long if p not in young.long}
        if again := [p for p in unknown if p in old.long]:
            young.long.update(zip(again, self._recall(np.array([old.long[p] for p in again])).tolist()))
        if new := [p for p in unknown if p not in old.long]:
            young.long.update(zip(new, self._learn(new).tolist()))
        entry[rest] = [young.long[p] for p in long]
        for i, text in cut.special.items():
            entry[i] = young.store(np.ones(1, np.int32), np.array([self.added[text]], np.uint32))[0]
        if cut.void:
            entry[cut.void] = young.store(np.zeros(1, np.int32), np.zeros(0, np.uint32))[0]
        count, ids = young.ids(entry)
        at = np.concatenate(([0], np.cumsum(count)))[cut.first].tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]


@lru_cache(1)
def encoder_for(path: str, most: int) -> Encoder:
    return Encoder(path, most)


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; every sequence is filled."""
    out, sequence = [], 0
    for d in np.flatnonzero(lengths >= capacity).tolist():
        for k in range(int(lengths[d]) // capacity):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
    rest = lengths % capacity
    total = int(rest.sum())
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(30, -1, -1) if total % capacity >> b & 1]
    size = np.array(sizes, np.int64)
    left, cost = size.copy(), np.zeros(len(size))
    for d in np.argsort(-rest, kind="stable")[: int((rest > 0).sum())].tolist():
        start, need = int(lengths[d] - rest[d]), int(rest[d])
        while need:
            fits = left >= need
            s = int(np.argmin(np.where(fits if fits.any() else left > 0, cost, np.inf)))
            n = min(need, int(left[s]))
            out.append((d, start, n, sequence + s, int(size[s] - left[s])))
            left[s] -= n
            cost[s] += linear * n + quadratic * n * n
            start, need = start + n, need - n
    return out


def pack(docs: DataFrame, path: str, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block_tokens: int = 1 << 20, at_once: int = 1 << 18, remembered: int = 1_000_000) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids are the library's for its whole text, then ``end_id``; null and empty
    texts are just that. Each id is in exactly one piece. Sequences hold at most ``capacity``
    (a power of two) and are full, or as long as a power of two. Repeated rows are packed each
    for itself; null ids pass. Extra columns are not read. An empty table gives an empty
    result. Documents of equal cost are placed as they come, and of sequences of equal cost the
    first is taken. A sequence's number holds its partition's, so reruns over the same splits
    agree. A Python worker remembers the ids of up to ``remembered`` pieces of text, about 100
    bytes each.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        encoder, end = encoder_for(path, remembered), np.array([end_id], "<u4")
        names, coded, tokens, texts, size = [], [], 0, [], 0

        def settle() -> int:
            new = [np.concatenate((ids, end)) for ids in encoder.encode(texts)] if texts else []
            coded.extend(new)
            texts.clear()
            return sum(map(len, new))

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                names.append(name)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size >= at_once:
                    tokens, size = tokens + settle(), 0
                    if tokens >= block_tokens:
                        yield names, coded
                        names, coded, tokens = [], [], 0
        settle()
        if names:
            yield names, coded

    schema = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        sequence = TaskContext.get().partitionId() << 36

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        for ids, coded in blocks(typed()):
            lengths = np.array([len(x) for x in coded], np.int64)
            doc, start, length, number, offset = map(list, zip(*assign(lengths, capacity, linear, quadratic)))
            for lo in range(0, len(doc), 1024):
                d, a, n = doc[lo : lo + 1024], start[lo : lo + 1024], length[lo : lo + 1024]
                columns = [
                    pa.array([ids[i] for i in d], kind),
                    pa.array(a, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array([coded[i][s : s + k].astype("<u4").tobytes() for i, s, k in zip(d, a, n)], pa.binary()),
                    pa.array(lengths[d]),
                    pa.array(np.array(number[lo : lo + 1024], np.int64) + sequence),
                    pa.array(offset[lo : lo + 1024], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
            sequence += max(number) + 1
        release()

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    packed = source.mapInArrow(apply, f"id {schema}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
