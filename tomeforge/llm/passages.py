"""Repeated passages of a text: lines, sentences, runs of sentences, and windows of words anywhere.

A text is read as its words with their places. Words are runs of letters and digits of ASCII and
of all other characters but spaces; where a script sets no spaces, each character is one. Signs
count as spaces before sentences are cut, so they hide no end. Every passage is a range of words
and has the digests of its words, lower case, from running sums over the characters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Words of the windows that anchors are of, and windows that one anchor at least is of.
ANCHOR, SPREAD = 25, 26
#: Words of a passage that is found wherever it starts.
WINDOW = ANCHOR + SPREAD - 1
SPACES = (0x85, 0xA0, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x3000)
#: Thai to Lao, Myanmar, Khmer, kana, Han.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
ENDS = ".!?。！？"
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(m, -1, 1 << 64) for m in MULTIPLIERS)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0 in no word, 1 in a word, 2 a word; and its lower case, where that is one character."""
    kind = np.ones(0x110000, np.uint8)
    kind[:0x80] = [chr(c).isalnum() for c in range(0x80)]
    kind[list(SPACES)] = 0
    for a, b in UNSPACED:
        kind[a : b + 1] = 2
    kind[[ord(c) for c in ENDS]] = 0
    kind[0x3000:0x3003] = kind[0xFF0C] = 0
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        if len(low := chr(c).lower()) == 1:
            lower[c] = ord(low)
    return kind, lower


def powers(n: int, m: int) -> np.ndarray:
    """1, m, m^2, ... modulo 2^64."""
    out = np.full(n, m, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class Words:
    """The words of a text: places, digests of ranges, and where lines and sentences end."""

    def __init__(self, text: str):
        kind, lower = kinds()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = len(points)
        of = kind[points]
        before = np.concatenate(([0], of[:-1])) if len(of) else of
        after = np.concatenate((of[1:], [0])) if len(of) else of
        self.start = np.flatnonzero((of > 0) & ((of == 2) | (before != 1)))
        self.end = np.flatnonzero((of > 0) & ((of == 2) | (after != 1))) + 1
        self.n = len(self.start)
        # each word's digests, then running sums of them times powers
        at = np.cumsum(of > 0)
        chars = mixed(lower[points[of > 0]].astype(np.uint64) + np.uint64(0x1234567))
        first = at[self.start] - 1 if self.n else self.start
        length = self.end - self.start
        inside = (np.arange(len(chars)) - np.repeat(first, length)) if self.n else np.zeros(0, np.int64)
        self.sums, self.unshift = [], []
        for m, inverse in zip(MULTIPLIERS, INVERSES):
            scale = powers(int(length.max()) if self.n else 0, m ^ 0x5555555555555554)
            words = np.add.reduceat(chars * scale[inside], first) if self.n else np.zeros(0, np.uint64)
            words = mixed(words + length.astype(np.uint64))
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(self.n, m), dtype=np.uint64))))
            self.unshift.append(powers(self.n + 1, inverse))
        # the boundaries between words: 2 where a line ends, 1 where a sentence does, and the place
        self.cuts = self._cuts(points) if self.n else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def _cuts(self, points: np.ndarray):
        """(word, place, is a line's end) of each boundary: before that word, at that code point."""
        lines = np.flatnonzero(points == 10) + 1
        word = np.searchsorted(self.start, lines)
        mark = np.flatnonzero(np.isin(points, [ord(c) for c in ENDS]))
        blank = np.flatnonzero((points == 32) | (points == 9))
        # a sentence ends at the first blank after its mark, when no word stands between
        k = np.searchsorted(blank, mark)
        ok = k < len(blank)
        place = blank[k[ok]]
        nth = np.searchsorted(self.start, mark[ok])
        same = nth == np.searchsorted(self.start, place)
        # a full-width mark needs no blank after it
        wide = mark[points[mark] > 0x7F] + 1
        places = np.concatenate((lines, place[same], wide))
        words = np.concatenate((word, nth[same], np.searchsorted(self.start, wide)))
        is_line = np.concatenate((np.ones(len(lines), bool), np.zeros(len(places) - len(lines), bool)))
        order = np.lexsort((~is_line, places))
        return words[order], places[order], is_line[order]

    def digests(self, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
        n = (b - a).astype(np.uint64)
        return [mixed((s[b] - s[a]) * u[a] + n).view(np.int64) for s, u in zip(self.sums, self.unshift)]

    def units(self, least: int, sentences: bool) -> tuple[np.ndarray, ...]:
        """(first word, last word's end, start, end) of lines, and if asked of runs of sentences, ``least`` words or more.

        A run is the shortest from its first sentence, or to its last, that has enough words:
        together they cover every run of sentences that is repeated as a whole.
        """
        out = []
        word, place, is_line = self.cuts
        for runs, some in ((False, is_line), (True, np.ones(len(word), bool)))[: 1 + sentences]:
            w, p = np.concatenate(([0], word[some], [self.n])), np.concatenate(([0], place[some], [self.size]))
            # units without words join the one before
            keep = np.concatenate(([True], w[1:] != w[:-1]))
            w, p = w[keep], p[keep]
            if len(w) < 2:
                continue
            if not runs:
                i, j = np.arange(len(w) - 1), np.arange(1, len(w))
                good = w[j] - w[i] >= least
                i, j = i[good], j[good]
            else:
                j = np.searchsorted(w, w + least)
                i = np.flatnonzero(j < len(w))
                j = j[i]
                back = np.searchsorted(w, w - least, "right") - 1
                end = np.flatnonzero(back >= 0)
                i, j = np.concatenate((i, back[end])), np.concatenate((j, end))
            out.append(np.stack((w[i], w[j], p[i], p[j])))
        return np.unique(np.concatenate(out, 1), axis=1) if out else np.zeros((4, 0), np.int64)

    def chosen(self) -> np.ndarray:
        """For each range of ``WINDOW`` words its anchor: the first word of that one of its ranges of ``ANCHOR`` words whose digest is least."""
        if self.n < WINDOW:
            return np.zeros(0, np.int64)
        at = np.arange(self.n - ANCHOR + 1)
        seen = np.lib.stride_tricks.sliding_window_view(self.digests(at, at + ANCHOR)[0], SPREAD)
        return seen.argmin(1) + np.arange(len(seen))

    def anchors(self) -> np.ndarray:
        """The first words of all anchors."""
        return np.unique(self.chosen())
