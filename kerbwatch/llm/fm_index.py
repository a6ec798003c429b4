"""Wavelet matrices and an FM-index over word numbers, for many searches at once in numpy."""

from __future__ import annotations

import numpy as np


class BitVector:
    """Bits packed into 64-bit words with a count before each word: 1.5 bits a bit."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits among the first i."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """A sequence of numbers below 2^levels, one bit vector a level, the highest bit first."""

    def __init__(self, values: np.ndarray, most: int):
        self.levels = max(1, int(most).bit_length())
        self.bits: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.bits.append(BitVector(bit.astype(bool)))
            zero = bit == 0
            self.zeros.append(int(zero.sum()))
            values = np.concatenate((values[zero], values[~zero]))

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the range lo:hi lies at the bottom among the symbol's own places."""
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b = self.bits[k].ones(lo), self.bits[k].ones(hi)
            lo = np.where(one, self.zeros[k] + a, lo - a)
            hi = np.where(one, self.zeros[k] + b, hi - b)
        return lo, hi

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest value of each range, none of which is empty."""
        out = np.zeros(len(lo), np.int64)
        for k in range(self.levels):
            a, b = self.bits[k].ones(lo), self.bits[k].ones(hi)
            none = (hi - b) - (lo - a) == 0  # no zero bit in the range
            out = (out << 1) | none
            lo = np.where(none, self.zeros[k] + a, lo - a)
            hi = np.where(none, self.zeros[k] + b, hi - b)
        return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of `text` in the order of what follows, to `depth` symbols at least; doubling steps."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(len(text), np.int64)
        follow[:-step or None] = rank[step:] + 1
        key = rank * (len(text) + 2) + follow
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank[order] = new
        step *= 2
        if step >= depth or new[-1] == len(text) - 1:
            return order


class FmIndex:
    """Backward search over the Burrows-Wheeler transform of several sequences of word numbers.

    `text` holds the sequences one after the other, each ended by 0, words numbered from 1 up to
    `words`. `worth` gives every place a number; a search can ask for the smallest in its interval.
    Searches may be `depth` words long at most.
    """

    def __init__(self, text: np.ndarray, words: int, worth: np.ndarray, depth: int):
        order = suffix_order(text, depth)
        self.size = len(text)
        self.text = WaveletMatrix(text[order - 1], words)
        # The bottom row keeps equal symbols together, by the order of their reversed bits.
        counts = np.bincount(text, minlength=words + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        levels = self.text.levels
        number = np.arange(words + 1)
        turned = np.zeros(words + 1, np.int64)
        for k in range(levels):
            turned |= ((number >> k) & 1) << (levels - 1 - k)
        by_turned = np.argsort(turned, kind="stable")
        self.bottom = np.empty(words + 1, np.int64)
        self.bottom[by_turned] = np.concatenate(([0], np.cumsum(counts[by_turned])))[:-1]
        self.worth = WaveletMatrix(worth[order], int(worth.max()) if len(worth) else 0)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more word before them."""
        a, b = self.text.rank(symbol, lo, hi)
        shift = self.first[symbol] - self.bottom[symbol]
        return a + shift, b + shift

    def matched(self, patterns: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search for `text`-like words ending before each of `patterns`' places.

        `patterns` is (searches, length), searched from the last column on. Matching statistics: how
        many words, at most `length`, occur at more than one place; for those that reach `length`
        also the number of their places and the smallest worth of them.
        """
        n = len(patterns)
        lo, hi = np.zeros(n, np.int64), np.full(n, self.size, np.int64)
        reached = np.zeros(n, np.int64)
        live = np.arange(n)
        for k in range(length - 1, -1, -1):
            a, b = self.extend(patterns[live, k], lo[live], hi[live])
            lo[live], hi[live] = a, b
            live = live[b - a > 1]
            reached[live] += 1
            if not len(live):
                break
        least = np.zeros(n, np.int64)
        full = np.flatnonzero(reached == length)
        least[full] = self.worth.least(lo[full], hi[full])
        return reached, np.where(reached == length, hi - lo, 0), least
