"""Covering codes for Hamming space: the anchors of a product of perfect Golay codes."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

# Fixed values of the binary Golay code: length, covering radius, generator polynomial.
GOLAY_BITS = 23
GOLAY_RADIUS = 3
GOLAY_GENERATOR = 0b101011100011


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator; words differ by a codeword if equal."""
    rest = words.astype(np.int64, copy=True)
    for bit in range(GOLAY_BITS - 1, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GOLAY_GENERATOR << (bit - 11))
    return rest


@lru_cache(maxsize=1)
def error_patterns() -> list[tuple[np.ndarray, np.ndarray]]:
    """For 0, 1 and 2 bits beyond the covering radius: patterns by syndrome, and where each begins.

    A word has a codeword at `word ^ pattern` for exactly the patterns of its own syndrome. As the
    code is perfect, there is one pattern of weight up to 3 for every syndrome.
    """
    tables = []
    for weights in (range(GOLAY_RADIUS + 1), [GOLAY_RADIUS + 1], [GOLAY_RADIUS + 2]):
        made = [sum(1 << b for b in bits) for w in weights for bits in combinations(range(GOLAY_BITS), w)]
        patterns = np.array(made, np.int64)
        of = syndromes(patterns)
        order = np.argsort(of, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=2048))))
        tables.append((patterns[order], starts))
    return tables


def _expand(syndrome: np.ndarray, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, pattern) for every row and every pattern of its syndrome with so many bits beyond."""
    patterns, starts = error_patterns()[extra]
    counts = starts[syndrome + 1] - starts[syndrome]
    row = np.repeat(np.arange(len(syndrome)), counts)
    first = np.repeat(starts[syndrome] - (np.cumsum(counts) - counts), counts)
    return row, patterns[first + np.arange(len(row))]


def anchors(fingerprints: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is_home) of each fingerprint's anchors, for a threshold of 0 to 2 bits.

    The anchors are the pairs of Golay codewords on bits 0-22 and 23-45; the other 18 bits belong to
    no block, so an anchor covers whatever they hold. Every fingerprint has one home, the anchor
    within the covering radius in both blocks. It is sent to every anchor within that radius plus
    the threshold: the bits beyond the radius, added over the blocks, are at most the threshold. Two
    fingerprints that differ in at most that many bits meet at the home of either.
    """
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors are laid out for thresholds of 0 to 2 bits")
    words = fingerprints.astype(np.uint64)
    mask = np.uint64((1 << GOLAY_BITS) - 1)
    low = (words & mask).astype(np.int64)
    high = ((words >> np.uint64(GOLAY_BITS)) & mask).astype(np.int64)
    of_low, of_high = syndromes(low), syndromes(high)
    rows, made, homes = [], [], []
    for extra_low in range(threshold + 1):
        row, pattern = _expand(of_low, extra_low)
        block = low[row] ^ pattern
        for extra_high in range(threshold + 1 - extra_low):
            again, other = _expand(of_high[row], extra_high)
            rows.append(row[again])
            made.append(block[again] | ((high[row[again]] ^ other) << GOLAY_BITS))
            homes.append(np.full(len(again), extra_low == extra_high == 0))
    return np.concatenate(rows), np.concatenate(made), np.concatenate(homes)
