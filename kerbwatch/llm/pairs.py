"""BPE merges over many words at once, driven by a pair occurrence index."""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence
from itertools import accumulate

import numpy as np

_DEAD = -2  # a symbol that was merged into its left neighbour
_EDGE = -1  # stands between words


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Bytes that print as themselves keep their code point; the others follow from 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    kept = set(printable)
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Vocabulary and ranked merges of a byte-level BPE file.

    `suffix` is what the last byte of a word carries in the vocabulary ("" or "</w>").
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.specials = {x["content"]: x["id"] for x in whole["added_tokens"]}
        chars = byte_characters()
        vocab = self.vocab
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int64)
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = (self.left << 20) | self.right
        self._rank_of_key = np.argsort(keys, kind="stable")
        self._keys = keys[self._rank_of_key]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it has none."""
        key = (left << 20) | right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where((self._keys[at] == key) & (left >= 0) & (right >= 0), self._rank_of_key[at], -1)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; special tokens stand for their own text."""
        code = {c: b for b, c in enumerate(byte_characters())}
        out = [b""] * (max([*self.vocab.values(), *self.specials.values()]) + 1)
        for token, i in self.vocab.items():
            out[i] = bytes(code[c] for c in token.removesuffix(self.suffix))
        for text, i in self.specials.items():
            out[i] = text.encode()
        return out


def encode_words(words: Sequence[bytes], table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and where each word's ids begin (one entry more than words).

    Every pair that has a rank is mapped to all its positions in all words. The active ranks are
    taken in ascending order from a heap; one step merges all places of a pair and enters the
    pairs this makes into the lists of their ranks. A merge can only make pairs of higher rank,
    since a token is made by a single merge, so one ascending pass gives what merging word by word
    gives. Places that a merge has changed meanwhile are recognised by their symbols. No place is in
    the lists of a rank twice: it is entered when its pair has changed, and what a pair spans only grows.
    """
    if not words:
        return np.empty(0, np.int64), np.zeros(1, np.int64)
    joined = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    ends = np.fromiter(accumulate(map(len, words)), np.int64, len(words)) + np.arange(len(words))
    sym = table.inner[joined]
    filled = np.fromiter(map(len, words), np.int64, len(words)) > 0
    sym[ends[filled] - 1] = table.last[joined[ends[filled] - 1]]
    sym[ends] = _EDGE
    sym = np.concatenate(([_EDGE], sym))  # so that every symbol has a left neighbour
    n = len(sym)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    changed = np.zeros(n, bool)

    found = table.ranks(sym[:-1], sym[1:])
    places = np.flatnonzero(found >= 0)
    order = places[np.argsort(found[places], kind="stable")]
    counts = np.bincount(found[places], minlength=1)
    stops = np.cumsum(counts)
    index: dict[int, list[np.ndarray]] = {}
    active = np.flatnonzero(counts).tolist()
    for rank in active:
        index[rank] = [order[stops[rank] - counts[rank] : stops[rank]]]
    # ascending, hence a heap already
    while active:
        rank = heapq.heappop(active)
        lists = index.pop(rank)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)  # of different places, see above
        a, b, new = table.left[rank], table.right[rank], table.made[rank]
        at = at[(sym[at] == a) & (sym[after[at]] == b)]
        if a == b and len(at) > 1:
            at = _every_other(at, after)
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        sym[at] = new
        sym[gone] = _DEAD
        after[at] = beyond
        before[beyond] = at
        changed[at] = True
        left_of = before[at]
        starts = np.concatenate((left_of[~changed[left_of]], at))  # neighbours may merge in one step
        changed[at] = False
        ranks = table.ranks(sym[starts], sym[after[starts]])
        starts, ranks = starts[ranks >= 0], ranks[ranks >= 0]
        if not len(starts):
            continue
        by = np.argsort(ranks, kind="stable")
        starts, ranks = starts[by], ranks[by]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        firsts = ranks[cuts[:-1]].tolist()
        for r, lo, hi in zip(firsts, cuts, cuts[1:], strict=False):
            have = index.get(r)
            if have is None:
                index[r] = [starts[lo:hi]]
                heapq.heappush(active, r)
            else:
                have.append(starts[lo:hi])
    bounds = np.concatenate(([0], np.cumsum(sym[1:] >= 0)))
    starts_at = np.concatenate(([0], ends + 1))
    return sym[sym >= 0], bounds[starts_at]


def _every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places of a pair of equal symbols, those that merge from the left: in a run, every other."""
    at = np.sort(at)
    joins = np.concatenate(([False], after[at[:-1]] == at[1:]))
    starts = np.flatnonzero(~joins)
    run_start = starts[np.cumsum(~joins) - 1]
    return at[(np.arange(len(at)) - run_start) % 2 == 0]
