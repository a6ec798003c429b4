"""Operator 11 against one dictionary of windows, and its index against plain search."""

import hashlib
import random

import numpy as np
import pytest

from kerbwatch.llm.fm_index import BitVector, FmIndex, WaveletMatrix
from kerbwatch.llm.substrings import removal_digests, window_least, without_repeats

NO_DOC = -(1 << 63)


def plain(rows, window):
    cut = [(NO_DOC if d is None else d, d, (t or "").encode().split()) for d, t in rows]
    first = {}
    for key, _, words in cut:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, (key, i)), (key, i))
    out = []
    for key, d, words in cut:
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (key, i):
                keep[i : i + window] = [False] * window
        left = b" ".join(w for w, k in zip(words, keep) if k)
        out.append((d, len(words), keep.count(False), hashlib.sha256(left).hexdigest()))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def shared_texts(seed, n=250):
    """Random words with shared passages, whole copies, near copies and runs of one word."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "the", "of", "été", "x%d" % rng.randrange(60)])
    passages = [[word() for _ in range(rng.randrange(5, 60))] for _ in range(8)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.2:
            words = rng.choice(texts).split(" ")
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = "changed"
        else:
            words = [word() for _ in range(rng.randrange(0, 50))]
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words) + 1) : 0] = rng.choice(passages)
            if rng.random() < 0.1:
                words += ["na"] * rng.randrange(10, 70)
        texts.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(words) if rng.random() < 0.1 else " ".join(words))
    return list(enumerate(texts))


@pytest.mark.parametrize(
    "settings",
    [{}, {"window": 5, "anchor": 2}, {"window": 8, "anchor": 3, "sample_every": 1, "crowded": 1, "shard_chars": 500}],
)
def test_words_of_repeated_windows_go(spark, settings):
    rows = shared_texts(len(settings))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = removal_digests(docs, **settings).collect()
    assert ordered(got) == ordered(plain(rows, settings.get("window", 20)))


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert ordered(removal_digests(edge_docs, window=3, anchor=2).collect()) == ordered(plain(rows, 3))
    assert ordered(removal_digests(edge_docs).collect()) == ordered(plain(rows, 20))
    assert removal_digests(no_docs).count() == 0


def test_long_text_and_rows_of_one_doc_id(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    long = " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(60_000))
    rows = [(7, f"{long} {passage}"), (7, f"{passage} tail"), (7, f"{passage} tail"), (3, f"x {passage}"), (None, passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert ordered(removal_digests(docs).collect()) == ordered(plain(rows, 20))


def test_kept_words_are_told(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"one {passage}"), (2, f"two  {passage} more")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in without_repeats(docs).collect()} == {1: f"one {passage}", 2: "two more"}


def test_index_equals_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(30):
        words = int(rng.integers(1, 9))
        parts = [rng.integers(1, words + 1, rng.integers(1, 30)) for _ in range(6)]
        text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int64)
        worth = rng.permutation(len(text))
        length = int(rng.integers(1, 6))
        index = FmIndex(text, words, worth, length)
        places = [i for i in range(len(text) - length + 1) if (text[i : i + length] > 0).all()]
        if not places:
            continue
        patterns = np.stack([text[i : i + length] for i in places])
        reached, number, least = index.matched(patterns, length)
        for k, p in enumerate(patterns):
            ends = [sum((text[i : i + m] == p[length - m :]).all() for i in range(len(text) - m + 1)) for m in range(1, length + 1)]
            assert reached[k] == sum(e > 1 for e in ends)
            if reached[k] == length:
                same = [i for i in places if (text[i : i + length] == p).all()]
                assert number[k] == len(same) and least[k] == min(worth[same])


def test_vectors_and_minima():
    rng = np.random.default_rng(5)
    bits = rng.random(300) < 0.4
    at = np.arange(301)
    assert (BitVector(bits).ones(at) == np.concatenate(([0], np.cumsum(bits)))).all()
    values = rng.integers(0, 50, 200)
    lo = rng.integers(0, 199, 80)
    hi = lo + 1 + rng.integers(0, 200 - lo)
    assert WaveletMatrix(values, 49).least(lo, hi).tolist() == [values[a:b].min() for a, b in zip(lo, hi)]
    some = rng.integers(0, 99, 60).astype(np.uint64)
    for size in (1, 2, 5, 16):
        assert window_least(some, size)[: 61 - size].tolist() == [some[i : i + size].min() for i in range(61 - size)]
