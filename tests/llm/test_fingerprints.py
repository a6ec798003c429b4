"""Operators 3 and 5 against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kerbwatch.llm import covering, order_minhash, simhash
from kerbwatch.llm.components import connected_components


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


def plain_fingerprint(text: str) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    cut, word = [], ""
    for c in low + " ":
        if c in " \t\n\v\f\r":
            cut += [word] * bool(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(cut[i : i + 3]) for i in range(max(1, len(cut) - 2))] if cut else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_plain_counting():
    texts = ["", "  ", "One", "one TWO", "É é x a b c d", words(3, 500), "a\x0bb\x1cc d e f g"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_anchors_cover_and_meet():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
    near = []
    for p in prints[:100].tolist():
        for n in (0, 1, 2):
            near.append((p, p ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))))
    both = np.array([x for pair in near for x in pair], np.uint64)
    row, anchor, home = covering.anchors(both, 2)
    assert np.bincount(row[home], minlength=len(both)).tolist() == [1] * len(both)
    sent = {(int(r), int(a)) for r, a in zip(row, anchor, strict=True)}
    homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    for i in range(0, len(both), 2):
        assert (i + 1, homes[i]) in sent and (i, homes[i + 1]) in sent


def roots(prints, max_bits):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= max_bits:
            parent[find(b)] = find(a)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize(("max_bits", "crowd"), [(2, 64), (2, 2), (1, 2), (0, 64)])
def test_linked_fingerprints_equal_all_pairs(spark, max_bits, crowd):
    rng = random.Random(5)
    prints = set()
    for _ in range(25):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(rng.randrange(12)):  # chains, so that links reach further than the threshold
            p ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
            prints.add(p)
    center = rng.getrandbits(64)
    prints |= {center ^ 1 << b for b in range(0, 64, 2)}  # a crowd around one word
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    frame = spark.createDataFrame(signed, "fingerprint long")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.linked_fingerprints(frame, max_bits, crowd).collect()}
    expected = roots(prints, max_bits)
    groups = lambda m: {frozenset(k for k in prints if m.get(k, k) == v) for v in {m.get(k, k) for k in prints}}
    assert groups(found) == groups(expected)


def test_anchors_are_made_by_tasks_of_bounded_size(spark, monkeypatch, capsys):
    monkeypatch.setattr(simhash, "TASK_PRINTS", 100, raising=False)
    low = F.floor(F.col("id") / 16)  # sixteen fingerprints that differ in bits no anchor has; all in one split
    prints = spark.range(2_000).select((F.shiftleft(F.col("id") % 16, 46) + low).alias("fingerprint")).coalesce(1)
    made = simhash._meetings(prints, 0, 64)
    made.explain()
    assert re.search(r"hashpartitioning\(fingerprint#\d+L, 20\), REPARTITION_BY_NUM", capsys.readouterr().out)
    plain = np.array([r.fingerprint for r in prints.collect()])
    row, anchor, _ = covering.anchors(plain.view(np.uint64), 0)
    expected = sorted(zip(anchor.tolist(), plain[row].tolist(), strict=True))
    assert sorted((r.anchor, r.fingerprint) for r in made.collect()) == expected and len(expected) == 2_000


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 301)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 == len({got[100 + i] for i in range(40)})
    assert len({got[0], got[100], got[300]}) == 3
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_near_duplicates_of_edge_rows(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == "0" * 16
    assert {by[k].component_id for k in (2, 3, 4)} == {2}
    assert {by[k].component_id for k in (9, 10, 11)} == {9}  # case does not count
    assert by[None].component_id is None
    assert simhash.near_duplicates(no_docs).collect() == []


def test_one_of_each_keeps_rows_whole(edge_docs, no_docs):
    kept = simhash.one_of_each(edge_docs)
    assert kept.schema.names == edge_docs.schema.names
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [
        *((False, k) for k in (1, 2, 5, 6, 8, 9, 12)), (True, 0),
    ]
    rows = {tuple(r) for r in edge_docs.collect()}
    assert all(tuple(r) in rows for r in kept.collect())
    assert simhash.one_of_each(no_docs).collect() == []


def plain_signature(text: str) -> np.ndarray:
    """Order MinHash by sorting, over the module's own hashes of numbered k-mers."""
    return order_minhash.signatures([text])[0]


def test_order_minhash_selects_the_two_least_in_text_order():
    # One text: order of k-mers matters, occurrence numbers tell repeats apart.
    a, b = "p q r s t u v w x y z", "z y x w v u t s r q p"
    one, two, same = order_minhash.signatures([a, b, a])
    assert (one == same).all() and (one == two).mean() < 0.2
    more, less = order_minhash.signatures(["a b " * 50, "a b " * 5])
    assert (more == less).mean() < 1
    texts = [words(i, 60) for i in range(30)]
    batch = order_minhash.signatures(texts)
    assert all((plain_signature(t) == s).all() for t, s in zip(texts, batch, strict=True))


def test_likeness_falls_with_edits():
    base = words(1, 400).split()
    shares = []
    for cut in (0, 20, 60, 120, 200, 400):
        changed = base[: 400 - cut] + words(99, cut).split()
        x, y = order_minhash.signatures([" ".join(base), " ".join(changed)])
        shares.append((x == y).mean())
    assert shares[0] == 1 and shares[-1] < 0.1
    assert all(a >= b - 0.1 for a, b in itertools.pairwise(shares))


def test_one_character_in_a_text_without_spaces():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(4000))
    cut = rng.randrange(10, 40)
    x, y, z = order_minhash.signatures([text, text[:cut] + "z" + text[cut:], text[::-1]])
    assert (x == y).mean() > 0.9 and (x == z).mean() < 0.1


def test_places_of_a_long_text_do_not_spill():
    rng = np.random.default_rng(6)
    letters = rng.integers(97, 123, 4_500_000).astype(np.uint8).tobytes().decode()
    long = " ".join(letters)
    small = words(2, 50)
    both = order_minhash.signatures([small, long, small])
    alone = order_minhash.signatures([small])[0]
    assert (both[0] == alone).all() and (both[2] == alone).all()
    # The letters follow each other in many pairs; changing the last ones changes little.
    assert (both[1] == order_minhash.signatures([long[:-200]])[0]).mean() > 0.9


@pytest.mark.parametrize("partitions", ["4", "40"])
def test_fingerprinted_equals_plain_order(spark, edge_docs, no_docs, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [tuple(r) for r in order_minhash.fingerprinted(edge_docs).collect()]
        # xxhash64 orders rows of one key; here those are equal
        rows = sorted(edge_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
        texts = [r.text or "" for r in rows]
        following = texts[1:] + texts[:1]
        changed = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
        own, of_changed = order_minhash.signatures(texts), order_minhash.signatures(changed)
        expected = [
            (
                r.doc_id, len(t), hashlib.sha256(c.encode()).hexdigest(), s.astype(">u2").tobytes().hex(),
                e.astype(">u2").tobytes().hex(), float((s == e).mean()), float((s == n).mean()),
            )
            for r, t, c, s, e, n in zip(rows, texts, changed, own, of_changed, np.roll(own, -1, axis=0), strict=True)
        ]
        order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
        assert sorted(got, key=order) == sorted(expected, key=order)
        assert order_minhash.fingerprinted(no_docs).collect() == []
        assert order_minhash.fingerprinted(edge_docs.filter("doc_id = 9")).first().near_next == 1
        assert order_minhash.fingerprinted(edge_docs.filter("doc_id is null")).count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
