"""Operators 1 and 7: ids equal the tokenizers library's, texts come back, packing loses nothing."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kerbwatch.llm import packing
from kerbwatch.llm.bpe import Coder, bpe_decode, bpe_encode, round_trip_digests, unknown_letters
from kerbwatch.llm.packing import CapacityTree, UnitIds, best_fit_decreasing, pack

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ALPHABET = [*"abABxyz$#  \n\t'sétl1²٣ß漢😀́\x1c\xa0 \x85!?.,_İΣς", "<|endoftext|>", "'ll", "an", "the", "   "]


def strange_texts(n=3000):
    rng = random.Random(4)
    own = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*own, *("an" * k for k in range(30)), *("a" * k for k in range(40))]


def test_encoding_equals_the_library():
    texts = strange_texts()
    coder, library = Coder(BYTES), Tokenizer.from_file(BYTES)
    for text, made in zip(texts, coder.encode(texts), strict=True):
        ids = np.frombuffer(made, "<i4")
        expected = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert coder.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_unit_ids_equal_the_library():
    texts = strange_texts()
    units, library = UnitIds(WORDS), Tokenizer.from_file(WORDS)
    for text, made in zip(texts, units.encode(texts), strict=True):
        assert np.frombuffer(made, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_of_edge_rows(edge_docs, no_docs):
    library = Tokenizer.from_file(BYTES)
    rows = [(r.doc_id, r.text or "") for r in edge_docs.collect()]
    got = [tuple(r) for r in round_trip_digests(edge_docs, BYTES).collect()]
    expected = []
    for key, text in rows:
        ids = library.encode(text, add_special_tokens=False).ids
        joined = ",".join(map(str, ids)).encode()
        expected.append((key, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert round_trip_digests(no_docs, BYTES).collect() == []


def test_decoding_takes_null_and_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, [15496, 99_999_999, -1])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe_decode(rows, BYTES).collect()}
    assert got == {1: "", 2: "Hello"}
    assert bpe_encode(rows.selectExpr("doc_id", "'Hello' as text"), BYTES).first().ids == [15496]


def test_capacity_tree_finds_the_tightest():
    tree, rng, held = CapacityTree(64), random.Random(2), []
    for step in range(3000):
        need = rng.randint(1, 64)
        assert tree.tightest(need) == min((c for c in held if c >= need), default=None)
        if rng.random() < 0.5 or not held:
            c = rng.randint(1, 64)
            held.append(c)
            tree.put(step, c)
        else:
            c = rng.choice(held)
            held.remove(c)
            tree.take(c)


def test_best_fit_decreasing_equals_plain_search():
    lengths = np.random.default_rng(1).integers(1, 33, 500)
    where, offset = best_fit_decreasing(lengths, 32)
    left: list[int] = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [c for c in left if c >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(32 - n)
    used = np.bincount(where, lengths)
    assert sorted(used.tolist()) == sorted(float(32 - c) for c in left)
    for w in range(int(where.max()) + 1):
        own = np.flatnonzero(where == w)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == np.concatenate(([0], np.cumsum(lengths[own])[:-1])).tolist()


@pytest.mark.parametrize("group_rows", [4, 50_000])
def test_packing_holds_every_id_once(edge_docs, no_docs, group_rows):
    library = Tokenizer.from_file(WORDS)
    rows = pack(edge_docs, WORDS, group_rows=group_rows).toPandas()
    texts = sorted((r.text or "") for r in edge_docs.collect())
    ids = {t: [*library.encode(t, add_special_tokens=False).ids, 2] for t in texts}
    assert rows["length"].sum() == sum(len(ids[t]) for t in texts)
    by_key = {r.doc_id: r.text or "" for r in edge_docs.collect()}
    for r in rows.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        part = np.array(ids[by_key[key]][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[by_key[key]])
    for _, window in rows.groupby("sequence_id"):
        window = window.sort_values("offset")
        assert window["offset"].tolist() == [0, *window["length"].cumsum().tolist()[:-1]]
        assert window["length"].sum() <= 4096
    assert pack(no_docs, WORDS).collect() == []


def test_every_letter_before_marks_equals_the_library():
    """Also letters that normalisation takes apart."""
    letters = [chr(c) for c in range(0x80, 0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"ab{c}," for c in letters] + [f"{c}.{c}!" for c in letters]
    units, library = UnitIds(WORDS), Tokenizer.from_file(WORDS)
    expected = library.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [
        t for t, made, want in zip(texts, units.encode(texts), expected, strict=True)
        if np.frombuffer(made, "<u4").tolist() != want.ids
    ]
    assert not wrong


def test_letters_are_those_of_the_library():
    """Code points on which tables of different Unicode versions disagree, and all their neighbours."""
    library = Tokenizer.from_file(BYTES)
    unknown = {ord(c) for c in unknown_letters()}
    asked = sorted({p + d for p in unknown for d in (-1, 0, 1)} | set(range(0x20, 0x20000, 7)))
    texts = [t for p in asked if not 0xD800 <= p < 0xE000 and p < 0x110000 for t in (f"a{chr(p)}'t", f"1{chr(p)} x")]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    coder = Coder(BYTES)
    got = [np.frombuffer(ids, "<i4").tolist() for ids in coder.encode(texts)]
    assert [t for t, a, b in zip(texts, got, expected, strict=True) if a != b] == []


def test_plain_words_are_not_taken_apart_one_by_one(monkeypatch):
    """Letters up to U+00FF and the marks after them go many at once; ids are the library's, also when memory restarts."""
    looked_at, parted = [], packing._parted
    monkeypatch.setattr(packing, "_parted", lambda unit: looked_at.append(unit) or parted(unit))
    monkeypatch.setattr(packing, "KEPT_STEMS", 50)
    monkeypatch.setattr(packing, "KEPT_UNITS", 5)
    rng = random.Random(8)
    letters = [c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº"]
    plain = ["".join(rng.choices(letters, k=rng.randrange(1, 9))) + "".join(rng.choices(packing._MARKS, k=rng.randrange(3))) for _ in range(600)]
    other = ["", "...", "1.5,", "ªb", "µ", "don't", "a-b!", "é,", "漢字?", "<|endoftext|>", "Å.", "Ω;"]
    units, library = UnitIds(WORDS), Tokenizer.from_file(WORDS)
    for _ in range(8):
        texts = [" ".join(rng.choices([*plain, *other], k=40)) + rng.choice(["", "\n", "\t\t "]) for _ in range(30)]
        for text, made in zip(texts, units.encode(texts), strict=True):
            assert np.frombuffer(made, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert looked_at and set(looked_at) <= set(other)
    assert units.encode([]) == [] and units.encode([""]) == [b""]
