"""Operator 1: byte-level BPE encoding and decoding with a pair occurrence index."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from kerbwatch.llm.common import batches, keyed_text, slices, texts_of
from kerbwatch.llm.pairs import MergeTable, encode_words

# Fixed value: how byte-level BPE of this family cuts text into words.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# Units whose ids a Python worker keeps between batches; beyond it the memory starts afresh.
KEPT_UNITS = 200_000
# Characters that are cut into units at once.
AT_ONCE = 4_000_000

# A space inside a run of white space, or after one at the end: cutting before it would split a word.
_INNER_SPACE = re.compile(r"\s \s|\s \Z")


@lru_cache(maxsize=1)
def unknown_letters() -> str:
    """Letters and digits of the `regex` module's tables that the tokenizers library does not know as such.

    The two follow different versions of Unicode. The library is asked about the code points that
    Python's own tables, older than both, leave open.
    """
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    cut = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str

    def unknown(pattern: str, like: str) -> Iterator[str]:
        open_ones = (c for c in regex.findall(pattern, every) if unicodedata.category(c) == "Cn")
        return (c for c in open_ones if len(cut(like + c)) > 1)

    return "".join(sorted({*unknown(r"\p{L}", "a"), *unknown(r"\p{N}", "1")}))


def char_class(chars: str) -> str:
    """The sorted characters as ranges of a character class."""
    points = np.array([ord(c) for c in chars])
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs if len(run))


class WordCutter:
    """Cuts texts into words with letters and digits as the tokenizers library has them."""

    def __init__(self):
        self.words = regex.compile(WORDS)
        unknown = char_class(unknown_letters())
        self.unknown = re.compile(f"[{unknown}]") if unknown else None
        known = WORDS.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{unknown}]]")
        for kind in (r"?\p{L}", r"?\p{N}"):
            known = known.replace(kind, f"?[{kind[1:]}--[{unknown}]]")
        self.pinned = regex.compile(known, regex.V1) if unknown else self.words

    def __call__(self, text: str) -> list[str]:
        if self.unknown and not text.isascii() and self.unknown.search(text):
            return self.pinned.findall(text)
        return self.words.findall(text)


class Coder:
    """Encoder and decoder of one vocabulary, kept by a Python worker."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.words = WordCutter()
        self.bytes_of = self.table.token_bytes()
        specials = sorted(self.table.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.special_ids = {
            text: np.int32(i).tobytes() for text, i in self.table.specials.items()
        }
        # ids, as bytes of int32, of a unit as it stands, and of a unit that follows a space
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def _parts(self, text: str) -> list[str]:
        """Text cut at special tokens; every odd part is one."""
        return self.special.split(text) if self.special else [text]

    def _units(self, part: str) -> tuple[list[str], list[str]]:
        """Units as they stand, then units that follow a space; words never cross their borders."""
        if _INNER_SPACE.search(part):
            return self.words(part), []
        first, *rest = part.split(" ")
        return [first], rest

    def _learn(self, plain: set[str], spaced: set[str]) -> None:
        """Ids of units not met before, all at once through the pair index."""
        # A unit of letters is one word; Python's letters are letters to the library too.
        whole = [u for u in plain if u.isalpha()]
        spaced_whole = [u for u in spaced if u.isalpha()]
        mixed = [u for u in plain if not u.isalpha()]
        spaced_mixed = [u for u in spaced if not u.isalpha()]
        cut = [self.words(u) for u in (*mixed, *(" " + u for u in spaced_mixed))]
        parts = list({w for ws in cut for w in ws})
        words = [*whole, *(" " + u for u in spaced_whole), *parts]
        ids, starts = encode_words([w.encode() for w in words], self.table)
        raw, starts = ids.astype("<i4").tobytes(), (4 * starts).tolist()
        made = [raw[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        self.plain.update(zip(whole, made, strict=False))
        self.spaced.update(zip(spaced_whole, made[len(whole) :], strict=False))
        of = dict(zip(parts, made[len(whole) + len(spaced_whole) :], strict=True))
        joined = [b"".join([of[w] for w in ws]) for ws in cut]
        self.plain.update(zip(mixed, joined, strict=False))
        self.spaced.update(zip(spaced_mixed, joined[len(mixed) :], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes of little-endian 32-bit integers."""
        if len(self.plain) + len(self.spaced) > KEPT_UNITS:
            self.plain, self.spaced = {}, {}
        cut = []
        plain: set[str] = set()
        spaced: set[str] = set()
        for text in texts:
            parts = self._parts(text)
            units = [self._units(p) for p in parts[::2]]
            cut.append((units, parts[1::2]))
            for a, b in units:
                plain.update(a)
                spaced.update(b)
        self._learn(plain - self.plain.keys(), spaced - self.spaced.keys())
        p, s = self.plain.__getitem__, self.spaced.__getitem__
        out = []
        for units, marks in cut:
            joined = [b"".join([*map(p, a), *map(s, b)]) for a, b in units]
            if marks:
                mixed = [joined[0]]
                for mark, part in zip(marks, joined[1:], strict=True):
                    mixed += (self.special_ids[mark], part)
                joined = [b"".join(mixed)]
            out.append(joined[0])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; ids outside the vocabulary stand for nothing, broken UTF-8 for U+FFFD."""
        get = self.bytes_of
        n = len(get)
        return b"".join([get[i] for i in ids.tolist() if 0 <= i < n]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def bpe_encode(
    docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: `doc_id`, `ids array<int>`.

    Works on map partitions alone, no shuffle. Within a batch every distinct word is encoded once:
    a pair occurrence index maps each pair to its positions in all those words, and active ranks are
    applied in ascending order. Null and empty texts give an empty list, repeated rows stay, an
    empty table gives an empty table, other columns are not read. `vocab_path` must be a path that
    exists on the executors (an installed package), since it is read there.
    """

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocab_path)
        for batch in batches(rows):
            texts = texts_of(batch)
            keys = batch.column("doc_id")
            for lo, hi in slices(texts, AT_ONCE):
                made = c.encode(texts[lo:hi])
                offsets = np.cumsum([0, *(len(x) >> 2 for x in made)], dtype=np.int32)
                values = np.frombuffer(b"".join(made), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), ids], ["doc_id", "ids"])

    narrow = keyed_text(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """`encoded` (`doc_id`, `ids`) with a column `decoded`: the text of the ids, special ones too.

    A null list gives an empty text.
    """

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocab_path)
        for batch in batches(rows):
            ids = batch.column("ids")
            flat = ids.values.to_numpy(zero_copy_only=False)
            at = ids.offsets.to_numpy()
            known = ids.is_valid().to_pylist()
            texts = [
                c.decode(flat[a:b]) if ok else ""
                for a, b, ok in zip(at[:-1], at[1:], known, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), ids, pa.array(texts, pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    narrow = encoded.select("doc_id", "ids")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text of every document."""
    both = bpe_decode(bpe_encode(docs, vocab_path), vocab_path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
