"""Operator 7: packing documents into token windows by best-fit decreasing."""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.llm.common import batches, keyed_text, slices, texts_of
from kerbwatch.session import staged

WINDOW = 4096
END_ID = 2
# Remainders that are packed together in one task. More of them only mean more groups.
GROUP_ROWS = 50_000
# Stems, and units that are no plain words, of which a Python worker keeps what it learned; beyond it the
# memory starts afresh.
KEPT_UNITS = 150_000
KEPT_STEMS = 300_000

# After a letter or digit a run of these up to the end of a unit is a word of its own.
_MARKS = ".,;:!?$%&#*"
_LETTERS = "".join(c for c in map(chr, range(0x41, 0x100)) if c.isalpha() and c not in "ªµº")
# Letters that NFC leaves alone, then marks; seen by the code of Arrow, many units at once.
_PLAIN = f"^[{_LETTERS}]+[{_MARKS}]*$"
# Stems that go through the tokenizer in one call, as one text.
_JOINED = 256
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def _is_word(stem: str) -> bool:
    """Letters up to U+00FF only: one word to the tokenizer, and one lower case everywhere."""
    return stem.isalpha() and (stem.isascii() or max(stem) <= "ÿ")


def _parted(unit: str) -> tuple[str, str]:
    """The stem of a unit and the marks that end it."""
    # As the tokenizer does; a letter may be taken apart into one and a mark.
    form = unit if unit.isascii() else unicodedata.normalize("NFC", unit)
    stem = form.rstrip(_MARKS)
    if stem and stem[-1].lower()[-1].isalnum():
        marks = form[len(stem) :]
    else:
        stem, marks = unit, ""
    if _is_word(stem):
        stem = stem.lower()  # as the tokenizer does
    return stem, marks


def _gathered(ids: np.ndarray, ends: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the runs that lie in `ids` one after the other, in the order picked, and where they end."""
    lengths = np.diff(ends, prepend=0)[pick]
    made = np.cumsum(lengths)
    if not len(made):
        return ids[:0], made
    at = np.repeat(ends[pick] - made, lengths)
    at += np.arange(len(at))
    return ids[at], made


class UnitIds:
    """Ids of texts by a tokenizer that drops white space.

    No token crosses white space, so a text's ids are those of its blank-separated units in turn, and
    a unit's are those of its stem and of the marks that end it. Each distinct stem and run of marks
    goes through the tokenizer once. Special tokens hold no white space and do not end in a mark.
    Texts are taken apart, and equal units and stems brought to one, by Arrow's own code.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = 1 + max(self.tokenizer.get_vocab().values())
        self.ends_word = np.zeros(size, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.parted: dict[str, tuple[str, str]] = {}
        self.stems: dict[str, bytes] = {}

    def _learn(self, stems: list[str]) -> None:
        words, others = [], []
        for stem in stems:
            (words if _is_word(stem) else others).append(stem)
        self._learn_words(words)
        made = self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        self.stems.update((u, np.array(e.ids, "<u4").tobytes()) for u, e in zip(others, made, strict=True))

    def _learn_words(self, words: list[str]) -> None:
        """Words of letters alone: many in one text, told apart by the tokens that end a word."""
        for lo in range(0, len(words), 64 * _JOINED):
            some = words[lo : lo + 64 * _JOINED]
            texts = [" ".join(some[i : i + _JOINED]) for i in range(0, len(some), _JOINED)]
            made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in made])
            stops = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            raw = ids.tobytes()
            for word, a, b in zip(some, [0, *stops], stops, strict=False):
                self.stems[word] = raw[a:b]

    def _runs(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the distinct ones of some stems or runs of marks, where they end, and which each one is."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)  # faster than to_pylist
        self._learn([n for n in names if n not in self.stems])
        raw = [*map(self.stems.__getitem__, names)]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) >> 2
        return np.frombuffer(b"".join(raw), "<u4"), ends, coded.indices.to_numpy()

    def _unit_runs(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, one after the other, and where they end."""
        plain = pc.match_substring_regex(units, _PLAIN)
        words = units.filter(plain)
        rest = units.filter(pc.invert(plain)).to_pylist()
        if len(self.parted) > KEPT_UNITS:
            self.parted = {}
        self.parted.update((u, _parted(u)) for u in rest if u not in self.parted)
        others = [self.parted[u] for u in rest]
        stems = pa.concat_arrays([pc.utf8_lower(pc.utf8_rtrim(words, _MARKS)), pa.array([s for s, _ in others], pa.string())])
        marks = pa.concat_arrays([pc.utf8_ltrim(words, _LETTERS), pa.array([m for _, m in others], pa.string())])
        if len(self.stems) > KEPT_STEMS:
            self.stems = {}
        ids, ends, which = self._runs(pa.concat_arrays([stems, marks]))
        order = plain.to_numpy(zero_copy_only=False)
        place = np.where(order, np.cumsum(order) - 1, len(words) + np.cumsum(~order) - 1)
        pick = which.reshape(2, -1)[:, place].T.ravel()
        ids, ends = _gathered(ids, ends, pick)
        return ids, ends[1::2]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = pa.array(texts, pa.string())
        for white in "\n\t":
            cut = pc.replace_substring(cut, white, " ")
        cut = pc.split_pattern(cut, " ")
        units = cut.flatten().dictionary_encode()
        ids, ends = self._unit_runs(units.dictionary)
        ids, ends = _gathered(ids, ends, units.indices.to_numpy())
        stops = np.concatenate([[0], ends])[cut.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(stops, stops[1:])]


@lru_cache(maxsize=2)
def unit_ids(path: str) -> UnitIds:
    return UnitIds(path)


def cut_pieces(ids: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the full windows of a document, then of what remains."""
    n = len(ids) >> 2
    for start in range(0, n, window):
        part = ids[4 * start : 4 * (start + window)]
        yield start, len(part) >> 2, zlib.crc32(part)


def token_pieces(
    docs: DataFrame,
    vocab_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens): full windows and one remainder.

    A document is the ids of its text, then `end_id`, so an empty or null text is one token.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = unit_ids(vocab_path)
        for batch in batches(rows):
            texts = texts_of(batch)
            keys = batch.column("doc_id")
            for lo, hi in slices(texts):
                who, start, length, crc, total = [], [], [], [], []
                for i, ids in enumerate(tokenizer.encode(texts[lo:hi])):
                    ids += end
                    for s, n, c in cut_pieces(ids, window):
                        who.append(lo + i)
                        start.append(s)
                        length.append(n)
                        crc.append(c)
                        total.append(len(ids) >> 2)
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(who, pa.int32())), *numbers],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    narrow = keyed_text(docs, id_col, text_col)
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, {PIECES}")


class CapacityTree:
    """Segment tree over remaining capacities 0..size; a node says whether a window is open below.

    Leaf c lists the open windows that have c tokens left. `tightest(need)` is the least c >= need
    with an open window, found by climbing until a right sibling is occupied and then descending
    to its leftmost occupied leaf.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, by: int) -> None:
        node = left + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, left: int) -> None:
        self.open[left].append(window)
        self._add(left, 1)

    def take(self, left: int) -> int:
        self._add(left, -1)
        return self.open[left].pop()

    def tightest(self, need: int) -> int | None:
        node = need + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        return node - self.width


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every length: longest first, each into the tightest open window."""
    tree = CapacityTree(window)
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    windows = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        left = tree.tightest(n)
        if left is None:
            w, left = windows, window
            windows += 1
        else:
            w = tree.take(left)
        where[i], offset[i] = w, window - left
        if left > n:
            tree.put(w, left - n)
    return where, offset


def pack(
    docs: DataFrame,
    vocab_path: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    group_rows: int = GROUP_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with `sequence_id` and `offset` of the window each one lies in.

    The token table is written once. Overlong documents are cut into full windows, which are
    sequences of their own. What remains of each document is dealt, by a hash of its row number in
    the written table, into groups of about `group_rows` that are packed side by side by best-fit decreasing; a group wastes
    a few windows at most, so the loss does not grow. `sequence_id` is group * 2^32 + window, with
    full windows in groups of their own after those; ids are unique, not dense. Sequences are padded
    to `window` by whoever writes them, unless their length is a power of two.

    Null and empty texts are one token (`end_id`); repeated rows are packed each for itself; an
    empty table gives an empty table; other columns are not read. The layout depends on the order of
    the rows, the pieces do not.
    """
    pieces = staged(token_pieces(docs, vocab_path, window, end_id, id_col, text_col), "pieces")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    rest = F.col("length") < window
    total = pieces.agg(F.count(F.when(rest, 1)).alias("n")).first()["n"]
    groups = max(1, -(-total // group_rows))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def pack_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(columns[1:] + ["doc_id"], kind="stable", ignore_index=True)
        where, offset = best_fit_decreasing(pdf["length"].to_numpy(np.int64), window)
        pdf["sequence_id"] = (pdf["_group"].to_numpy(np.int64) << 32) + where
        pdf["offset"] = offset
        return pdf[[*columns, "sequence_id", "offset"]]

    out = f"doc_id {kind}, {PIECES}, sequence_id bigint, offset bigint"
    packed = (
        pieces.filter(rest).withColumn("_group", spread).groupBy("_group").applyInPandas(pack_group, out)
    )
    # Full windows are numbered within salts that follow their count, never in one task.
    whole = pieces.filter(~rest).withColumn("_group", spread)
    number = F.row_number().over(W.partitionBy("_group").orderBy("doc_id", "start", "ids_crc32"))
    full = whole.withColumn("_n", number).select(
        *columns,
        (F.shiftleft(F.col("_group") + groups, 32) + F.col("_n")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
    )
    return packed.unionByName(full)
