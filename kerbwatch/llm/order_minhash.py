"""Operator 3: document fingerprints by Order MinHash."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbwatch.llm.common import batches, keyed_text, slices

KMER_UNITS = 2  # neighbouring units of a k-mer
TUPLE = 2  # k-mers of a signature entry; what follows is written for two
ENTRIES = 64  # entries of a signature, 16 bits each
AT_ONCE = 1_000_000  # characters whose k-mers a task holds
MAX_RANGES = 4096

# A unit is a run of characters that are not white space; of a longer run, every eight neighbouring ones.
_WIDTH = 8
_SPACE = np.array([chr(c).isspace() for c in range(sys.maxunicode + 1)])
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20)
_FLIPS = _rng.integers(0, 1 << 63, ENTRIES, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, ENTRIES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_INVERSES = np.array([pow(int(f), -1, 1 << 64) for f in _FACTORS], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _PRIME
    return (x ^ (x >> np.uint64(29))) * _PRIME


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of all texts, in order, and how many each text has."""
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.concatenate(([False], ~_SPACE[codes]))  # the last character is a space
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = turns[::2], turns[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    each = np.maximum(ends - begins - _WIDTH + 1, 1)
    sizes = np.bincount(np.searchsorted(text_ends, begins, side="right"), each, len(texts)).astype(np.int64)
    at = np.arange(int(each.sum())) + np.repeat(begins - (np.cumsum(each) - each), each)
    width = np.repeat(np.minimum(ends - begins, _WIDTH), each)
    hashes = width.astype(np.uint64) * _PRIME
    for k in range(_WIDTH):
        there = np.flatnonzero(width > k)
        hashes[there] = _mixed(hashes[there] + codes[at[there] + k])
    return hashes, sizes


def signatures(texts: list[str]) -> np.ndarray:
    """ENTRIES numbers of 16 bits for each text, whatever the texts beside it.

    K-mers are pairs of neighbouring units, numbered by occurrence in their text: the second time a
    k-mer occurs it is another one. For each entry all numbered k-mers get a random order; the two
    least are taken, put back into the order they have in the text, and hashed. A text of fewer
    units is one k-mer, an empty one a k-mer of nothing; an entry of one k-mer hashes that alone.
    Units slide within long runs, so an inserted character changes those that hold it and no others.
    """
    cuts = [_signatures(texts[lo:hi]) for lo, hi in slices(texts, AT_ONCE)]
    return np.concatenate(cuts) if cuts else np.empty((0, ENTRIES), np.uint16)


def _signatures(texts: list[str]) -> np.ndarray:
    units, sizes = _units(texts)
    # Each text's k-mers begin where its units do; short texts get one, made of what there is.
    counts = np.maximum(sizes - KMER_UNITS + 1, 1)
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - starts[owner]
    at = (np.cumsum(sizes) - sizes)[owner] + place
    units = np.concatenate((units, np.zeros(KMER_UNITS, np.uint64)))
    kmers = np.zeros(len(owner), np.uint64)
    for k in range(KMER_UNITS):
        there = place + k < sizes[owner]
        kmers = _mixed(kmers + np.where(there, units[at + k], np.uint64(k + 1)))
    del units, place, at, there
    # Occurrence numbers: places of one k-mer of one text lie together, in order, after a stable sort.
    salts = _mixed(np.arange(1, len(texts) + 1, dtype=np.uint64))
    of_text = kmers ^ salts[owner]
    order = np.argsort(of_text, kind="stable")
    same = np.concatenate(([False], of_text[order][1:] == of_text[order][:-1]))
    firsts = np.flatnonzero(~same)
    occurrence = np.empty(len(order), np.uint64)
    occurrence[order] = np.arange(len(order)) - firsts[np.cumsum(~same) - 1]
    numbered = _mixed(kmers + occurrence * _PRIME)
    del of_text, order, same, firsts, occurrence
    # An order is a bijection of 64 bits, so its least value tells the k-mer, and the k-mer its place.
    of_text = numbered ^ salts[owner]
    del owner
    order = np.argsort(of_text, kind="stable")
    of_text = of_text[order]

    def places(least: np.ndarray, m: int) -> np.ndarray:
        return order[np.searchsorted(of_text, ((least * _INVERSES[m]) ^ _FLIPS[m]) ^ salts)]

    alone = counts == 1
    out = np.empty((len(texts), ENTRIES), np.uint16)
    for m in range(ENTRIES):
        value = (numbered ^ _FLIPS[m]) * _FACTORS[m]
        least = np.minimum.reduceat(value, starts)
        one = places(least, m)
        value[one] = _LAST
        least = np.where(alone, least, np.minimum.reduceat(value, starts))
        two = places(least, m)
        left, right = kmers[np.minimum(one, two)], kmers[np.maximum(one, two)]
        joined = _mixed(left) * np.uint64(3) + np.where(alone, np.uint64(m), right)
        out[:, m] = (_mixed(joined ^ _FLIPS[m]) >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal entries."""
    return (a == b).mean(axis=1)


def fingerprint_text(signature: np.ndarray) -> list[str]:
    """Hexadecimal digits of each signature, four an entry."""
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next document."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


class _Neighbours:
    """Takes rows in order and gives back those whose successor is known, in slices."""

    def __init__(self, whole: bool):
        self.whole = whole  # is there a single range, whose last row is followed by its first
        self.rows: list[tuple] = []  # (range, halo, doc_id, text)
        self.first: tuple | None = None

    def pairs(self, last: bool) -> Iterator[tuple[object, str, str]]:
        rows, self.rows = self.rows, []
        for row, after in zip(rows, rows[1:], strict=False):
            if not row[1] and row[0] == after[0]:
                yield row[2], row[3], after[3]
            elif not row[1]:
                raise AssertionError("a range ends without the first row of the next one")
        if rows and not last:
            self.rows = rows[-1:]
        elif rows and not rows[-1][1]:
            if not self.whole:
                raise AssertionError("a range ends without the first row of the next one")
            yield rows[-1][2], rows[-1][3], self.first[3]


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The next document is the one with the next doc_id; the first one follows the last. Rows are dealt
    by doc_id into ranges that begin at quantiles, and the first row of each range is sent to the
    range before it too, so every row meets its successor in one shuffle of the texts, and a task
    streams through its ranges. Equal texts have equal fingerprints.

    Null texts count as empty. Rows of one doc_id follow each other by a hash of the text; null keys
    come last. A single row follows itself. Empty tables give empty tables; other columns are not
    read. The key must be a number.
    """
    spark = docs.sparkSession
    narrow = keyed_text(docs, id_col, text_col)
    ranges = min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / ranges for i in range(ranges)]
    # Quantiles are values of the column, the first is its least.
    bounds = sorted(set(narrow.approxQuantile("doc_id", shares, 1 / (4 * ranges))))
    kind = narrow.schema["doc_id"].dataType
    firsts = np.array([int(b) for b in bounds], np.int64)
    n = max(1, len(firsts))

    @F.pandas_udf("struct<own:int,before:int>")
    def dealt(keys: pd.Series) -> pd.DataFrame:
        given = keys.notna().to_numpy()
        known = keys.fillna(0).to_numpy(np.int64)
        own = np.where(given, np.searchsorted(firsts, known, side="right") - 1, n - 1)
        own = np.maximum(own, 0)
        leads = given & (n > 1) & (firsts[own] == known) if len(firsts) else np.zeros(len(keys), bool)
        return pd.DataFrame({"own": own, "before": np.where(leads, (own - 1) % n, -1)})

    placed = narrow.withColumn("_at", dealt(F.col("doc_id").cast("bigint")))
    both = F.array(
        F.struct(F.col("_at.own").alias("range"), F.lit(False).alias("halo")),
        F.struct(F.col("_at.before").alias("range"), F.lit(True).alias("halo")),
    )
    sent = placed.select("doc_id", "text", F.inline(F.filter(both, lambda b: b["range"] >= 0)))
    lined_up = sent.repartition("range").sortWithinPartitions(
        "range", "halo", F.col("doc_id").asc_nulls_last(), F.xxhash64("text")
    )

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = _Neighbours(n == 1)
        for batch in batches(rows):
            columns = [batch.column(c).to_pylist() for c in ("range", "halo", "doc_id", "text")]
            for lo, hi in slices(columns[3], AT_ONCE):
                near.rows += zip(*(c[lo:hi] for c in columns), strict=True)
                near.first = near.first or near.rows[0]
                yield from _results(list(near.pairs(False)), kind.simpleString())
        yield from _results(list(near.pairs(True)), kind.simpleString())

    return lined_up.mapInArrow(
        run,
        f"doc_id {kind.simpleString()}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}


def _results(pairs: list[tuple[object, str, str]], kind: str) -> Iterator[pa.RecordBatch]:
    if not pairs:
        return
    keys, texts, following = zip(*pairs, strict=True)
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # Successors are the rows after, so only the last of a run of rows is not among the texts.
    own = signatures([*texts, following[-1]])
    of_text = {t: i for i, t in enumerate([*texts, following[-1]])}
    missing = [f for f in set(following) if f not in of_text]
    if missing:
        of_text |= {f: len(own) + i for i, f in enumerate(missing)}
        own = np.concatenate((own, signatures(missing)))
    of_next = own[[of_text[f] for f in following]]
    own = own[: len(texts)]
    of_edited = signatures(changed)
    columns = [
        pa.array(keys, _ARROW.get(kind, pa.int64())),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        pa.array(fingerprint_text(own)),
        pa.array(fingerprint_text(of_edited)),
        pa.array(likeness(own, of_edited)),
        pa.array(likeness(own, of_next)),
    ]
    names = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next".split()
    yield pa.RecordBatch.from_arrays(columns, names)
