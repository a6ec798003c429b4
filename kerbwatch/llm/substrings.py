"""Operator 11: removal of repeated word windows with an FM-index per shard."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbwatch.llm.common import batches, bounded, slices, texts_of
from kerbwatch.llm.fm_index import FmIndex

WINDOW = 20
ANCHOR = 4  # words whose hash decides which shard a window goes to
# Characters of a slice of texts that is cut into segments at once, and of a shard's own segments.
SLICE_CHARS = 6_000_000
SHARD_CHARS = 10_000_000
# Segments of an index that are searched in together.
INDEX_WORDS = 400_000
# An anchor is crowded if more segments than this hold it in a sample of one document in so many.
SAMPLE_EVERY = 64
CROWDED = 32
# At most so many anchors are crowded, whatever the input; 8 bytes each are broadcast.
MOST_CROWDED = 500_000
# Words whose hashes a Python worker keeps.
KEPT_WORDS = 1_000_000

_NO_DOC = -(1 << 63)
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _P1
    return x ^ (x >> np.uint64(29))


class WordHashes:
    """64-bit hashes of words, kept for the next batch."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > KEPT_WORDS:
            self.known = {}
        for w in set(words) - self.known.keys():
            self.known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverse, modulo 2^64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    ones = np.ones(n + 1, np.uint64)
    ones[1:] = base
    back = ones.copy()
    back[1:] = inverse
    return np.multiply.accumulate(ones), np.multiply.accumulate(back)


def rolling(hashes: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of the `size` words from each place on; places near the end are not for use."""
    up, down = _powers(len(hashes), base)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)))
    out = np.zeros(len(hashes), np.uint64)
    n = max(0, len(hashes) - size + 1)
    out[:n] = _mixed((sums[size:] - sums[: len(sums) - size]) * down[:n])
    return out


def window_least(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of the `size` values from each place on, by doubling."""
    out, done = values.copy(), 1
    while done < size:
        step = min(done, size - done)
        out[:-step] = np.minimum(out[:-step], out[step:])
        done += step
    return out


class Segments:
    """Runs of windows with one anchor, of a slice of texts.

    A window's anchor is the least hash of any ANCHOR words in it, so equal windows have equal
    anchors wherever they stand. A run's words are those of all its windows. Windows with a crowded
    anchor are runs of their own whose key is the hash of the whole window.
    """

    def __init__(self, texts: list[str], hashes: WordHashes, window: int, anchor: int, crowded: np.ndarray):
        cut = [t.encode().split() for t in texts]
        self.sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        words = [w for c in cut for w in c]
        self.texts = [b" ".join(c) for c in cut]
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        base = np.cumsum(self.sizes) - self.sizes
        self.ends = np.cumsum(lengths)  # of each word and the blank after it, over all texts
        self.begins = self.ends - lengths
        h = hashes.of(words)
        del words, cut
        text_of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        inside = np.arange(len(h)) - base[text_of]
        valid = np.flatnonzero(inside + window <= self.sizes[text_of])
        grams = rolling(h, anchor, _P1)
        key = window_least(grams, window - anchor + 1)[valid] if len(valid) else np.empty(0, np.uint64)
        one, two = rolling(h, window, _P2)[valid], rolling(h, window, _P1)[valid]
        if len(crowded) and len(valid):
            at = np.minimum(np.searchsorted(crowded, key), len(crowded) - 1)
            alone = crowded[at] == key
            key = np.where(alone, _mixed(one ^ _P1), key)
        else:
            alone = np.zeros(len(valid), bool)
        follows = np.diff(valid) == 1
        follows &= (text_of[valid][1:] == text_of[valid][:-1]) & (key[1:] == key[:-1]) & ~alone[1:] & ~alone[:-1]
        firsts = np.flatnonzero(np.concatenate(([True], ~follows))) if len(valid) else np.empty(0, np.int64)
        self.n = np.diff(np.append(firsts, len(valid)))
        self.key = key[firsts]
        self.word = valid[firsts]
        self.text = text_of[self.word]
        self.start = inside[self.word]
        self.window = window
        # A window that comes twice in a run lies less than the run's length apart.
        run = np.repeat(np.arange(len(firsts)), self.n)
        again = self.n > window - anchor + 1
        for apart in range(1, window - anchor + 1):
            same = np.flatnonzero((one[apart:] == one[:-apart]) & (run[apart:] == run[:-apart]))
            again[run[same]] = True
        self.again = again
        # Equal for equal words: the first and last windows and the hash of all of them.
        sums = [np.add.reduceat(x * _powers(len(x), _P1)[0][:-1], firsts) if len(firsts) else x for x in (one, two)]
        down = _powers(len(one), _P1)[1][firsts] if len(firsts) else np.empty(0, np.uint64)
        self.name = [s * down for s in sums]

    def words_of(self, i: int) -> bytes:
        a = self.word[i]
        shift = self.begins[a - self.start[i]]
        lo, hi = self.begins[a] - shift, self.ends[a + self.n[i] + self.window - 2] - shift - 1
        return self.texts[self.text[i]][lo:hi]


def _packed(arrays: list[np.ndarray], contents: list[bytes]) -> bytes:
    raw = struct.pack("<I", len(contents)) + b"".join(a.tobytes() for a in arrays) + b"\n".join(contents)
    return zstandard.ZstdCompressor(level=6).compress(raw)


_TYPES = ("<u4", "<i8", "<i8", "<i4", "<i4", "?")


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    at, arrays = 4, []
    for kind in _TYPES:
        arrays.append(np.frombuffer(raw, kind, n, at))
        at += arrays[-1].nbytes
    return arrays, raw[at:].split(b"\n")


def _merged(doc: np.ndarray, hash_: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
    """Intervals of words without overlaps, document by document."""
    order = np.lexsort((start, hash_, doc))
    doc, hash_, start, end = doc[order], hash_[order], start[order], (start + length)[order]
    if not len(doc):
        return [doc, hash_, start, end]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (hash_[1:] != hash_[:-1])))
    part = np.cumsum(new) - 1
    # Ends so far within a document: shift documents apart, so that one running maximum does.
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(part * far + end)
    fresh = np.concatenate(([True], part[1:] * far + start[1:] > reach[:-1])) | new
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    return [doc[first], hash_[first], start[first], reach[last] - part[first] * far - start[first]]


def segment_blobs(keyed: DataFrame, shards: int, window: int, anchor: int, crowded) -> DataFrame:
    """(shard, blob): the segments of a slice of texts that go to one shard, packed together.

    Of equal segments in a slice only the earliest is sent; the words of the others are known to be
    repeated and travel as intervals, under shard numbers beyond the shards.
    """

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        turn = 0
        for batch in batches(rows):
            texts = texts_of(batch)
            doc, hash_ = (batch.column(c).to_numpy() for c in ("doc", "hash"))
            for lo, hi in slices(texts, SLICE_CHARS):
                s = Segments(texts[lo:hi], hashes, window, anchor, crowded.value)
                if not len(s.n):
                    continue
                d, h = doc[lo:hi][s.text], hash_[lo:hi][s.text]
                order = np.lexsort((s.start, d, s.n, s.name[1], s.name[0], s.key))
                same = np.ones(len(order), bool)
                for part in (s.key, s.name[0], s.name[1], s.n):
                    same[1:] &= part[order[1:]] == part[order[:-1]]
                same[0] = False
                head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
                later = np.empty(len(order), bool)
                later[order] = (d[order] > d[head]) | (s.start[order] > s.start[head])
                out = np.flatnonzero(later)
                numbers, blobs = [], []
                if len(out):
                    gone = _merged(d[out], h[out], s.start[out], s.n[out] + window - 1)
                    none = [np.zeros(len(gone[0]), "<u4"), gone[0], gone[1], gone[2].astype("<i4"), gone[3].astype("<i4")]
                    numbers.append(shards + xxhash.xxh32_intdigest(struct.pack("<qq", int(d[0]), turn)) % shards)
                    blobs.append(_packed([*none, np.zeros(len(gone[0]), bool)], [b""] * len(gone[0])))
                turn += 1
                kept = np.flatnonzero(~later)
                shard = ((s.key[kept] >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                # By shard, then by place, as neighbours compress best.
                order = np.lexsort((s.word[kept], shard))
                kept, shard = kept[order], shard[order]
                cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    some = kept[a:b]
                    arrays = [s.key[some].astype("<u4"), d[some], h[some], s.start[some].astype("<i4"), s.n[some].astype("<i4"), s.again[some]]
                    numbers.append(int(shard[a]))
                    blobs.append(_packed(arrays, [s.words_of(i) for i in some.tolist()]))
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    return keyed.select("doc", "hash", "text").mapInArrow(run, "shard int, blob binary")


def repeated_in(arrays: list[np.ndarray], contents: list[bytes], window: int) -> list[np.ndarray]:
    """Intervals of words in windows that also start earlier, among the segments of one shard.

    Segments are grouped by key; a group is looked at if it has two segments, or one in which a
    window comes twice. Different segments are indexed once, under their earliest place. Each is
    streamed against the index: backward search gives the matching statistics of all its windows,
    and for those that match over the whole window the earliest window with those words.
    """
    key, doc, hash_, start, n, again = arrays
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order].astype(np.int64), prepend=-1, append=-1))
    shared = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    order = order[shared | again[order]]
    found: list[list[np.ndarray]] = []
    lo = 0
    sizes = n[order] + window
    while lo < len(order):  # whole groups at a time, of about INDEX_WORDS words
        hi = int(np.searchsorted(np.cumsum(sizes[lo:]), INDEX_WORDS)) + lo + 1
        while hi < len(order) and key[order[hi]] == key[order[hi - 1]]:
            hi += 1
        some = order[lo:hi]
        found.append(_searched([a[some] for a in (doc, hash_, start, n)], [contents[i] for i in some.tolist()], window))
        lo = hi
    if not found:
        return [np.empty(0, np.int64)] * 4
    return _merged(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _searched(arrays: list[np.ndarray], contents: list[bytes], window: int) -> list[np.ndarray]:
    doc, hash_, start, n = arrays
    order = np.lexsort((start, doc))
    doc, hash_, start, n = (a[order].astype(np.int64) for a in (doc, hash_, start, n))
    entry_of: dict[bytes, int] = {}
    entry = np.fromiter((entry_of.setdefault(contents[i], len(entry_of)) for i in order.tolist()), np.int64, len(order))
    _, first = np.unique(entry, return_index=True)  # the earliest holder of each different segment
    word_of: dict[bytes, int] = {}
    symbols = [word_of.setdefault(w, len(word_of) + 1) for c in entry_of for w in (*c.split(), b"")]
    text = np.array(symbols, np.int64)
    text[text == word_of[b""]] = 0
    # Places where a window of an entry starts, and their order by document and start.
    count = n[first]
    begin = np.concatenate(([0], np.cumsum(count + window)))[:-1]
    owner = np.repeat(np.arange(len(first)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = begin[owner] + within
    w_doc, w_start = doc[first][owner], start[first][owner] + within
    by_age = np.lexsort((w_start, w_doc))
    fresh = np.ones(len(by_age), bool)
    fresh[1:] = (w_doc[by_age[1:]] != w_doc[by_age[:-1]]) | (w_start[by_age[1:]] != w_start[by_age[:-1]])
    age = np.empty(len(by_age), np.int64)
    age[by_age] = np.cumsum(fresh) - 1
    worth = np.zeros(len(text), np.int64)
    worth[place] = age
    index = FmIndex(text, len(word_of), worth, window)
    earliest = age.copy()
    for lo in range(0, len(place), 100_000):
        some = place[lo : lo + 100_000]
        reached, _, least = index.matched(text[some[:, None] + np.arange(window)], window)
        long = np.flatnonzero(reached == window)
        earliest[lo + long] = np.minimum(least[long], earliest[lo + long])
    oldest = by_age[fresh]
    e_doc, e_start = w_doc[oldest][earliest], w_start[oldest][earliest]
    # Every holder of an entry against the earliest place of each of its windows.
    firsts = np.cumsum(count) - count
    rows = np.repeat(np.arange(len(entry)), n)
    inner = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    at = firsts[entry[rows]] + inner
    own = start[rows] + inner
    later = (doc[rows] > e_doc[at]) | ((doc[rows] == e_doc[at]) & (own > e_start[at]))
    hit = np.flatnonzero(later)
    return _merged(doc[rows[hit]], hash_[rows[hit]], own[hit], np.full(len(hit), window))


def repeated_intervals(blobs: DataFrame, shards: int, window: int) -> DataFrame:
    """(doc, hash, start, length) of repeated words; one shard at a time is in memory."""

    def told(intervals: list[np.ndarray]) -> pa.RecordBatch:
        doc, hash_, start, length = intervals
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(hash_, pa.int64()), pa.array(start, pa.int32()), pa.array(length, pa.int32())],
            ["doc", "hash", "start", "length"],
        )

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, contents = None, [], []

        def close() -> pa.RecordBatch:
            return told(repeated_in([np.concatenate(x) for x in zip(*parts, strict=True)], contents, window))

        for batch in batches(rows):
            for shard, blob in zip(batch.column("shard").to_pylist(), batch.column("blob"), strict=True):
                arrays, texts = _unpacked(blob.as_py())
                if shard >= shards:  # known to be repeated already
                    yield told(arrays[1:5])
                    continue
                if shard != now:
                    if parts:
                        yield close()
                    now, parts, contents = shard, [], []
                parts.append(arrays)
                contents += texts
        if parts:
            yield close()

    dealt = blobs.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "doc bigint, hash bigint, start int, length int")


def crowded_anchors(keyed: DataFrame, window: int, anchor: int, every: int, least: int) -> np.ndarray:
    """Hashes of anchors in very many segments, counted in one document of `every`.

    Only the balance of the shards depends on them. Equal segments of a slice count once.
    """

    nothing = np.empty(0, np.uint64)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches(rows):
            texts = texts_of(batch)
            for lo, hi in slices(texts, SLICE_CHARS):
                s = Segments(texts[lo:hi], hashes, window, anchor, nothing)
                names = np.unique(np.stack([s.key, s.name[0]]), axis=1)[0]
                key, n = np.unique(names, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    some = keyed.filter(F.pmod(F.xxhash64("doc", "hash"), F.lit(every)) == 0).select("text")
    counts = some.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    all_of = counts.agg(F.sum("n")).first()[0] or 0
    cut = max(least, all_of // MOST_CROWDED)
    found = [r["key"] for r in counts.filter(F.col("n") > cut).select("key").collect()]
    return np.sort(np.array(found, np.int64).view(np.uint64))


def _key(column: Column) -> Column:
    return F.coalesce(column.cast("bigint"), F.lit(_NO_DOC))


def without_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard_chars: int = SHARD_CHARS,
    sample_every: int = SAMPLE_EVERY,
    crowded: int = CROWDED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_removed, `kept` (words left, joined by one space) of every row.

    Words are `[^\\x20\\x09-\\x0D]+`. A word goes if some window of `window` words that covers it also
    starts earlier: in a smaller doc_id, or in the same one at an earlier word. Windows are those of
    the input. Documents are cut into overlapping segments by content, so that equal windows meet in
    one shard whatever the number of shards; a shard builds an FM-index of its different segments
    and streams them through it. Shards follow the size of the input, texts are shuffled compressed.

    Rows that share a doc_id count as that document each; a window is not earlier than one with the
    same doc_id and start, so repeated rows do not remove each other's words. A null doc_id comes
    before all others. Null and empty texts have no words; a text of fewer than `window` words keeps
    them; an empty table gives an empty table; other columns are not read. Equal segments of one
    slice are told by 128-bit hashes, all others by their words.
    """
    bounded(docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), _key(F.col(id_col)).alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))
    chars = keyed.agg(F.sum(F.char_length("text"))).first()[0] or 0
    shards = max(32, 4 * chars // shard_chars)
    busy = crowded_anchors(keyed, window, anchor, sample_every, crowded)
    blobs = segment_blobs(keyed, shards, window, anchor, docs.sparkSession.sparkContext.broadcast(busy))
    gone = repeated_intervals(blobs, shards, window)
    spans = gone.groupBy("doc", "hash").agg(F.collect_set(F.struct("start", "length")).alias("spans"))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            sizes, removed, kept = [], [], []
            for t, some in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = t.as_py().encode().split()
                keep = np.ones(len(words), bool)
                for s in some.as_py() or ():
                    keep[s["start"] : s["start"] + s["length"]] = False
                sizes.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    kind = keyed.schema["doc_id"].dataType.simpleString()
    joined = keyed.join(spans, ["doc", "hash"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def removal_digests(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    return without_repeats(docs, **settings).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )

