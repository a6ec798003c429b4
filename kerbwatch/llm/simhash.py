"""Operator 5: SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from kerbwatch.llm.common import batches, bounded, texts_of
from kerbwatch.llm.components import connected_components
from kerbwatch.llm.covering import anchors
from kerbwatch.session import spread, staged

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
# An anchor with more fingerprints than this is not compared pair by pair.
CROWD = 64
# Fingerprints that a task sends to their anchors, some 61 each: it counts anchors in memory, about 80 bytes each.
TASK_PRINTS = 10_000
# Fingerprints whose anchors are made at once, as one Arrow batch of some 4 MB.
AT_ONCE = 4_000


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of the text's word shingles, repeats included; 0 for a text without words.

    A-Z become lower case, words end at a space or one of the characters 9 to 13. Both are the same
    on UTF-8 bytes, whose own `lower` and `split` know ASCII only.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle_words:
        hashes = np.array([digest(joined, SEED)], "<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: n - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "<u8", n - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, a 64-bit hash of the text, and the fingerprint as a signed long, of every row."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            made = np.array([fingerprint(t, shingle_words) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("hash"), pa.array(made.view(np.int64))],
                ["doc_id", "hash", "fingerprint"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = bounded(docs).select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, hash bigint, fingerprint bigint")


def _meetings(prints: DataFrame, max_bits: int, crowd: int) -> DataFrame:
    """(anchor, fingerprint, crowded) at every anchor where fingerprints can be compared.

    That takes two of them, and one at home. Anchors are counted first, combined before the
    shuffle, so the others are dropped, and one with more than `crowd` is known as crowded. The
    fingerprints are dealt by their number: a split of the written table, eight bytes a row, holds
    so many that the anchors of one fill a task's memory.
    """
    dealt = spread(prints, prints.count(), TASK_PRINTS)

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            own = batch.column("fingerprint").to_numpy()
            for lo in range(0, len(own), AT_ONCE):
                some = own[lo : lo + AT_ONCE]
                row, anchor, home = anchors(some.view(np.uint64), max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(some[row]), pa.array(home)],
                    ["anchor", "fingerprint", "home"],
                )

    sent = dealt.mapInArrow(run, "anchor bigint, fingerprint bigint, home boolean")
    counts = sent.groupBy("anchor").agg(F.count("*").alias("n"), F.max("home").alias("home"))
    busy = counts.filter("home and n > 1").select("anchor", (F.col("n") > crowd).alias("crowded"))
    # Busy anchors grow with the fingerprints; a broadcast that happens to fit would not hold later.
    return sent.select("anchor", "fingerprint").join(busy.hint("merge"), "anchor")


def forest(group: np.ndarray, prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each group, what chains of at most `max_bits` apart connect.

    Groups lie together. Every pair of a group is compared; what is returned is a link to the first
    of each connected set for all its others, so fewer links than rows.
    """
    n = len(prints)
    label = np.arange(n)
    ends = []
    i = np.arange(n)
    for lag in range(1, n):
        i = i[: np.searchsorted(i, n - lag)]
        i = i[group[i] == group[i + lag]]
        if not len(i):
            break
        near = i[np.bitwise_count((prints[i] ^ prints[i + lag]).view(np.uint64)) <= max_bits]
        if len(near):
            ends.append((near, near + lag))
    if ends:
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        while True:
            old = label.copy()
            np.minimum.at(label, b, label[a])
            np.minimum.at(label, a, label[b])
            label = label[label]
            if np.array_equal(old, label):
                break
    moved = np.flatnonzero(label != np.arange(n))
    return prints[label[moved]], prints[moved]


def _compare(meetings: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) among the fingerprints of each anchor, none of which is crowded."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, prints = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches(rows):
            group = np.concatenate((group, batch.column("anchor").to_numpy()))
            prints = np.concatenate((prints, batch.column("fingerprint").to_numpy()))
            whole = int(np.searchsorted(group, group[-1]))  # the last anchor may go on
            a, b = forest(group[:whole], prints[:whole], max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            group, prints = group[whole:], prints[whole:]
        a, b = forest(group, prints, max_bits)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    lined_up = meetings.repartition("anchor").sortWithinPartitions("anchor", "fingerprint")
    return lined_up.select("anchor", "fingerprint").mapInArrow(run, "a bigint, b bigint")


def _compare_crowded(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links among the fingerprints of crowded anchors, without comparing pairs.

    Here the anchors are refined to the finest covering code, all 2^64 words: a fingerprint is sent
    to every word within half the threshold, rounded up. Whatever meets at a word is at most the
    threshold apart for an even one; for an odd one the fingerprints that meet are compared. A word
    holds at most as many fingerprints as there are words around it (65 for two bits).
    """
    flips = [0] + [1 << i for i in range(64)] if max_bits else [0]
    signed = [f - (1 << 64) if f >> 63 else f for f in flips]
    around = F.explode(F.array(*[F.lit(f).cast("bigint") for f in signed])).alias("flip")
    sent = prints.select("fingerprint", around).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("word")
    )
    met = sent.groupBy("word").agg(F.sort_array(F.collect_list("fingerprint")).alias("all"))
    met = met.filter(F.size("all") > 1)
    if max_bits == 2:
        pairs = F.transform(
            F.slice("all", 2, 64), lambda b: F.struct(F.col("all")[0].alias("a"), b.alias("b"))
        )
    else:
        close = lambda a, b: (F.bit_count(a.bitwiseXOR(b)) <= max_bits) & (a < b)
        pairs = F.flatten(
            F.transform(
                "all",
                lambda a: F.transform(
                    F.filter("all", lambda b: close(a, b)),
                    lambda b: F.struct(a.alias("a"), b.alias("b")),
                ),
            )
        )
    return met.select(F.inline(pairs))


def linked_fingerprints(prints: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """`node`, `root` for every fingerprint with another at most `max_bits` away."""
    meetings = staged(_meetings(prints, max_bits, crowd), "meetings")
    light = _compare(meetings.filter("not crowded"), max_bits)
    crowded = meetings.filter("crowded").select("fingerprint").distinct()
    return connected_components(light.unionByName(_compare_crowded(crowded, max_bits)), "links")


def classes(prints: DataFrame, max_bits: int = MAX_BITS, crowd: int = CROWD) -> DataFrame:
    """`fingerprint`, `root`, `component_id` for every distinct fingerprint of `prints`.

    All of a component share a `root`; `component_id` is its least doc_id.
    """
    least = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-prints")
    linked = staged(linked_fingerprints(least.select("fingerprint"), max_bits, crowd), "components")
    joined = least.join(linked.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = joined.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(first, "root").select("fingerprint", "root", "component_id")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    crowd: int = CROWD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, `fingerprint` (16 hex digits) and `component_id` of every row.

    Fingerprints at most `max_bits` (0 to 2) apart are linked; `component_id` is the smallest doc_id
    reachable over links, the own one included. Equal fingerprints are brought to one before any
    comparison, so copies cost one row each. Null and empty texts have fingerprint zero and are
    linked like any other; repeated rows stay; a null doc_id counts as no doc_id, so a component of
    nulls alone has a null id; an empty table gives an empty table; other columns are not read.
    """
    prints = staged(fingerprints(docs, shingle_words, id_col, text_col), "prints")
    found = classes(prints, max_bits, crowd)
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return prints.join(found, "fingerprint").select("doc_id", hexed, "component_id")


def one_of_each(
    docs: DataFrame,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
    crowd: int = CROWD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """`docs` with one row of each component, that of the smallest doc_id; columns as they are.

    A row is known again by its doc_id and a hash of its text, so whole texts are shuffled once and
    by a key that no group of copies shares. A null doc_id counts as the largest. Of rows equal in
    doc_id and text one stays, the first by the other columns.
    """
    prints = staged(fingerprints(docs, shingle_words, id_col, text_col), "prints")
    found = classes(prints, max_bits, crowd)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")
    kept = (
        prints.groupBy("fingerprint").agg(F.min(row).alias("row"))
        .join(found, "fingerprint")
        .groupBy("root").agg(F.min("row").alias("row"))
        .select(
            _known(F.col("row.doc_id")).alias("__id"),
            F.col("row.none").alias("__none"),
            F.col("row.hash").alias("__hash"),
        )
    )
    key = ["__id", "__none", "__hash"]
    # The row's own columns stay in one of their own, whatever their names.
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"),
        _known(F.col(id_col)).alias("__id"),
        F.col(id_col).isNull().alias("__none"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__hash"),
    )
    plain = [
        F.col(f"own.`{f.name}`")
        for f in docs.schema
        if f.name not in (id_col, text_col) and not isinstance(f.dataType, (MapType, VariantType))
    ]
    turn = F.row_number().over(W.partitionBy(*key).orderBy(*(plain or [F.lit(0)])))
    once = marked.join(kept, key, "left_semi").withColumn("__turn", turn).filter("__turn = 1")
    return once.select(*[F.col(f"own.`{c}`").alias(c) for c in docs.columns])


def _known(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))
