"""Operator 13: what each document filter removes in every order, with a counting-Bloom prepass."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerbwatch.llm.common import batches, texts_of
from kerbwatch.session import staged

LETTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT = 80  # per cent of the words
MOST_CAPITALS = 10  # per cent of the code points
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))

# The sketch: cells a text counts in, cells per row, and the most cells (32 MB as bits). Beyond the
# bound more unique texts count as possible repeats; results do not depend on it.
HASHES = 3
CELLS_PER_ROW = 8
MOST_CELLS = 1 << 28
_PAGE = 8 * 4096  # cells in one value of the bitmap functions


def failures(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # on bytes exactly at a space and the characters 9 to 13
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text)) << 2
        | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3
    )


def cells_of(text: Column, cells: int) -> list[Column]:
    """The cells of the sketch in which a text counts."""
    return [F.pmod(F.xxhash64(text, F.lit(i)), F.lit(cells)) for i in range(HASHES)]


def possible_repeats(docs: DataFrame, text: Column, most_cells: int = MOST_CELLS) -> np.ndarray:
    """One bit per cell of a counting Bloom filter over all texts: set where two or more count.

    Every task counts its own cells; the merge adds the counts, and cells at one or none are cleared.
    Only counts are shuffled. `most_cells` / 8 bytes at most come to the driver.
    """
    wanted = max(_PAGE, CELLS_PER_ROW * docs.count())
    cells = min(most_cells, 1 << (wanted - 1).bit_length())
    counted = docs.select(F.explode(F.array(*cells_of(text, cells))).alias("cell")).groupBy("cell").count()
    number = F.col("cell") + 1  # the bitmap functions count from one
    pages = (
        counted.filter("count > 1")
        .groupBy(F.bitmap_bucket_number(number).alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    )
    bits = np.zeros(-(-cells // _PAGE) * _PAGE // 8, np.uint8)
    for r in pages.toLocalIterator():
        lo = (r["page"] - 1) * (_PAGE // 8)
        bits[lo : lo + _PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits[: max(1, cells // 8)]


def flagged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """doc_id, part and `mask` of every row: bit i is set if the row fails filter i of ABCDE.

    E compares whole texts. The sketch clears texts that are alone in one of their cells; only the
    others are grouped by full text for the smallest doc_id, with one row per text and task. A row
    passes E if it is the first of its text, which is known by doc_id and hash, so a text with many
    copies is no hot key of the join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = docs.sparkSession.sparkContext.broadcast(possible_repeats(docs, text, most_cells))
    cells = 8 * len(bits.value)
    cols = [f"cell_{i}" for i in range(HASHES)]

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        busy = bits.value
        for batch in batches(rows):
            mask = np.fromiter(map(failures, texts_of(batch)), np.int32, batch.num_rows)
            maybe = np.ones(batch.num_rows, bool)
            for c in cols:
                cell = batch.column(c).to_numpy()
                maybe &= (busy[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
            kept = pa.array(maybe)
            texts = pc.if_else(kept, batch.column("text"), pa.scalar(None, batch.schema.field("text").type))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("hash"), pa.array(mask), kept, texts],
                ["doc_id", "part", "hash", "mask", "maybe", "text"],
            )

    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.xxhash64(text).alias("hash"),
        text.alias("text"),
        *[c.alias(n) for c, n in zip(cells_of(text, cells), cols, strict=True)],
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    made = staged(
        narrow.mapInArrow(run, f"doc_id {kind}, part string, hash bigint, mask int, maybe boolean, text string"), "audited"
    )
    repeats = made.filter("maybe and doc_id is not null")
    firsts = repeats.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.min("hash").alias("hash"))
    first = firsts.select("doc_id", "hash", F.lit(True).alias("first"))
    checked = repeats.select("doc_id", "part", "hash", "mask").join(first, ["doc_id", "hash"], "left")
    last = F.when(F.col("first").isNull(), F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask"))
    checked = checked.select("doc_id", "part", last.alias("mask"))
    return checked.unionByName(made.filter("not maybe or doc_id is null").select("doc_id", "part", "mask"))


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: counts that add up, at most 32 rows a part."""
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"),
    )
    joined = rows.join(known, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(
        F.count("*").alias("docs"),
        F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def _steps() -> list[dict]:
    out = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            own = 1 << LETTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": step, "own": own, "before": before})
            before |= own
    return out


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    most_cells: int = MOST_CELLS,
) -> DataFrame:
    """Counts of every part, order of the five filters and step; see the columns in `sql`.

    All 600 rows of a part come from its mask counts. A null text counts as empty, a null part as the
    empty name. A row without a doc_id has no smaller doc_id and is none, so it passes E and takes no
    part in it; rows that share a doc_id are rows of their own; a document with several label rows is
    good, or toxic, if one of them says so. Without documents there is no part and no row. Other
    columns are not read.
    """
    masks = mask_counts(flagged(docs, id_col, text_col, part_col, most_cells), labels)
    kind = "array<struct<filter_order: string, step: int, own: int, before: int>>"
    steps = F.from_json(F.lit(json.dumps(_steps())), kind)
    rows = masks.select("*", F.inline(steps))
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0

    def total(condition: Column, of: str = "docs") -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(F.lit(0)))

    counted = rows.groupBy("part", "filter_order", "step", "own").agg(
        total(~earlier & ~fails).alias("kept"),
        total(~earlier & fails).alias("removed"),
        total(earlier & fails).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(~earlier & fails, "good").alias("good_lost"),
        total(~earlier & fails, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(W.partitionBy("part", "own"))
    return counted.withColumn("shapley", shapley).drop("own")


def sql() -> str:
    """The same results for DuckDB."""
    steps = ", ".join(f"('{s['filter_order']}', {s['step']}, {s['own']}, {s['before']})" for s in _steps())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
f AS (SELECT doc_id, part,
  CAST(len(ws) < {LEAST_WORDS} AS INTEGER)
  + 2 * CAST(100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) AS INTEGER)
  + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(t) AS INTEGER)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
  + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask FROM w),
l AS (SELECT doc_id, max(CAST(quality IS NOT DISTINCT FROM 1 AS INTEGER)) AS good,
  max(CAST(toxic IS NOT DISTINCT FROM 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, mask, count(*) AS docs, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o(filter_order, step, own, before) AS (VALUES {steps}),
s AS (SELECT part, filter_order, step, own,
  CAST(coalesce(sum(docs) FILTER (mask & (before | own) = 0), 0) AS BIGINT) AS kept,
  CAST(coalesce(sum(docs) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(docs) FILTER (mask & before <> 0 AND mask & own <> 0), 0) AS BIGINT) AS redundant,
  CAST(coalesce(sum(docs) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS good_lost,
  CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0) AS BIGINT) AS toxic_lost
  FROM m, o GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM s"""
