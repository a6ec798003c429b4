"""What the operators of this package share: table reading, Arrow batches, slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that a task holds in unpacked form at once.
SLICE_CHARS = 1_500_000
# Bytes of the rows that go to a Python worker at once; a longer row goes alone.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(docs: DataFrame) -> DataFrame:
    """Batches of rows that go to Python workers are bounded by bytes too, not by their number alone."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the key and the text, under fixed names; a null text becomes empty.

    Other columns of the input, whatever their names, go no further.
    """
    return bounded(docs).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the decimal key, modulo `divisor`; null keys count as remainder of the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(divisor))


def slices(texts: Sequence[str], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `chars` characters in all, one text at least."""
    lo = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield lo, i
            lo, held = i, 0
        held += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def batches(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches that hold rows."""
    return (b for b in rows if b.num_rows)


_TURNS = 1_000_000_000


def _turn(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(_TURNS))


def chosen(known: DataFrame, turn: Column, per_label: int) -> DataFrame:
    """About `per_label` rows of each label, by a hash and so whatever the order of the rows.

    Labels are counted first, then each keeps the share of the hash's range that holds as many rows
    as wanted; nothing is sorted or shuffled but the counts, of which there is one for each label.
    """
    counts = known.groupBy("label").count().collect()
    if not counts:
        return known
    cuts = [F.lit(min(_TURNS, _TURNS * per_label // r["count"])) for r in counts]
    names = [F.lit(r["label"]) for r in counts]
    return known.filter(turn < F.try_element_at(F.map_from_arrays(F.array(*names), F.array(*cuts)), F.col("label")))


def stretch(text: Column, most: int, key: str) -> Column:
    """The text, or of a longer one `most` characters from a place that the key's hash decides."""
    room = F.greatest(F.char_length(text) - most, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(key, F.lit(most)), room) + 1).cast("int"), F.lit(most))


def collected(rows: DataFrame, per_label: int, labels: int) -> list[tuple[str, object]]:
    """(text, label) of a sample, in an order that is its own; a bound holds should keys repeat."""
    few = rows.select("text", "label", "turn").limit(4 * per_label * max(1, labels)).collect()
    return [(r["text"], r["label"]) for r in sorted(few, key=lambda r: (r["turn"], r["text"]))]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, divisor: int, left_out: int, per_label: int, max_chars: int
) -> list[tuple[str, object]]:
    """(text, label) of about `per_label` labelled documents of each label, for a fit on the driver.

    Only keys whose remainder is not `left_out` are taken, and of long texts a stretch of `max_chars`.
    The sample is drawn from the table of labels alone and then broadcast, as its size is set by the parameters
    (two labels), so no text is shuffled. What comes to the driver is bounded by their product.
    """
    key = F.col("doc_id")
    known = labels.filter(key.isNotNull() & F.col(label).isNotNull() & (remainder(key, divisor) != left_out))
    known = known.select("doc_id", F.col(label).alias("label"))
    some = chosen(known, _turn("doc_id"), per_label).withColumn("turn", _turn("doc_id"))
    texts = keyed_text(docs, "doc_id", "text").select("doc_id", stretch(F.col("text"), max_chars, "doc_id").alias("text"))
    return collected(texts.join(F.broadcast(some), "doc_id"), per_label, 2)


def own_sample(docs: DataFrame, label: str, divisor: int, left_out: int, per_label: int, max_chars: int) -> list[tuple[str, object]]:
    """The same for documents that carry their label."""
    key = F.col("doc_id")
    known = docs.filter(key.isNotNull() & F.col(label).isNotNull() & (remainder(key, divisor) != left_out))
    known = known.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(label).alias("label"))
    some = chosen(known, _turn("doc_id"), per_label).withColumn("text", stretch(F.col("text"), max_chars, "doc_id"))
    return collected(some.withColumn("turn", _turn("doc_id")), per_label, known.select("label").distinct().count())


def scored(
    docs: DataFrame,
    divisor: int,
    left_out: int,
    make: Callable[[], Callable[[list[str]], np.ndarray]],
    threshold: float,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; `make` builds the scorer of a Python worker."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches(rows):
            texts = texts_of(batch)
            made = np.concatenate([score(texts[lo:hi]) for lo, hi in slices(texts)])
            kept = [batch.column("doc_id"), batch.column("held_out")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(made, pa.float64()), pa.array((made >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    narrow = keyed_text(docs, id_col, text_col).select(
        "doc_id", (remainder(F.col("doc_id"), divisor) == left_out).alias("held_out"), "text"
    )
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def kept_rows(
    docs: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], text_col: str = "text"
) -> DataFrame:
    """Rows of `docs`, whole and as they are, for whose texts the function of a worker says true."""

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = make()
        for batch in batches(rows):
            texts = texts_of(batch, text_col)
            mask = np.concatenate([keep(texts[lo:hi]) for lo, hi in slices(texts)])
            yield batch.filter(pa.array(mask.astype(bool)))

    return bounded(docs).mapInArrow(run, docs.schema)
