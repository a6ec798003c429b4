"""From raw documents to packed token windows: five stages, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kerbwatch.llm import langid, secret_scan, toxicity
from kerbwatch.llm.common import table
from kerbwatch.llm.packing import pack
from kerbwatch.llm.simhash import one_of_each
from kerbwatch.session import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in some learned language; the model is learned from the stage's own documents."""
    return langid.in_a_language(docs, langid.learn(docs))


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not predicted toxic; labels come from the table of labels."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: three-word shingles, at most two bits apart."""
    return one_of_each(docs, shingle_words=3, max_bits=2)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their secrets masked: those of few owners as secrets, others as copied examples."""
    return secret_scan.masked(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the token window each lies in."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("toxicity", non_toxic),
    ("SimHash near-dedup", near_dedup),
    ("secret scans", secrets_masked),
    ("packing", packing),
]

# Language models, connected components and tokenizers are beyond SQL; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
