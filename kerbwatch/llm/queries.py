"""The operators of this package over their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kerbwatch.llm import centroids, filter_audit, langid, pii, secret_scan
from kerbwatch.llm.ann import neighbours
from kerbwatch.llm.bpe import round_trip_digests
from kerbwatch.llm.common import table
from kerbwatch.llm.order_minhash import fingerprinted
from kerbwatch.llm.packing import pack
from kerbwatch.llm.quality import quality
from kerbwatch.llm.simhash import near_duplicates
from kerbwatch.llm.substrings import removal_digests
from kerbwatch.llm.toxicity import toxicity

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(f):
    REGISTRY[f.__name__] = f
    return f


@registered
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


@registered
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.language(docs, langid.learn(docs))


@registered
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))


@registered
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.secret_spans(table(spark, sf_dir, "documents")))


ORACLES["op4_secrets"] = secret_scan.SQL


@registered
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


@registered
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@registered
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), k=20, query_divisor=20)


@registered
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, key="documents")


@registered
def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))


@registered
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


ORACLES["op12_centroids"] = centroids.sql()


@registered
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = filter_audit.sql()
