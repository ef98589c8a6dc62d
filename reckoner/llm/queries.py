"""One query per operator of this package, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reckoner.llm import binary, cover, html, licenses, lines, merkle, mixing, packing, perplexity, simhash, spots, toxicity, vectors
from reckoner.llm.common import on_workers, table
from reckoner.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = lambda spark, sf: f(on_workers(spark), sf)
    return f


@query
def op1_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), "words", kept_bytes=binary.KEPT_BYTES)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.labelled(table(spark, sf, "documents"))


@query
def op3_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op10_token_binary(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_path(spark, "binary")
    binary.write(table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), "spaces")
    return binary.read(spark, folder)


@query
def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return lines.judge(table(spark, sf, "documents"))


@query
def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(table(spark, sf, "pages"))


@query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op4_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return perplexity.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op5_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.grouped(table(spark, sf, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.linked(table(spark, sf, "embeddings"))


@query
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.audited(table(spark, sf, "documents"))


@query
def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return cover.hard_negatives(table(spark, sf, "embeddings"))


@query
def op12_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return spots.fingerprinted(table(spark, sf, "documents"))
