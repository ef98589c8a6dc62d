"""The training-data pipeline: stages over documents, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
``documents``. Labels come from ``sf_dir``; what is learned or counted comes from the stage's own input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reckoner.llm import mixing, packing, perplexity, simhash, toxicity
from reckoner.llm.common import on_workers, table, whole_row, written_table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. NULL and empty texts have a score like any other; repeated rows and ties share their verdict; without labels or rows
    nothing is rejected."""
    score = toxicity.scorer(toxicity.fit(docs, table(spark, sf_dir, "labels")))
    rows = docs.select(whole_row(docs), score(F.col("text").cast("string")).alias("score"))
    return rows.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the threshold of their language (a tie stays). NULL and empty texts have the mean of their language and stay; a NULL or rare
    language has the threshold of all; without trusted rows nothing is rejected; repeated rows share their verdict."""
    return perplexity.scored(docs, table(spark, sf_dir, "labels")).where(perplexity.accepted()).select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of the SimHash operator (three-word shingles, two bits): that with the least id. Empty texts are one group; rows without an id
    come after those with one; of repeated rows one stays; no rows give no rows."""
    return simhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. A NULL source is a source; a document without words is never drawn; rows with the same id and
    text share their copies; ties of the draw go by id and digest; no rows give no rows."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of all documents into sequences of 2048 tokens: a row per piece. A NULL or empty text is the end id alone; repeated rows are documents of their
    own; pieces of equal length are interchangeable, ties go by id and digest; no rows give no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "words")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic), ("quality", of_quality), ("near-dedup", without_copies), ("mix", mixed), ("packing", packed)]
#: Tokenizers and trained models are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(on_workers(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
