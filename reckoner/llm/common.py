"""Small helpers the operators of this package share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reckoner.session import shared_folder, written_table

#: ASCII white space, the separators of words (fixed value of the data contract).
SPACE = r"[\x20\x09-\x0D]+"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def on_workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the folder it is installed in. On a cluster without it, ship it with ``--py-files``."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and every other character as it is."""
    return F.translate(text, LETTERS, LETTERS.lower())


def words(text: Column, separators: str = SPACE) -> Column:
    """The words of ``text`` (NULL: none) between runs of ``separators``."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one named ``row``, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def least_rows(rows: DataFrame, key: str, *others: Column) -> DataFrame:
    """(key, row, others) with one ``row`` per ``key``: that with the least (doc_id, digest of the text, text), a NULL doc_id last. ``others`` are aggregates.
    Every task sends one row per key that it has met."""
    doc, text = F.col("row.doc_id").cast("long"), F.col("row.text").cast("string")
    order = F.struct(doc.isNull().alias("none"), doc.alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return rows.groupBy(key).agg(F.min_by("row", order).alias("row"), *others)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def digest_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` (all, if it has no more): those with the smallest digests of ``key``, found by a share of the
    digest's range. Nothing is sorted, and the same rows come each time."""
    share = min(1.0, rows / max(1, df.count()))
    return df if share == 1.0 else df.where(F.pmod(F.xxhash64(key), F.lit(2**30)) < F.lit(int(share * 2**30)))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to ``spark.checkpoint.dir`` with its lineage cut; Spark removes the copy when
    it is no longer referenced (``spark.cleaner.referenceTracking.cleanCheckpoints``)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


__all__ = ["SPACE", "on_workers", "table", "lower_ascii", "words", "whole_row", "least_rows", "partitions", "digest_sample", "checkpointed", "written_table"]
