"""Evaluation tables of one or many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from reckoner.operators.confusion import COUNTS, clean_or_dirty, confusion_aggs, error_counts

RUN = ("model", "schema_mode", "perturbation_mode")


def evaluate(scored: DataFrame, dims: Sequence[str] = RUN) -> DataFrame:
    """All groupings as rows (dims, grouping, key, counts): ``all``, ``match_category``, ``clean``,
    ``dirty`` (by match category) and ``perturbation``.

    Rows are counted once per (dims, category, label set), which is a few rows per run; the groupings
    are made of those."""
    labels = F.col("perturbation_categories")
    base = scored.groupBy(*dims, "match_category", "perturbation_categories").agg(*confusion_aggs())

    def entry(grouping, key):
        return F.struct(grouping.alias("grouping"), key.alias("key"))

    label = F.when(F.size(labels) == 0, F.array(F.lit("clean"))).otherwise(labels)
    entries = F.concat(
        F.array(entry(F.lit("all"), F.lit("")), entry(F.lit("match_category"), F.col("match_category")),
                entry(clean_or_dirty(labels), F.col("match_category"))),
        F.transform(label, lambda x: entry(F.lit("perturbation"), x)))
    return (base.select(*dims, F.explode(entries).alias("_e"), *COUNTS)
            .groupBy(*dims, F.col("_e.grouping").alias("grouping"), F.col("_e.key").alias("key"))
            .agg(*[F.sum(c).alias(c) for c in COUNTS]))


def errors(parsed: DataFrame, dims: Sequence[str] = RUN) -> DataFrame:
    """Failed and unread answers per run."""
    return error_counts(parsed, dims)
