"""Confusion counts, scores and their groupings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reckoner.operators.keyed import with_key_values

COUNTS = ("TP", "FP", "TN", "FN")


def confusion_aggs(prediction: str | Column = "prediction", truth: str | Column = "truth") -> list[Column]:
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    t = F.col(truth) if isinstance(truth, str) else truth
    return [
        F.count_if(p & t).alias("TP"), F.count_if(p & ~t).alias("FP"),
        F.count_if(~p & ~t).alias("TN"), F.count_if(~p & t).alias("FN"),
    ]


def confusion(df: DataFrame, prediction: str = "prediction", truth: str = "truth") -> DataFrame:
    """Confusion counts of all rows."""
    return df.agg(*confusion_aggs(prediction, truth))


def confusion_by(df: DataFrame, keys: Sequence[str], where: Mapping[str, object] | None = None,
                 prediction: str = "prediction", truth: str = "truth") -> DataFrame:
    """Confusion counts per key tuple, optionally of the rows with the given key values only.

    Boolean counts are pre-aggregated per task, so a key with a third of all rows is one shuffled row."""
    for k, v in (where or {}).items():
        df = df.where(F.col(k) == F.lit(v))
    return df.groupBy(*keys).agg(*confusion_aggs(prediction, truth))


def confusion_total(counts: DataFrame) -> DataFrame:
    """Sum of confusion rows over all keys."""
    return counts.agg(*[F.sum(c).alias(c) for c in COUNTS])


def confusion_rollup(df: DataFrame, keys: Sequence[str], prediction: str = "prediction",
                     truth: str = "truth") -> DataFrame:
    """All levels from the full key tuple to the total in one pass; ``level`` counts the open keys."""
    open_keys = sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.rollup(*keys).agg(*confusion_aggs(prediction, truth), open_keys.alias("level"))


def merge_groups(counts: DataFrame, column: str, categories: Sequence[str],
                 keys: Sequence[str] = ()) -> DataFrame:
    """Add up the confusion rows of some categories."""
    return (counts.where(F.col(column).isin(*categories)).groupBy(*keys)
            .agg(*[F.sum(c).alias(c) for c in COUNTS]))


def confusion_by_label(df: DataFrame, labels: str = "perturbation_categories", clean: str = "clean",
                       prediction: str = "prediction", truth: str = "truth", name: str = "label",
                       keys: Sequence[str] = ()) -> DataFrame:
    """Confusion per label of a multi-label row; rows without labels count under ``clean``.

    Rows are counted per label set first, so only the few distinct sets are exploded."""
    per_set = df.groupBy(*keys, labels).agg(*confusion_aggs(prediction, truth))
    label = F.explode(F.when(F.size(labels) == 0, F.array(F.lit(clean))).otherwise(F.col(labels)))
    return (per_set.select(*keys, label.alias(name), *COUNTS).groupBy(*keys, name)
            .agg(*[F.sum(c).alias(c) for c in COUNTS]))


def with_scores(counts: DataFrame) -> DataFrame:
    """Add total, precision (1 without positive predictions), recall (0 without positive truths), F1."""
    tp, fp, tn, fn = (F.col(c) for c in COUNTS)
    return counts.withColumns({
        "total": tp + fp + tn + fn, "precision": precision(tp, fp), "recall": recall(tp, fn), "f1": f1(tp, fp, fn)})


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def precision(tp: Column, fp: Column) -> Column:
    return _ratio(tp, tp + fp, 1.0)


def recall(tp: Column, fn: Column) -> Column:
    return _ratio(tp, tp + fn, 0.0)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(F.lit(2) * tp, F.lit(2) * tp + fp + fn, 0.0)


def clean_or_dirty(labels: Column) -> Column:
    return F.when(F.size(labels) == 0, "clean").otherwise("dirty")


def assert_one(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` unchanged; a key with more than one row raises when the result is computed.

    One row per key is expected (finished runs, reports), so the check is a count per key."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    bad = F.raise_error(F.concat(F.lit("expected one row per key, found "), F.col("_n").cast("string")))
    checked = counted.withColumn("_n", F.when(F.col("_n") == 1, F.col("_n")).otherwise(bad.cast("bigint")))
    return with_key_values(df, checked, keys).where(F.col("_n") == 1).drop("_n")


def error_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Failed requests (no text) and answers that are neither yes nor no."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col("response_text").isNull()).alias("api_request_failed"),
        F.count_if(F.col("response_text").isNotNull() & F.col("parsed").isNull()).alias("parse_yes_no_failed"))


def finish_reasons(df: DataFrame, choices: str = "choices") -> DataFrame:
    """Answers per finish reason; failed requests under NULL."""
    reason = F.get(F.col(choices), F.lit(0))["finish_reason"]
    return df.groupBy(reason.alias("finish_reason")).agg(F.count(F.lit(1)).alias("n"))


def split_failed(df: DataFrame, choices: str = "choices") -> tuple[DataFrame, DataFrame]:
    """Answered rows, and the count of failed ones."""
    return (df.where(F.col(choices).isNotNull()),
            df.agg(F.count_if(F.col(choices).isNull()).alias("failed")))


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("rows_match").agg(F.count(F.lit(1)).alias("n"))
