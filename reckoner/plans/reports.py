"""The three reports over evaluation tables of all runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reckoner.functions.text import mean_se
from reckoner.operators.bootstrap import bootstrap_f1, delta_f1_se
from reckoner.operators.confusion import COUNTS, assert_one, merge_groups, with_scores
from reckoner.schema import MULTI_INV, MULTI_PAY, ONE_ONE, PERTURBATIONS

# Order of the models and titles of the report columns.
MODEL_ORDER = ("gpt-3.5-turbo-1106", "gpt-4o-mini-2024-07-18", "gpt-4o-2024-08-06")
SCENARIOS = ("initial data", "+ errors", "+ multi-matches", "+ multiple tables")
ERROR_TITLES = {
    "clean": "initial (clean)", "perturbed_assignment_number": "assignment number",
    "perturbed_billing_number": "billing number", "perturbed_business_partner": "partner name",
    "small_deduction": "deduction ≤ $0.1",
}
MULTI = (MULTI_INV, MULTI_PAY)


def select_runs(df: DataFrame, **dims: str) -> DataFrame:
    """Rows of the runs with the given dimension values; prunes partitions where they are such."""
    for name, value in dims.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def of_runs(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the runs in ``runs``, which has some of the dimensions as columns: an equi join, by which Spark prunes the partitions of a written result table
    while it runs. Name a run once."""
    return df.join(runs, [c for c in runs.columns if c in df.columns], "left_semi")


def order_models(df: DataFrame, models: Sequence[str] = MODEL_ORDER) -> DataFrame:
    return df.orderBy(F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model")))


def difficulty_counts(results: DataFrame) -> DataFrame:
    """Confusion counts per model and scenario, from clean 1:1 to many tables. A run that is there twice raises."""
    multi_runs = select_runs(results, perturbation_mode="multi")
    opaque = F.col("schema_mode") == "opaque"
    several = F.col("key").isin(*MULTI) & (F.col("grouping") == "dirty")
    scenario = (
        F.when(opaque & (F.col("grouping") == "clean") & (F.col("key") == ONE_ONE), SCENARIOS[0])
        .when(opaque & (F.col("grouping") == "dirty") & (F.col("key") == ONE_ONE), SCENARIOS[1])
        .when(opaque & several, SCENARIOS[2])
        .when((F.col("schema_mode") == "multi-table") & several, SCENARIOS[3]))
    one = assert_one(multi_runs, ["model", "schema_mode", "grouping", "key"])
    return (one.withColumn("scenario", scenario).where(F.col("scenario").isNotNull())
            .groupBy("model", "scenario").agg(*[F.sum(c).alias(c) for c in COUNTS]))


def report_difficulty(results: DataFrame, rounds: int | None = 1000, seed: int = 0) -> DataFrame:
    """Model by scenario, cells ``F1 ± standard error``: by bootstrapping, or without ``rounds`` in closed form."""
    counts = difficulty_counts(results)
    if rounds is None:
        cells = with_scores(counts.withColumn("f1_se", delta_f1_se(F.col("TP"), F.col("FP"), F.col("FN"))))
    else:
        cells = with_scores(bootstrap_f1(counts, ["model", "scenario"], rounds, seed))
    cells = cells.select("model", "scenario", mean_se(F.col("f1"), F.col("f1_se")).alias("cell"))
    return order_models(cells.groupBy("model").pivot("scenario", list(SCENARIOS)).agg(F.first("cell")))


def report_precision_recall(results: DataFrame) -> DataFrame:
    """F1, precision and recall per model on dirty matches of several rows."""
    runs = select_runs(results, schema_mode="opaque", perturbation_mode="multi", grouping="dirty")
    merged = merge_groups(assert_one(runs, ["model", "key"]), "key", MULTI, ["model"])
    return order_models(with_scores(merged).select("model", F.col("f1").alias("f1_score"), "precision", "recall"))


def report_error_categories(results: DataFrame) -> DataFrame:
    """F1 per planted error and model."""
    runs = select_runs(results, schema_mode="opaque", perturbation_mode="single", grouping="perturbation")
    names = ["clean", *PERTURBATIONS]
    wide = with_scores(assert_one(runs, ["model", "key"])).groupBy("model").pivot("key", names).agg(F.first("f1"))
    shown: list[Column] = [F.col(k).alias(title) for k, title in ERROR_TITLES.items()]
    return order_models(wide.select("model", *shown))


def reports(results: DataFrame, rounds: int = 1000, seed: int = 0) -> dict[str, DataFrame]:
    return {
        "increasing_difficulty": report_difficulty(results, rounds, seed),
        "precision_recall": report_precision_recall(results),
        "error_categories": report_error_categories(results),
    }
