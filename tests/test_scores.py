"""Scores, bootstrap and reports: golden counts, edge cases, brute force."""

import itertools

import pytest
from pyspark.sql import functions as F

from reckoner.operators import bootstrap, confusion
from reckoner.plans import evaluate, reports

COUNTS = "name string, TP bigint, FP bigint, TN bigint, FN bigint"


def scores(spark, *rows):
    df = confusion.with_scores(spark.createDataFrame(list(rows), COUNTS))
    return {r["name"]: r for r in df.collect()}


def test_golden_counts_give_the_published_scores(spark):
    got = scores(spark, ("a", 315, 9, 300, 76), ("b", 195, 1, 300, 196), ("c", 138, 1, 300, 253))
    assert got["a"].f1 == pytest.approx(0.8811188811188813) and got["a"].precision == pytest.approx(0.9722222222222222)
    assert got["a"].recall == pytest.approx(0.8056265984654731)
    assert got["b"].f1 == pytest.approx(0.6643952299829642)
    assert got["c"].f1 == pytest.approx(0.5207547169811321)


def test_scores_without_positives(spark):
    got = scores(spark, ("no prediction", 0, 0, 0, 3), ("no truth", 0, 2, 0, 0), ("nothing", 0, 0, 5, 0))
    assert (got["no prediction"].precision, got["no prediction"].recall, got["no prediction"].f1) == (1, 0, 0)
    assert (got["no truth"].recall, got["no truth"].f1) == (0, 0)
    assert (got["nothing"].precision, got["nothing"].f1, got["nothing"].total) == (1, 0, 5)


def test_bootstrap_error_of_golden_counts(spark):
    df = spark.createDataFrame([("a", 315, 9, 300, 76), ("b", 195, 1, 300, 196)], COUNTS)
    got = {r["name"]: r["f1_se"] for r in bootstrap.bootstrap_f1(df, ["name"], 1000, 1).collect()}
    assert got["a"] == pytest.approx(0.0134, abs=0.0015) and got["b"] == pytest.approx(0.0229, abs=0.0025)
    again = {r["name"]: r["f1_se"] for r in bootstrap.bootstrap_f1(df.repartition(5), ["name"], 1000, 1).collect()}
    assert got == again


def test_row_bootstrap_agrees_with_counts(spark):
    rows = [("k", i, i % 3 != 0, i % 5 != 0) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, id bigint, prediction boolean, truth boolean")
    by_rows = bootstrap.bootstrap_f1_rows(df, "k", 200, 3, "id").first().f1_se
    by_counts = bootstrap.bootstrap_f1(confusion.confusion_by(df, ["k"]), ["k"], 2000, 3).first().f1_se
    assert by_rows == pytest.approx(by_counts, rel=0.2)


def scored_rows():
    labels = [[], ["small_deduction"], ["small_deduction", "perturbed_billing_number"]]
    cats = ["one_pay_one_inv", "multi_pay_one_inv", "one_pay_multi_inv"]
    out = []
    for i, (c, e, p, t) in enumerate(itertools.product(cats, labels, (True, False), (True, False))):
        out += [("m", "opaque", "multi", c, e, p, t)] * (i % 4 + 1)
    return out


SCORED = ("model string, schema_mode string, perturbation_mode string, match_category string, "
          "perturbation_categories array<string>, prediction boolean, truth boolean")


def test_evaluation_tables_equal_brute_force(spark):
    rows = scored_rows()
    want = {}
    for *_, c, e, p, t in rows:
        keys = [("all", ""), ("match_category", c), ("dirty" if e else "clean", c)]
        keys += [("perturbation", x) for x in e or ["clean"]]
        cell = ("T" if p == t else "F") + ("P" if p else "N")
        for k in keys:
            want.setdefault(k, dict.fromkeys(confusion.COUNTS, 0))[cell] += 1
    got = {(r.grouping, r.key): {c: r[c] for c in confusion.COUNTS}
           for r in evaluate.evaluate(spark.createDataFrame(rows, SCORED)).collect()}
    assert got == want


def results(spark, model="gpt-4o-2024-08-06"):
    r = [(model, "opaque", "multi", "clean", "one_pay_one_inv", 90, 1, 90, 2),
         (model, "opaque", "multi", "dirty", "one_pay_one_inv", 80, 1, 90, 20),
         (model, "opaque", "multi", "dirty", "multi_pay_one_inv", 100, 1, 200, 96),
         (model, "opaque", "multi", "dirty", "one_pay_multi_inv", 95, 0, 100, 100),
         (model, "multi-table", "multi", "dirty", "multi_pay_one_inv", 60, 5, 200, 100),
         (model, "multi-table", "multi", "dirty", "one_pay_multi_inv", 60, 5, 200, 100),
         (model, "opaque", "single", "perturbation", "clean", 199, 5, 300, 4),
         (model, "opaque", "single", "perturbation", "small_deduction", 127, 5, 300, 4)]
    return spark.createDataFrame(r, "model string, schema_mode string, perturbation_mode string, grouping string, "
                                    "key string, TP bigint, FP bigint, TN bigint, FN bigint")


def test_reports(spark):
    both = results(spark).unionByName(results(spark, "gpt-3.5-turbo-1106"))
    difficulty = reports.report_difficulty(both, 500, 1).collect()
    assert [r.model for r in difficulty] == ["gpt-3.5-turbo-1106", "gpt-4o-2024-08-06"]
    assert difficulty[1]["+ multi-matches"].startswith("0.66 ± 0.0")
    assert difficulty[1]["initial data"].startswith("0.98 ± 0.0")
    pr = reports.report_precision_recall(both).collect()[0]
    assert pr.f1_score == pytest.approx(2 * 195 / (2 * 195 + 1 + 196)) and pr.precision == pytest.approx(195 / 196)
    errors = reports.report_error_categories(both).collect()[0]
    assert errors["initial (clean)"] == pytest.approx(398 / 407)
    assert errors["deduction ≤ $0.1"] == pytest.approx(254 / 263) and errors["partner name"] is None


def test_a_run_that_is_there_twice_raises(spark):
    twice = results(spark).unionByName(results(spark))
    with pytest.raises(Exception, match="expected one row per key"):
        reports.report_precision_recall(twice).collect()


def test_rollup_levels_add_up(spark):
    df = spark.createDataFrame(scored_rows(), SCORED)
    rolled = confusion.confusion_rollup(df, ["match_category", "schema_mode"])
    by_level = {r.level: r.n for r in rolled.groupBy("level").agg(F.sum("TP").alias("n")).collect()}
    assert len(set(by_level.values())) == 1
    total = confusion.confusion_total(confusion.confusion_by(df, ["match_category"])).first()
    assert total.TP == by_level[0]
