"""NULL keys, weights that sum to zero, and permutations."""

import math
import time

import pytest
from pyspark.sql import functions as F

from reckoner import session
from reckoner.functions import draws
from reckoner.operators import bootstrap, confusion, joined, ranks, views

ROWS = [(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id long, k string").withColumn("v", F.col("id") * 10)


def test_null_is_a_key_like_any_other(df):
    assert {(r.id, r.pos) for r in ranks.position_in_group(df, ["k"], ["id"]).collect()} == {(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)}
    assert {(r.k, r.id, r.n_ids, r.v) for r in views.dedupe_by_key(df, ["k"], "id").collect()} == {("a", 1, 2, 10), (None, 3, 2, 30), ("b", 5, 1, 50)}
    assert {(r.id, r["head"]) for r in views.member_ids(df, ["k"], "id").collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)}
    assert {(r.k, r.id) for r in ranks.first_per_key(df, ["k"], "id").collect()} == {("a", 1), (None, 3), ("b", 5)}
    one = df.groupBy("k").agg(F.min("id").alias("id"))
    assert confusion.assert_one(one, ["k"]).count() == 3
    answers = df.withColumns({"prediction": F.col("id") < 4, "truth": F.col("id") < 3})
    assert {r.k for r in bootstrap.bootstrap_f1_rows(answers, "k", 5, 1, "id").collect()} == {"a", None, "b"}


def test_totals_split_for_null_groups_and_zero_weights(df):
    rows = df.withColumns({"total": F.lit("10.00").cast("decimal(15,2)"), "weight": F.when(F.col("k") == "a", F.lit(0)).otherwise(F.col("id")).cast("decimal(15,2)")})
    out = {r.id: str(r.part) for r in joined.split_group_total(rows, "k", "total", "weight", "id", "part").collect()}
    assert out == {1: "5.00", 2: "5.00", 3: "4.28", 4: "5.72", 5: "10.00"}


@pytest.mark.parametrize("n", [2, 50, 150, 450, 1000, 20_000])
def test_permutation_is_one_and_no_shift(spark, n):
    ids = spark.range(n)
    for size in (n, F.lit(n)):
        out = [r.p for r in ids.select("id", draws.permuted(F.col("id"), size, 9).alias("p")).orderBy("id").collect()]
        assert sorted(out) == list(range(n))
        if n > 2:
            assert not any(abs(a - b) == 1 for a, b in zip(out, out[1:]))


@pytest.mark.parametrize("n", [1, 2, 3, 50, 513, 1000, 20_000])
def test_keyed_permutation_has_no_constant_step(spark, n):
    out = [r.p for r in spark.range(n).select("id", draws.feistel(F.col("id"), n, 9, "t").alias("p")).orderBy("id").collect()]
    assert sorted(out) == list(range(n))
    if n >= 513:
        steps = {(b - a) % n for a, b in zip(out, out[1:])}
        assert len(steps) > 0.5 * n  # the steps of a random permutation: about 63 % of all numbers
        assert sum(a == i for i, a in enumerate(out)) < 8
    by_column = [r.p for r in spark.range(n).select("id", draws.feistel(F.col("id"), F.lit(n), 9, "t").alias("p")).orderBy("id").collect()]
    assert by_column == out


def test_samples_by_permutation_are_different_numbers_and_all_equally_likely(spark):
    rows = [r.s for r in spark.range(4000).select(draws.sample_ranks(40, 10, 3, "s", "id").alias("s")).collect()]
    assert all(len(set(s)) == 10 and min(s) >= 0 and max(s) < 40 for s in rows)
    for at in (0, 9):
        seen = [sum(s[at] == v for s in rows) for v in range(40)]
        assert sum((x - 100) ** 2 / 100 for x in seen) < 39 + 4.5 * math.sqrt(78) + 6
    assert sorted(spark.range(1).select(draws.sample_ranks(7, 7, 3, "s", "id").alias("s")).first().s) == list(range(7))


@pytest.mark.parametrize("n,p", [(1, 0.3), (16, 0.5), (17, 0.5), (40, 0.9), (300, 0.01), (5000, 0.4), (9, 0.0), (30, 1.0), (0, 0.5)])
def test_binomial_draws_follow_their_law(spark, n, p):
    rows = 6000
    drawn = spark.range(rows).select(draws.binomial(F.lit(n), F.lit(p), 3, "law", "id").alias("x"))
    got = {r.x: r["count"] for r in drawn.groupBy("x").count().collect()}
    assert all(0 <= x <= n for x in got)
    if p in (0.0, 1.0) or n == 0:
        assert got == {round(n * p): rows}
        return
    pmf = {x: math.exp(math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)) for x in range(n + 1)}
    cells, mass, seen = [], 0.0, 0  # neighbours put together until at least 20 are expected
    for x in range(n + 1):
        mass, seen = mass + pmf[x] * rows, seen + got.get(x, 0)
        if mass >= 20:
            cells.append((mass, seen))
            mass, seen = 0.0, 0
    cells[-1] = (cells[-1][0] + mass, cells[-1][1] + seen)
    chi = sum((s - m) ** 2 / m for m, s in cells)
    df = max(1, len(cells) - 1)
    assert chi < df + 4.5 * math.sqrt(2 * df) + 6


@pytest.mark.parametrize("counts", [(40, 10, 30, 20), (500, 0, 500, 0), (300, 30, 100, 70), (60, 30, 40, 50)])
def test_closed_form_error_is_what_the_bootstrap_finds(spark, counts):
    row = spark.createDataFrame([("x", *counts)], "k string, TP long, FP long, TN long, FN long")
    both = bootstrap.bootstrap_f1(row, ["k"], 4000, 3).withColumn("c", bootstrap.delta_f1_se(F.col("TP"), F.col("FP"), F.col("FN"))).first()
    assert abs(both.f1_se - both.c) <= 0.1 * both.c


def test_a_run_that_is_there_twice_raises(spark):
    from reckoner.plans.reports import report_difficulty

    rows = [("m", "opaque", "multi", "dirty", "one_pay_one_inv", 3, 1, 2, 1)]
    results = spark.createDataFrame(rows * 2, "model string, schema_mode string, perturbation_mode string, grouping string, key string, TP long, FP long, TN long, FN long")
    assert report_difficulty(results.limit(1), None).first()["+ errors"] == "0.75 ± 0.17"
    with pytest.raises(Exception, match="expected one row"):
        report_difficulty(results, None).collect()


def test_cleanup_removes_written_tables(spark):
    from pathlib import Path

    from reckoner import session

    df = session.written_table(spark.range(5), "some")
    path = Path(df.inputFiles()[0].removeprefix("file://")).parent
    others = session._WRITTEN[spark.sparkContext.applicationId]
    session._WRITTEN[spark.sparkContext.applicationId] = [p for p in others if Path(p).name == path.name]
    assert path.exists() and session.cleanup(spark) == 1 and not path.exists()
    session._WRITTEN[spark.sparkContext.applicationId] = [p for p in others if Path(p).name != path.name]


def test_matches_with_an_empty_side_keep_their_negatives(spark):
    from reckoner.operators import pairs

    info = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "match_id long, match_category string")
    inv = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "match_id long, invoice_id long")
    pay = spark.createDataFrame([(2, 200), (3, 300), (3, 301)], "match_id long, payment_id long")
    rows = pairs.build_pairs(info, inv, pay).orderBy("pair_id").collect()
    assert [(r.pair_id, r.drawn_for, r.kind) for r in rows] == [
        (0, 1, "invoice_driven"), (1, 1, "invoice_driven"), (2, 2, "invoice_driven"), (3, 2, "match"), (4, 2, "payment_driven"),
        (5, 3, "payment_driven"), (6, 3, "payment_driven")]
    assert [(r.invoice_id, r.payment_id) for r in rows if r.kind == "match"] == [(20, 200)]
    assert all(r.payment_id not in (200,) for r in rows if r.kind == "invoice_driven" and r.drawn_for == 2)


@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_merged_rows_keep_every_id(spark, df, chunk):
    """Each id of a key is in one of its lists, whatever their length; the attributes are those of the lowest id."""
    rows = views.merged_by_key(df, ["k"], "id", chunk).collect()
    assert sorted((r.k or "", i) for r in rows for i in r.id) == [("", 3), ("", 4), ("a", 1), ("a", 2), ("b", 5)]
    assert {(r.k, r.v, r.n_ids) for r in rows} == {("a", 10, 2), (None, 30, 2), ("b", 50, 1)}
    assert all(r.id == sorted(r.id) for r in rows) and len({(r.k, r.part) for r in rows}) == len(rows)
    assert len(rows) == 3 if chunk > 1 else len(rows) >= 3
    keys_only = views.merged_by_key(df.select("id", "k"), ["k"], "id", chunk).collect()
    assert sorted(i for r in keys_only for i in r.id) == [1, 2, 3, 4, 5]


def test_merged_rows_of_large_keys_are_dealt(spark):
    rows = views.merged_by_key(spark.range(1000).select("id", (F.col("id") % 2).alias("k"), F.col("id").alias("v")), ["k"], "id", 20).collect()
    assert sorted(i for r in rows for i in r.id) == list(range(1000)) and max(len(r.id) for r in rows) < 60
    assert {(r.k, r.v, r.n_ids) for r in rows} == {(0, 0, 500), (1, 1, 500)} and {r.part for r in rows} == set(range(25))


FIRST_RANKS = {  # of the permutation as first built
    1: [631, 437, 721, 606, 96, 286, 977, 430, 3, 169, 266, 280, 667, 554, 361, 717, 943, 794, 565, 730, 709, 159, 868, 115, 93, 372, 592, 548, 290, 64, 100, 321, 855, 561, 981, 598, 373, 69, 240, 11, 689, 58, 241, 681, 395, 185, 149, 706, 463, 242],
    None: [49, 778, 831, 770, 127, 77, 646, 926, 16, 931, 911, 44, 638, 551, 736, 295, 357, 440, 800, 864, 227, 756, 859, 709, 771, 541, 266, 87, 336, 532, 705, 893, 899, 738, 317, 742, 348, 388, 953, 550, 657, 976, 698, 587, 752, 861, 788, 642, 969, 331],
}


def test_few_numbers_walk_and_all_are_as_before(spark):
    """The first numbers of a permutation as they have always been, with a NULL key as well; a walk is taken for the numbers that leave the range only."""
    rows = spark.createDataFrame([(1,), (None,)], "k long").select("k", draws.sample_ranks(1000, 50, 7, "ranks", "k").alias("s"))
    got = {r.k: r.s for r in rows.collect()}
    assert got == FIRST_RANKS and all(len(set(s)) == 50 for s in got.values())
    steps = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(sequence(0" not in steps and "aggregate([0," not in steps


def test_rows_of_one_group_are_spread(spark):
    from reckoner.session import spread_rows

    assert spread_rows(spark.range(100).coalesce(1)).rdd.getNumPartitions() > 1


def test_shuffle_files_go_with_their_job(spark):
    """Only a running job holds shuffle files, and a DataFrame that runs again makes them again."""
    session.configure(spark)
    found = lambda: {n for n in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|") if "shuffle_" in n}
    before = found()
    df = spark.range(1000, numPartitions=4).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    first = sorted(df.collect())
    end = time.time() + 20
    while found() - before and time.time() < end:
        time.sleep(0.1)
    assert not found() - before
    assert sorted(df.collect()) == first and len(first) == 7


def test_intermediate_tables_are_written_small(spark):
    df = ranks.dense_id(spark.range(20), ["id"], "n")
    assert all(f.endswith(".zstd.parquet") for f in df.inputFiles())
