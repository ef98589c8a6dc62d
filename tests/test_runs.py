"""Requests, cache, costs, decisions, files, streaming and plans."""

import json

import pytest
from pyspark.sql import functions as F

from reckoner import queries
from reckoner.operators import audit, decide
from reckoner.plans import execute, reports
from reckoner.sources import tables
from reckoner.streaming import rowwise
from tests.plans import up_to_join

FOLDER = "/root/testdata/sf0.001"


def requests_frame(spark, rows):
    return spark.createDataFrame(rows, tables.REQUESTS)


def request(i, model="gpt-4o-2024-08-06", limit=10, seed=1, temperature=0.0, text="abcd" * 10):
    return (i, model, limit, temperature, seed, [("user", text)], None, None, None)


def test_audit_codes_bounds_and_cost(spark):
    reqs = requests_frame(spark, [request(1), request(2, limit=None, seed=None), request(3, limit=20000, temperature=0.5),
                                  request(4, "gpt-3.5-turbo-1106", 16380)])
    cache = spark.createDataFrame([], tables.CACHE)
    got = {r.pair_id: r for r in audit.audit_requests(reqs, cache, audit.model_catalogue(spark)).collect()}
    assert got[1].issues == [] and (got[1].max_input_usage, got[1].max_output_usage) == (15, 10)
    assert got[1].max_cost == pytest.approx(15 * 0.0025 / 1000 + 10 * 0.01 / 1000)
    assert got[2].issues == ["no_seed"] and got[2].max_output_usage == 16384
    assert got[3].issues == ["limit_exceeds_model", "temperature_not_zero"]
    assert got[4].issues == ["limit_exceeds_model", "total_exceeds_context"]
    with pytest.raises(Exception, match="unknown model other"):
        audit.with_model(requests_frame(spark, [request(1, "other")]), audit.model_catalogue(spark)).collect()


def test_cache_hits_need_the_same_request(spark, tmp_path):
    reqs = audit.with_hash(requests_frame(spark, [request(1), request(2, text="x"), request(3, text="y")]))
    row = "pair_id bigint, model string, choices array<struct<finish_reason:string,message:struct<content:string>>>"
    answers = spark.createDataFrame([(1, "m", [("stop", ("Yes",))]), (2, "m", None)], row)
    tables.write_cache(reqs, answers, str(tmp_path / "cache"))
    cache = tables.read_cache(spark, str(tmp_path / "cache"))
    assert {r.pair_id for r in audit.cache_misses(reqs, cache).collect()} == {2, 3}
    hit = {r.pair_id: r.cached_response for r in audit.lookup_cache(reqs, cache).collect()}
    assert json.loads(hit[1])["choices"][0]["message"]["content"] == "Yes" and hit[2] is None
    stale = cache.withColumn("request", F.lit("other"))
    assert audit.cache_misses(reqs, stale).count() == 3
    back = audit.cached_responses(cache).first()
    assert back.choices[0].message.content == "Yes" and back.usage is None


def test_the_cache_is_read_once_and_not_shuffled(spark):
    chats = audit.with_hash(queries.chat_requests(spark, FOLDER))
    cache = tables.cache_table(queries.chat_cache(spark, FOLDER))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        split = audit.split_by_cache(chats, cache)
        above = up_to_join(split, "FileScan parquet spark_catalog")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(above) == 1 and "Exchange" not in above[0] and above[0][-1].endswith("Join"), above


def test_a_run_counts_what_it_did_and_a_second_one_adds_nothing(spark):
    calls = []

    def scorer(misses):
        calls.append(1)
        return queries.chat_scorer(misses)

    cache = queries.chat_cache(spark, FOLDER)
    first = execute.execute(queries.chat_requests(spark, FOLDER), cache, scorer)
    assert calls == [1] and first.responses.count() == first.counts["requests"] == sum(first.counts[s] for s in audit.STATES)
    assert first.counts["failed"] == first.responses.where("choices is null").count() > 0
    assert first.counts["cut_off"] == first.responses.where("not cached and choices[0].finish_reason = 'length'").count()
    assert first.counts["hit"] == first.responses.where("cached").count() > 0 and first.counts["stale"] > 0
    again = execute.execute(queries.chat_requests(spark, FOLDER), cache.union(first.added), scorer)
    assert again.added.count() == 0 and again.counts["miss"] + again.counts["stale"] == first.counts["failed"] == again.counts["failed"]


def test_decisions(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "pair_id bigint, rows_match boolean")

    def batches(frames):
        for f in frames:
            yield f.assign(response_text=["Yes" if i == 1 else "maybe" for i in f["pair_id"]])

    out = {r.pair_id: r for r in decide.resolve(decide.with_parsed(decide.decide(df, batches))).collect()}
    assert out[1].prediction is True and out[2].parsed is None and out[2].prediction is True
    by_column = decide.decide(df, F.when(F.col("pair_id") == 1, "Yes")).collect()
    assert [r.response_text for r in by_column] == ["Yes", None]
    missing = spark.createDataFrame([(1, "m", None, None)], tables.RESPONSES)
    with pytest.raises(Exception, match="no response for pair 2"):
        decide.score_responses(df, missing).collect()


def test_foreign_results_and_reports(spark, tmp_path):
    text = json.dumps({"one_pay_one_inv": {"TP": 1, "FP": 2, "TN": 3, "FN": 4}})
    df = tables.results_from_maps(spark.createDataFrame([("m", text)], "model string, t string"), "t", "clean")
    assert [tuple(r) for r in df.collect()] == [("m", "clean", "one_pay_one_inv", 1, 2, 3, 4)]
    run = df.withColumns({"schema_mode": F.lit("opaque"), "perturbation_mode": F.lit("multi")})
    tables.write_results(run, str(tmp_path / "r"))
    assert tables.load_results(spark, str(tmp_path / "r")).where("model = 'm'").count() == 1
    tables.write_report(df, str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.csv"))) == 1


def test_runs_are_found_from_files_and_pruned_by_dataset(spark, tmp_path):
    base = tmp_path / "task"
    counts = {"TP": 1, "FP": 2, "TN": 3, "FN": 4}
    for dataset, n in (("pay_to_inv", 2), ("two words", 1)):
        for i in range(n):
            folder = base / dataset / "experiments" / f"exp-{i}_m{i}_opaque_multi" / "results"
            folder.mkdir(parents=True)
            (folder / "confusion.json").write_text(json.dumps(counts, indent=2))
            (folder / "clean_confusion_by_match_category.json").write_text(json.dumps({"a": counts, "b": {**counts, "TP": 9}}))
            (folder / "errors.json").write_text("{}")
            (folder.parent / "confusion.json").write_text("not a result")
    found = tables.runs_from_files(spark, str(base))
    rows = sorted(tuple(r) for r in found.collect())
    assert len(rows) == 9 and rows[0] == ("pay_to_inv", "m0", "opaque", "multi", "exp-0_m0_opaque_multi", "all", "", 1, 2, 3, 4)
    assert {r[0] for r in rows} == {"pay_to_inv", "two words"} and ("two words", "m0", "opaque", "multi", "exp-0_m0_opaque_multi", "clean", "b", 9, 2, 3, 4) in rows
    path = str(tmp_path / "table")
    tables.write_results(found, path)
    results = tables.load_results(spark, path)
    one = reports.select_runs(results, dataset="two words")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and one.count() == 3
    # runs named by a table: partitions are pruned while the query runs
    wanted = spark.createDataFrame([("pay_to_inv", "m1", 1), ("two words", "m0", 0)], "dataset string, model string, wanted int")
    tables.write_report(wanted, str(tmp_path / "wanted"))
    wanted = spark.read.schema(wanted.schema).option("header", "true").csv(str(tmp_path / "wanted")).where("wanted = 1")
    some = reports.of_runs(results, wanted.select("dataset", "model"))
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString() and {r.model for r in some.collect()} == {"m1"}


def test_requests_and_labels_through_json(spark, tmp_path):
    reqs = requests_frame(spark, [request(1), request(2, limit=None)])
    tables.write_requests(reqs, str(tmp_path / "q"))
    assert sorted(map(repr, tables.read_requests(spark, str(tmp_path / "q")).collect())) == sorted(map(repr, reqs.collect()))
    df = spark.createDataFrame([("['a', 'b']", "[1, 2]")], "l string, i string")
    got = tables.decode_ids(tables.decode_labels(df, "l"), "i").first()
    assert got.l == ["a", "b"] and got.i == [1, 2]


def test_arriving_responses_give_the_same_scores(spark, tmp_path):
    folder = str(tmp_path / "in")
    tables.write_responses(queries.responses(spark, FOLDER).repartition(3), folder)
    scored = rowwise.score_stream(rowwise.stream_responses(spark, folder), queries.labelled(spark, FOLDER))
    run = (scored.select("pair_id", "truth", "prediction").writeStream.format("memory").queryName("arrived")
           .trigger(availableNow=True).start())
    run.awaitTermination(120)
    want = queries.QUERIES["score_responses"](spark, FOLDER).select("pair_id", "truth", "prediction")
    got = spark.table("arrived")
    assert not run.exception() and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("name", ["labelled_pairs", "rule_match_f1", "few_shot_requests", "normalise_kna", "generated_payments",
                                  "evaluation_tables", "bootstrap_f1_rows", "request_audit", "bootstrap_f1", "report_difficulty", "labelled_pairs_limited"])
def test_plans_have_no_cross_join_and_no_row_udf(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan


def test_scans_read_only_needed_columns(spark):
    plan = queries.QUERIES["confusion_by_lang"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
