"""Queries over the given tables, one per operator or job. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reckoner.functions import draws, money, text
from reckoner.functions.draws import u01
from reckoner.operators import audit, bootstrap, confusion, decide, joined, pairs, perturb, ranks, requests, views
from reckoner.plans import evaluate, execute, generate, reports
from reckoner.schema import MULTI_INV, MULTI_PAY, ONE_ONE, PERTURBATIONS
from reckoner.session import STORED, configure, scratch_path, spread_rows, written_table
from reckoner.sources import bridge, tables

SEED = 7
REQUEST_SEED = 20_231
MODELS = ("gpt-3.5-turbo-1106", "gpt-4o-mini-2024-07-18", "gpt-4o-2024-08-06")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        configure(spark).conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold plain UTC times
        return f(spark, sf)

    QUERIES[f.__name__] = run
    return f


def ratio(c: Column | str) -> Column:
    """Scores with ten decimals, equal in both engines."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,10)")


# ---------------------------------------------------------------- documents as scored decisions

def scored(spark: SparkSession, sf: str) -> DataFrame:
    """labels joined with documents: a decision per labelled document, with run dimensions."""
    d = bridge.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = bridge.table(spark, sf, "labels")
    errors = F.array(F.when(F.col("n_chars") > 1000, "perturbed_billing_number"),
                     F.when(F.col("lang") != "en", "perturbed_business_partner"),
                     F.when(F.col("source").startswith("src1"), "small_deduction"))
    kind = F.col("n_chars") % 3
    return lab.join(d, "doc_id").select(
        "doc_id", "lang", "source", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("prediction"),
        F.filter(errors, lambda x: x.isNotNull()).alias("perturbation_categories"),
        F.when(kind == 0, ONE_ONE).when(kind == 1, MULTI_PAY).otherwise(MULTI_INV).alias("match_category"),
        F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("doc_id") % 3 + 1).cast("int")).alias("model"),
        F.when(u01(SEED, "schema", "doc_id") < F.lit(0.5), "opaque").otherwise("multi-table").alias("schema_mode"),
        F.when(u01(SEED, "mode", "doc_id") < F.lit(0.3), "single").otherwise("multi").alias("perturbation_mode"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """One response per document: an answer by a keyed draw, none for a failed request."""
    d = bridge.table(spark, sf, "documents")
    answers = ["Yes", "No", "no\tmatch", "Yes and no", "Maybe", "yes it is", None]
    content = draws.weighted(answers[:-1], [4, 4, 1, 1, 1, 1], u01(SEED, "answer", "doc_id"))
    failed = u01(SEED, "failed", "doc_id") < F.lit(0.1)
    reason = draws.weighted(["stop", "length", "content_filter"], [8, 1, 1], u01(SEED, "reason", "doc_id"))
    choice = F.struct(reason.alias("finish_reason"), F.struct(content.alias("content")).alias("message"))
    prompt, completion = F.ceil(F.col("n_chars") / 4), draws.uint(1, 20, u01(SEED, "out", "doc_id"))
    usage = F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
                     (prompt + completion).alias("total_tokens"))
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("doc_id") % 3 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("pair_id"), model.alias("model"),
                    F.when(~failed, F.array(choice)).alias("choices"), F.when(~failed, usage).alias("usage"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return bridge.table(spark, sf, "labels").select(
        F.col("doc_id").alias("pair_id"), (F.col("quality") == 1).alias("rows_match"))


@query
def confusion_total(spark, sf):
    return confusion.with_scores(confusion.confusion(scored(spark, sf))).select(
        *confusion.COUNTS, "total", *[ratio(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def confusion_by_lang(spark, sf):
    return confusion.with_scores(confusion.confusion_by(scored(spark, sf), ["lang"])).select(
        "lang", *confusion.COUNTS, "total", *[ratio(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def confusion_by_two_keys(spark, sf):
    df = scored(spark, sf).withColumn("clean_or_dirty", confusion.clean_or_dirty(F.col("perturbation_categories")))
    return confusion.confusion_by(df, ["match_category", "clean_or_dirty"])


@query
def confusion_filtered(spark, sf):
    df = scored(spark, sf).withColumn("clean_or_dirty", confusion.clean_or_dirty(F.col("perturbation_categories")))
    return confusion.confusion_by(df, ["match_category"], where={"clean_or_dirty": "dirty"})


@query
def confusion_rollup(spark, sf):
    return confusion.confusion_rollup(scored(spark, sf), ["lang", "match_category"])


@query
def merge_groups(spark, sf):
    counts = confusion.confusion_by(scored(spark, sf), ["model", "match_category"])
    return confusion.merge_groups(counts, "match_category", [MULTI_INV, MULTI_PAY], ["model"])


@query
def confusion_by_label(spark, sf):
    return confusion.confusion_by_label(scored(spark, sf))


@query
def evaluation_tables(spark, sf):
    return evaluate.evaluate(scored(spark, sf))


@query
def score_responses(spark, sf):
    out = decide.score_responses(labelled(spark, sf), responses(spark, sf))
    return out.select("pair_id", "response_text", "parsed", "truth", "prediction")


@query
def score_responses_without_punctuation(spark, sf):
    """Whole document texts read as answers."""
    d = bridge.table(spark, sf, "documents").withColumn("response_text", F.col("text"))
    return d.select("doc_id", text.parse_yes_no("response_text").alias("parsed"),
                    text.parse_yes_no("response_text", True).alias("parsed_stripped"))


@query
def error_counts(spark, sf):
    answered = responses(spark, sf).withColumn("response_text", text.response_text(F.col("choices")))
    return evaluate.errors(decide.with_parsed(answered), ["model"])


@query
def finish_reasons(spark, sf):
    return confusion.finish_reasons(responses(spark, sf))


@query
def failed_responses(spark, sf):
    return confusion.split_failed(responses(spark, sf))[1]


@query
def bootstrap_f1(spark, sf):
    """Counts, and whether the bootstrap error is within 15 per cent of the one in closed form (groups of 200 rows and more)."""
    counts = confusion.confusion_by(scored(spark, sf), ["lang"])
    out = bootstrap.bootstrap_f1(counts, ["lang"], 1000, SEED)
    closed = bootstrap.delta_f1_se(F.col("TP"), F.col("FP"), F.col("FN"))
    return out.select("lang", *confusion.COUNTS, closed.cast("decimal(18,8)").alias("closed_form_se"),
                      ((sum((F.col(c) for c in confusion.COUNTS), F.lit(0)) < 200) |
                       (F.abs(F.col("f1_se") - closed) <= F.lit(0.15) * closed)).alias("near"))


@query
def bootstrap_f1_rows(spark, sf):
    out = bootstrap.bootstrap_f1_rows(scored(spark, sf), "lang", 50, SEED, "doc_id")
    return out.select("lang", "rounds", F.col("f1_se").cast("decimal(18,8)").alias("f1_se"))


# ---------------------------------------------------------------- reports

@query
def report_difficulty(spark, sf):
    """Cells ``F1 ± error``, the error by 1,000 bootstrap rounds."""
    return reports.report_difficulty(evaluate.evaluate(scored(spark, sf)), 1000, SEED)


@query
def report_difficulty_scores(spark, sf):
    cells = confusion.with_scores(reports.difficulty_counts(evaluate.evaluate(scored(spark, sf))))
    return (cells.groupBy("model").pivot("scenario", list(reports.SCENARIOS)).agg(F.first("f1"))
            .select("model", *[ratio(F.col(f"`{s}`")).alias(n) for s, n in zip(
                reports.SCENARIOS, ("initial_data", "errors", "multi_matches", "multiple_tables"))]))


@query
def report_cells(spark, sf):
    """Cells ``mean ± spread`` of the order totals per priority."""
    o = bridge.table(spark, sf, "orders")
    cents = F.col("o_totalprice").cast(money.MONEY)
    stats = o.groupBy("o_orderpriority").agg(
        (F.sum(cents).cast("decimal(30,2)").cast("double") / F.count(F.lit(1)) / 1e5).alias("m"),
        (F.max(cents) - F.min(cents)).cast("double").alias("spread"))
    return stats.select("o_orderpriority", text.mean_se(F.col("m"), F.col("spread") / F.lit(1e6)).alias("cell"))


@query
def report_precision_recall(spark, sf):
    out = reports.report_precision_recall(evaluate.evaluate(scored(spark, sf)))
    return out.select("model", *[ratio(c).alias(c) for c in ("f1_score", "precision", "recall")])


@query
def report_error_categories(spark, sf):
    out = reports.report_error_categories(evaluate.evaluate(scored(spark, sf)))
    return out.select("model", *[ratio(F.col(f"`{t}`")).alias(k) for k, t in reports.ERROR_TITLES.items()])


@query
def runs_from_names(spark, sf):
    named = scored(spark, sf).select(
        "doc_id", F.concat_ws("_", F.lit("exp"), "model", "schema_mode", "perturbation_mode").alias("name"))
    return tables.runs_from_names(named)


RUNS = [(m, s, p) for m in MODELS for s in ("opaque", "multi-table") for p in ("single", "multi")]


def result_files(spark: SparkSession, sf: str) -> str:
    """A folder with the result files of all runs of two datasets: documents in English, and the others."""
    base = _folder(spark, "runs")
    dataset = F.when(F.col("lang") == "en", "pay_to_inv").otherwise("other")
    results = written_table(evaluate.evaluate(scored(spark, sf).withColumn("dataset", dataset), tables.DIMENSIONS), "results")
    for name in ("pay_to_inv", "other"):
        for m, s, p in RUNS:
            tables.write_run(reports.select_runs(results, dataset=name, model=m, schema_mode=s, perturbation_mode=p), base, name, f"exp-1_{m}_{s}_{p}")
    return base


@query
def runs_from_files(spark, sf):
    """Results of all runs found in a folder of result files."""
    return tables.runs_from_files(spark, result_files(spark, sf))


@query
def report_of_dataset(spark, sf):
    """Report 2 of one dataset, from result files kept as a table that is partitioned by dataset and run."""
    path = _folder(spark, "results")
    tables.write_results(tables.runs_from_files(spark, result_files(spark, sf)), path)
    results = reports.select_runs(tables.load_results(spark, path), dataset="pay_to_inv")
    out = reports.report_precision_recall(results)
    return out.select("model", *[ratio(c).alias(c) for c in ("f1_score", "precision", "recall")])


@query
def results_from_maps(spark, sf):
    """Counts per category written as one JSON map per model, and read back as rows."""
    counts = confusion.confusion_by(scored(spark, sf), ["model", "match_category"])
    entry = F.struct("match_category", F.struct(*confusion.COUNTS))
    maps = counts.groupBy("model").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("result"))
    return tables.results_from_maps(maps, "result", "match_category")


# ---------------------------------------------------------------- numbering

@query
def dense_ids(spark, sf):
    li = bridge.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").cast("bigint").alias("quantity"))
    return ranks.dense_id(li, ["l_orderkey", "l_linenumber"], "line_id")


@query
def running_totals(spark, sf):
    sizes = bridge.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return ranks.running_total(sizes, ["l_orderkey"], "n", "lines_before")


@query
def limit_at_group(spark, sf):
    sizes = bridge.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return ranks.limit_at_group(sizes, ["l_orderkey"], "n", 2000)


@query
def position_in_group(spark, sf):
    o = bridge.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return ranks.position_in_group(o, ["o_custkey"], ["o_orderkey"])


@query
def first_per_key(spark, sf):
    o = bridge.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return ranks.first_per_key(o, ["o_custkey"], "o_orderkey")


# ---------------------------------------------------------------- matches and pairs

PLANNED = ("match_id", "match_category", "perturbation_categories")  # what pairs carry of their match


def pair_plan(spark: SparkSession, sf: str, limit: int | None = None) -> pairs.PairPlan:
    return plan_of(bridge.matching(spark, sf, PLANNED), limit)


def plan_of(m: bridge.Matching, limit: int | None = None) -> pairs.PairPlan:
    info = m.info.select(*PLANNED)
    return pairs.PairPlan(info, m.invoice_members, m.payment_members, SEED, limit)


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("perturbation_categories", F.array_join("perturbation_categories", ","))


@query
def match_categories(spark, sf):
    return _shown(bridge.matching(spark, sf).info.select(
        "match_id", "match_category", "n_invoices", "n_payments", "total_amount", "last_document_date",
        "perturbation_categories"))


@query
def group_totals(spark, sf):
    members, inv = bridge.invoice_members(spark, sf), bridge.invoices(spark, sf)
    dated = inv.select("invoice_id", "inv_amount", F.to_date("inv_document_date", "yyyyMMdd").alias("day"))
    out = joined.group_totals(members.join(dated, "invoice_id"), "match_id", "inv_amount", "day")
    return out.withColumn("last_date", money.format_day(F.col("last_date")))


@query
def match_members(spark, sf):
    """Invoices of each match in order, as rows: no list grows with a match. Open invoices have no match and come last."""
    m = bridge.matching(spark, sf).invoice_members
    starts = pairs.member_ranges(m, "_inv_index", "inv")
    out = m.join(starts, "match_id", "left").select("match_id", "invoice_id", F.col("inv_size").alias("n"), (F.col("_inv_index") - F.col("inv_start")).alias("pos"))
    return out


@query
def members_long(spark, sf):
    """The (key, id) relation of the invoices' member tables: each invoice with the invoices whose ids its header, item and customer rows bear."""
    return views.members(bridge.invoices(spark, sf), "invoice").links.select("invoice_id", "BKPF", "BSEG", F.col("`KNA-1`").alias("KNA"))


@query
def positive_pairs_many_to_many(spark, sf):
    """Orders of a customer-year, each with every line of all of them: matches of many by many."""
    o = bridge.table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), "o_orderkey")
    heads = o.groupBy("o_custkey", "year").agg(F.min("o_orderkey").alias("match_id"))
    owned = o.join(heads, ["o_custkey", "year"]).select("match_id", "year", F.col("o_orderkey").alias("invoice_id"))
    lines = bridge.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    paid = lines.join(owned, F.col("l_orderkey") == F.col("invoice_id")).select(
        "match_id", (F.col("l_orderkey") * F.lit(1000) + F.col("l_linenumber")).alias("payment_id"))
    info = owned.groupBy("match_id").agg(F.min("year").alias("year"))
    inv = pairs.indexed_members(owned.select("match_id", "invoice_id"), "invoice_id", "_inv_index")
    pay = pairs.indexed_members(paid, "payment_id", "_pay_index")
    return pairs.PairPlan(info, inv, pay, SEED, tile=4).rows("match").select("pair_id", "match_id", "year", "invoice_id", "payment_id")


@query
def split_payments(spark, sf):
    m = bridge.matching(spark, sf)
    out = joined.split_group_total(m.payment_members.join(m.info.select("match_id", "total_amount"), "match_id"),
                                   "match_id", "total_amount", "weight", "payment_id", "part_amount")
    return out.select("match_id", "payment_id", "total_amount", "part_amount")


@query
def payment_rows(spark, sf):
    return bridge.matching(spark, sf).payments


@query
def positive_pairs(spark, sf):
    return _shown(pair_plan(spark, sf).rows("match").drop("pair_id"))


@query
def negatives_by_invoice(spark, sf):
    return _shown(pair_plan(spark, sf).rows("invoice_driven").drop("pair_id"))


@query
def negatives_by_payment(spark, sf):
    return _shown(pair_plan(spark, sf).rows("payment_driven").drop("pair_id"))


@query
def labelled_pairs(spark, sf):
    return _shown(pair_plan(spark, sf).rows())


@query
def labelled_pairs_limited(spark, sf):
    return _shown(pair_plan(spark, sf, 2000).rows())


@query
def pair_counts(spark, sf):
    return confusion.pair_counts(pair_plan(spark, sf).rows())


@query
def attach_rows(spark, sf):
    m = bridge.matching(spark, sf)
    both = pairs.attach_payment(pairs.attach_invoice(plan_of(m).rows("match"), m.invoices), m.payments)
    return both.select("match_id", "invoice_id", "payment_id", F.col("source.inv_billing_number").alias("billing"),
                       F.col("source.inv_amount").alias("inv_amount"), F.col("target.pay_memo_line").alias("memo"),
                       F.col("target.pay_amount").alias("pay_amount"))


# ---------------------------------------------------------------- views

@query
def view_descriptive(spark, sf):
    return views.single_table_view(bridge.invoices(spark, sf), "invoice", "descriptive")


@query
def view_opaque(spark, sf):
    return views.single_table_view(bridge.invoices(spark, sf), "invoice", "opaque")


@query
def view_payments_opaque(spark, sf):
    return views.single_table_view(bridge.matching(spark, sf).payments, "payment", "opaque")


def _member_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A member table with every id of each primary key, in lists of about 20."""
    side = "payment" if name == "FEBEP" else "invoice"
    df = written_table(bridge.matching(spark, sf).payments, "payments") if side == "payment" else bridge.invoices(spark, sf)
    table, key = views.split_tables(df, side)[name], [a.opaque for a in views.member_tables(side)[name][1]]
    return views.merged_by_key(table, key, f"{side}_id", 20).withColumn(f"{side}_id", F.array_join(f"{side}_id", ","))


for _t in ("BKPF", "BSEG", "KNA-1", "FEBEP"):
    _f = partial(_member_table, name=_t)
    _f.__name__ = "normalise_" + _t.replace("-1", "").lower()
    query(_f)


@query
def reassemble_source(spark, sf):
    side = views.members(bridge.invoices(spark, sf), "invoice").written()
    rows = bridge.table(spark, sf, "orders").select(F.col("o_orderkey").alias("invoice_id"))
    return views.reassemble_source(rows, side).select("invoice_id", "BKPF.BELNR", "BKPF.WAERS", "BKPF.BLDAT", "BSEG.VBELN", "BSEG.WRBTR",
                      "KNA.KUNNR", "KNA.NAME1")


@query
def join_on_member(spark, sf):
    side = views.members(bridge.invoices(spark, sf), "invoice")
    rows = bridge.table(spark, sf, "orders").select(F.col("o_orderkey").alias("invoice_id"))
    return views.join_on_member(rows, side, "KNA-1").select("invoice_id", "KUNNR", "LAND1")


@query
def all_customers(spark, sf):
    """The whole customer table for every nation, in blocks."""
    kna = views.normalise(bridge.invoices(spark, sf), "invoice")["KNA-1"]
    rows = bridge.table(spark, sf, "nation").select("n_nationkey")
    shown = views.all_customers(rows, kna).groupBy("n_nationkey").agg(
        F.sum(F.size("KNA")).alias("customers"), F.sum(F.aggregate("KNA", F.lit(0).cast("bigint"), lambda s, c: s + F.substring(c["KUNNR"], 4, 7).cast("bigint"))).alias("numbers"))
    return shown


# ---------------------------------------------------------------- errors and draws

@query
def perturb_identifiers(spark, sf):
    inv = bridge.invoices(spark, sf)
    return inv.select("invoice_id", "inv_assignment_number", text.break_identifier(
        "inv_assignment_number", SEED, "id", "invoice_id").alias("broken_assignment"), text.break_identifier(
        F.col("invoice_id").cast("string"), SEED, "short", "invoice_id").alias("broken_id"))


@query
def perturb_names(spark, sf):
    c = bridge.table(spark, sf, "customer")
    forms = ["Inc", "and Sons", "LLC", "Group", "PLC", "Ltd", "Co"]
    named = c.withColumn("name", F.concat_ws(" ", "c_name", draws.pick(forms, u01(SEED, "form", "c_custkey"))))
    return named.select("c_custkey", "name", text.break_name("name", SEED, "name", "c_custkey").alias("broken"))


@query
def small_deduction(spark, sf):
    inv = bridge.invoices(spark, sf)
    return inv.select("invoice_id", "inv_amount", money.small_deduction(
        F.col("inv_amount"), F.col("inv_currency_code"), draws.beta(3, 5, SEED, "less", "invoice_id")).alias("paid"))


@query
def perturb_table(spark, sf):
    spec = [
        perturb.Perturbation("perturbed_assignment_number", "inv_assignment_number",
                             lambda c, s, t, k: text.break_identifier(c, s, t, k), 2.0),
        perturb.Perturbation("perturbed_billing_number", "inv_billing_number",
                             lambda c, s, t, k: text.break_identifier(c, s, t, k), 1.0),
        perturb.Perturbation("perturbed_business_partner", "inv_customer_name", lambda c, s, t, k: F.upper(c), 1.0),
    ]
    out = perturb.perturb(bridge.invoices(spark, sf), spec, "invoice_id", "multi", 0.75, SEED)
    return out.select("invoice_id", "inv_assignment_number", "inv_billing_number", "inv_customer_name",
                      F.array_join(F.sort_array("perturbation_categories"), ",").alias("perturbation_categories"))


@query
def weighted_categories(spark, sf):
    o = bridge.table(spark, sf, "orders")
    weights = generate.CATEGORY_WEIGHTS
    picked = o.select(
        draws.weighted(list(weights), list(weights.values()), u01(SEED, "cat", "o_orderkey")).alias("category"),
        draws.exp_drop([f"{i}000" for i in range(1, 10)], 2, u01(SEED, "company", "o_orderkey")).alias("company"))
    return picked.groupBy("category", "company").agg(F.count(F.lit(1)).alias("n"))


@query
def perturbation_sets(spark, sf):
    o = bridge.table(spark, sf, "orders")
    size = draws.uint(1, 4, u01(SEED, "size", "o_orderkey"))
    chosen = draws.weighted_subset(PERTURBATIONS, [4.0, 3.0, 2.0, 1.0], size, SEED, "set", "o_orderkey")
    return o.select("o_orderkey", F.array_join(F.sort_array(chosen), ",").alias("errors"))


@query
def beta_amounts(spark, sf):
    o = bridge.table(spark, sf, "orders")
    share = draws.beta(2, 10, SEED, "amount", "o_orderkey")
    return o.select("o_orderkey", F.floor(share * F.lit(1_000_000.0)).alias("usd"))


@query
def fx_amounts(spark, sf):
    inv = bridge.invoices(spark, sf)
    return inv.select("invoice_id", money.to_currency(F.col("inv_amount"), F.col("inv_currency_code")).alias("converted"))


@query
def unique_numbers(spark, sf):
    o = ranks.dense_id(bridge.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "index")
    n = o.agg(F.count(F.lit(1))).scalar()
    return (o.withColumn("n", n).withColumn("rank", draws.permuted(F.col("index"), F.col("n"), SEED))
            .select("o_orderkey", "rank", draws.unique_value(F.col("rank"), F.col("n"), 10).alias("number")))


@query
def sap_numbers(spark, sf):
    o = bridge.table(spark, sf, "orders")
    digits = draws.uint(5, 15, u01(SEED, "digits", "o_orderkey"))
    number = draws.sap_number(digits, u01(SEED, "sap", "o_orderkey"))
    return o.select("o_orderkey", F.length(number).alias("digits"), number.alias("number"))


@query
def sampled_without_replacement(spark, sf):
    o = bridge.table(spark, sf, "orders")
    own = F.array((F.col("o_orderkey") % 97).cast("bigint"))
    return o.select("o_orderkey", F.array_join(
        draws.sample_k(97, 5, own, SEED, "sample", "o_orderkey"), ",").alias("drawn"))


@query
def permuted_numbers(spark, sf):
    """A unique number per order whose steps from one order to the next follow no rule."""
    o = ranks.dense_id(bridge.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "index")
    n = o.agg(F.count(F.lit(1))).scalar()
    return o.withColumn("n", n).withColumn("rank", draws.feistel(F.col("index"), F.col("n"), SEED, "permuted")).select(
        "o_orderkey", "rank", draws.unique_value(F.col("rank"), F.col("n"), 10).alias("number"))


@query
def sampled_ranks(spark, sf):
    """Fifty different numbers below a thousand per customer, each customer by a permutation of its own."""
    c = spread_rows(bridge.table(spark, sf, "customer").select("c_custkey"))
    return c.select("c_custkey", F.array_join(draws.sample_ranks(1000, 50, SEED, "ranks", "c_custkey"), ",").alias("drawn"))


@query
def shuffled_lists(spark, sf):
    o = bridge.table(spark, sf, "orders")
    words = F.array(*[F.lit(w) for w in ("one", "two", "three", "four")], F.col("o_orderpriority"))
    return o.select("o_orderkey", F.array_join(draws.shuffled(words, SEED, "shuffle", "o_orderkey"), ",").alias("words"))


@query
def draws_outside_list(spark, sf):
    """A customer from outside a short list of customers, per order."""
    o = bridge.table(spark, sf, "orders")
    n = bridge.table(spark, sf, "customer").agg(F.count(F.lit(1))).scalar()
    taken = F.sort_array(F.array_distinct(F.array(F.col("o_custkey"), F.pmod(F.col("o_custkey") * F.lit(7), F.lit(100)))))
    return o.withColumn("n", n).select(
        "o_orderkey", draws.draw_outside(F.col("n"), taken, u01(SEED, "outside", "o_orderkey")).alias("other_customer"))


@query
def random_texts(spark, sf):
    c = bridge.table(spark, sf, "customer")
    length = draws.uint(3, 15, u01(SEED, "len", "c_custkey"))
    return c.select("c_custkey", draws.rand_chars(
        "abcdefghijklmnopqrstuvwxyz0123456789", length, SEED, "chars", "c_custkey").alias("noise"))


@query
def customer_fixed_choices(spark, sf):
    o = bridge.table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey",
                    draws.pick(list(generate.MEMO_PREFIXES), u01(SEED, "memo", "o_custkey")).alias("prefix"),
                    F.lpad(draws.uint(1, 30, u01(SEED, "terms", "o_custkey")).cast("string"), 4, "0").alias("terms"))


@query
def statement_names(spark, sf):
    """Statement name of each order's customer from a list with repeated names (supplier rows)."""
    o = bridge.table(spark, sf, "orders").withColumn("group_no", F.col("o_custkey") % 10)
    listed = bridge.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") % 10).alias("group_no"), F.col("s_suppkey").alias("pos"), F.upper("s_name").alias("statement"))
    out = joined.first_hit(o, listed, "group_no", "pos", "statement")
    return out.select("o_orderkey", "group_no", "statement")


# ---------------------------------------------------------------- dates and text

@query
def due_and_posting_dates(spark, sf):
    o = bridge.table(spark, sf, "orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    days = F.floor(draws.beta(2, 5, SEED, "days", "o_orderkey") * F.lit(60))
    drawn = money.day_in_year(F.year("o_orderdate"), u01(SEED, "day", "o_orderkey"))
    return o.select("o_orderkey", money.add_days(day, days).alias("due"), money.format_day(drawn).alias("drawn_day"))


@query
def memo_lines(spark, sf):
    inv = bridge.invoices(spark, sf)
    order = u01(SEED, "memo_order", "inv_customer_id") < F.lit(0.5)
    template = F.when(order, "PAY {{billing_number}} {{assignment_number}}").otherwise(
        "ref {{assignment_number}} / {{billing_number}}{{noise}}")
    filled = text.fill_template_column(
        template, billing_number=F.col("inv_billing_number"), assignment_number=F.col("inv_assignment_number"),
        noise=F.lit("{{not again}}"), unused=F.lit("x"))
    constant = text.fill_template("#RECEIPT: {{a}} {{b}}", a=F.col("inv_billing_number"), b=F.col("inv_customer_id"))
    return inv.select("invoice_id", filled.alias("memo"), constant.alias("receipt"))


@query
def id_lists(spark, sf):
    """Billing numbers of each advice or order in one text."""
    inv, im = bridge.invoices(spark, sf), bridge.invoice_members(spark, sf)
    ids = im.join(inv.select("invoice_id", "inv_billing_number"), "invoice_id")
    lists = joined.with_sorted_members(ids, ["match_id"], "invoice_id", ["inv_billing_number"], "ids")
    numbers = F.transform("ids", lambda x: x["inv_billing_number"])
    return lists.select("match_id", text.join_ids(numbers, "REF {{idx}}: {{identifier}}", " & ").alias("memo"))


@query
def linearize_rows(spark, sf):
    c = bridge.table(spark, sf, "customer")
    quoted = F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit('", '), F.col("c_name"))
    shown = {"Client": F.col("c_custkey"), "Name": F.col("c_name"), "Segment, quoted": quoted,
             "Balance": F.col("c_acctbal").cast(money.MONEY), "Note": F.when(F.col("c_custkey") % 2 == 0, F.lit(" x "))}
    return c.select("c_custkey", text.linearize_csv(shown).alias("row_text"))


@query
def linearize_documents(spark, sf):
    d = bridge.table(spark, sf, "documents")
    return d.select("doc_id", text.linearize_csv(["lang", "source", "text"], header=False).alias("row_text"))


@query
def linearize_markdown(spark, sf):
    c = bridge.table(spark, sf, "customer")
    shown = {"Name": F.col("c_name"), "Segment": F.col("c_mktsegment"), "Balance": F.col("c_acctbal").cast(money.MONEY)}
    return c.select("c_custkey", text.linearize_markdown(
        shown, ["Balance"], "{{table_name}}:{{newline}}{{table}}", F.lit("customers")).alias("row_text"))


@query
def linearize_member_tables(spark, sf):
    side = views.members(bridge.invoices(spark, sf), "invoice")
    rows = bridge.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pair_id"),
                                                    F.col("o_orderkey").alias("invoice_id"), F.lit(True).alias("rows_match"))
    out = views.reassemble_source(rows, side).withColumn("target", F.struct("pair_id"))
    return requests.pair_texts(out, ["BKPF", "BSEG", "KNA"]).select("pair_id", "first_table_row")


# ---------------------------------------------------------------- requests

def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = bridge.table(spark, sf, "documents")
    lab = bridge.table(spark, sf, "labels")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("pair_id"), (F.col("quality") == 1).alias("rows_match"),
        text.linearize_csv(["lang", "source", "n_chars"]).alias("first_table_row"),
        text.linearize_csv(["text"]).alias("second_table_row"))


def messages_text(c: str | Column = "messages") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit("> "), m["content"])), "\n")


@query
def few_shot_requests(spark, sf):
    cfg = requests.RequestConfig(model=MODELS[0], num_examples=2, draw_seed=SEED)
    out = requests.build_requests(document_texts(spark, sf), cfg)
    return out.select("pair_id", "model", "max_tokens", "temperature", "seed",
                      F.size("messages").alias("n_messages"), messages_text().alias("chat"))


def pair_rows(spark: SparkSession, sf: str, slim_first: bool = False) -> DataFrame:
    """Labelled pairs with their invoice and payment rows. The first row attached travels with every pair to meet the second; of whole rows the payment's is the slimmer
    one (``slim_first``), of the columns that the rules read the invoice's."""
    m = bridge.matching(spark, sf)
    # both are written first: what making them shuffles is gone when whole rows begin to travel
    rows, payments = written_table(plan_of(m).rows(), "pairs", STORED), written_table(m.payments, "payments", STORED)
    return rows_of_pairs(rows, m.invoices, payments, slim_first)


def rows_of_pairs(pairs_: DataFrame, invoices: DataFrame, payments: DataFrame, slim_first: bool) -> DataFrame:
    if slim_first:
        return pairs.attach_invoice(pairs.attach_payment(pairs_, payments), invoices)
    return pairs.attach_payment(pairs.attach_invoice(pairs_, invoices), payments)


def view_texts(m: bridge.Matching, mode: str) -> tuple[DataFrame, DataFrame]:
    """Texts of the invoices and payments as the view of a schema mode shows them, or as the tables stand (``tables``)."""
    if mode == "tables":
        return (requests.row_texts(m.invoices, "invoice_id", "first_table_row"), requests.row_texts(m.payments, "payment_id", "second_table_row"))
    if mode != "multi-table":
        return (requests.row_texts(views.single_table_view(m.invoices, "invoice", mode), "invoice_id", "first_table_row"),
                requests.row_texts(views.single_table_view(m.payments, "payment", mode), "payment_id", "second_table_row"))
    sources = views.reassemble_source(m.invoices.select("invoice_id"), views.members(m.invoices, "invoice"))
    targets = views.join_on_member(m.payments.select("payment_id"), views.members(m.payments, "payment"), "FEBEP").drop("n_ids")
    return (requests.source_texts(sources, "invoice_id", ["BKPF", "BSEG", "KNA"], "first_table_row"),
            requests.row_texts(targets, "payment_id", "second_table_row"))


def _pair_requests(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    """Requests of all labelled pairs as a view shows their rows, one example of each label."""
    cfg = requests.RequestConfig(model=MODELS[1], num_examples=1, draw_seed=SEED)
    m = bridge.matching(spark, sf)
    out = requests.pair_requests(plan_of(m).rows(), *view_texts(m, mode), cfg)
    return out.select("pair_id", F.size("messages").alias("n_messages"), F.sha2(messages_text(), 256).alias("chat_digest"))


for _t in ("tables", "descriptive", "opaque", "multi-table"):
    _f = partial(_pair_requests, mode=_t)
    _f.__name__ = "pair_requests" + ("" if _t == "tables" else "_" + _t.replace("-", "_"))
    query(_f)


CHAT_MODELS = (*MODELS, "small-context-model")


def chat_catalogue(spark: SparkSession) -> DataFrame:
    """The models of the catalogue, and one whose context is so small that dialogues exceed it."""
    small = spark.createDataFrame([(CHAT_MODELS[-1], "chat", 0.0005, 0.001, 64, 32)], audit.MODEL_COLUMNS)
    return audit.model_catalogue(spark).union(small)


def chat_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A request per dialogue."""
    turns = bridge.table(spark, sf, "conversations")
    chats = requests.chat_from_turns(turns, "conv_id", "turn", "role", "text")
    every = lambda n, value, rest=0: F.when(F.col("conv_id") % n == rest, F.lit(value))
    return chats.select(
        "conv_id", F.col("conv_id").alias("pair_id"),
        F.element_at(F.array(*[F.lit(m) for m in CHAT_MODELS]), (F.col("conv_id") % 4 + 1).cast("int")).alias("model"),
        every(3, 100, 1).otherwise(every(3, 20000, 2)).cast("int").alias("max_tokens"),
        F.coalesce(every(7, 0.7, 3), F.lit(0.0)).alias("temperature"), "messages",
        F.when(F.col("conv_id") % 5 != 0, F.lit(REQUEST_SEED)).cast("bigint").alias("seed"),
        every(4, 2).cast("int").alias("n"), every(8, 3).cast("int").alias("best_of"),
        every(6, 50, 1).cast("int").alias("max_completion_tokens"))


def chat_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Answers already held for about half of the chat requests, each row twice; one in seven under a stale text."""
    known = audit.with_hash(chat_requests(spark, sf)).where(u01(SEED, "cached", "conv_id") < F.lit(0.5))
    stale = F.col("conv_id") % 7 == 0
    response = F.concat(F.lit('{"choices":[{"finish_reason":"stop","message":{"content":"No"}}],"usage":{"prompt_tokens":'), F.size("messages").cast("string"),
                        F.lit(',"completion_tokens":1,"total_tokens":'), (F.size("messages") + 1).cast("string"), F.lit("}}"))
    rows = known.select("hash", F.when(stale, F.concat("request_json", F.lit(" "))).otherwise(F.col("request_json"))
                        .alias("request"), response.alias("response"))
    return rows.union(rows)


def chat_scorer(misses: DataFrame) -> DataFrame:
    """Stands in for a model: fails for one dialogue in nine, else answers by the number of messages, cut off where the limit is 50."""
    size = F.size("messages")
    choice = F.struct(F.when(F.col("max_completion_tokens") == 50, "length").otherwise("stop").alias("finish_reason"),
                      F.struct(F.when(size % 2 == 0, "Yes").otherwise("No").alias("content")).alias("message"))
    usage = F.struct(size.cast("bigint").alias("prompt_tokens"), F.lit(2).cast("bigint").alias("completion_tokens"), (size + 2).cast("bigint").alias("total_tokens"))
    return misses.select("pair_id", "model", F.when(F.col("conv_id") % 9 != 0, F.array(choice)).alias("choices"), usage.alias("usage"))


@query
def execute_requests(spark, sf):
    """Answers of all chat requests, from the cache or the scorer."""
    out = execute.execute(chat_requests(spark, sf), tables.cache_table(chat_cache(spark, sf)), chat_scorer).responses
    first = F.get(F.col("choices"), F.lit(0))
    return out.select("pair_id", "model", "cached", first["finish_reason"].alias("finish_reason"), first["message"]["content"].alias("answer"),
                      F.when(F.col("choices").isNotNull(), F.col("usage.total_tokens")).alias("total_tokens"))


@query
def executed_cache(spark, sf):
    """What a run adds to the cache: a second run on top of it adds nothing."""
    chats, cache = chat_requests(spark, sf), chat_cache(spark, sf)
    added = written_table(execute.execute(chats, tables.cache_table(cache), chat_scorer).added, "added")
    again = execute.execute(chats, tables.cache_table(cache.union(added)), chat_scorer).added
    return added.agg(F.count(F.lit(1)).alias("added")).withColumn("again", again.agg(F.count(F.lit(1))).scalar())


@query
def cache_states(spark, sf):
    """Requests by what the cache knows of them, from one join."""
    split = audit.split_by_cache(audit.with_hash(chat_requests(spark, sf)), chat_cache(spark, sf))
    return split.groupBy("model", "state").agg(F.count(F.lit(1)).alias("n"))


@query
def execution_counts(spark, sf):
    """Counts of a run as its own jobs observed them: the response table is not read for them."""
    run = execute.execute(chat_requests(spark, sf), tables.cache_table(chat_cache(spark, sf)), chat_scorer)
    rows = list(run.counts.items())
    return spark.createDataFrame(rows, "counter string, n bigint")


@query
def cache_cost(spark, sf):
    """Cost of a whole cache, each request once."""
    chats = audit.with_hash(chat_requests(spark, sf))
    cache = chat_cache(spark, sf).dropDuplicates(["hash", "request"])
    priced = audit.cached_responses(cache).drop("model").join(chats.select("hash", "model"), "hash")
    out = audit.actual_cost(priced, chat_catalogue(spark))
    return out.select("model", "responses", "total_tokens", F.col("cost").cast("decimal(18,8)").alias("cost"))


@query
def chat_messages(spark, sf):
    turns = bridge.table(spark, sf, "conversations")
    chats = requests.chat_from_turns(turns, "conv_id", "turn", "role", "text")
    return chats.select("conv_id", F.size("messages").alias("n_messages"), messages_text().alias("chat"))


@query
def chat_templates(spark, sf):
    """Document texts in a chat template, with the labels' answer as one message."""
    template = [{"role": "system", "content": "Language {{lang}}"}, "{{hint}}", {"role": "user", "content": "{{text}}"}]
    d = bridge.table(spark, sf, "documents")
    chat = text.fill_chat(template, hint={"role": F.lit("assistant"), "content": F.col("source")},
                          lang=F.col("lang"), text=F.col("text"))
    return d.select("doc_id", messages_text(chat).alias("chat"))


@query
def request_audit(spark, sf):
    out = audit.audit_requests(chat_requests(spark, sf), chat_cache(spark, sf), chat_catalogue(spark))
    return out.select("conv_id", "hash", "cached", "input_tokens", "max_input_usage", "max_output_usage",
                      F.array_join("issues", ",").alias("issues"), F.col("max_cost").cast("decimal(18,8)").alias("max_cost"))


@query
def cache_misses(spark, sf):
    out = audit.cache_misses(audit.with_hash(chat_requests(spark, sf)), chat_cache(spark, sf))
    return out.select("conv_id", "hash")


@query
def max_cost(spark, sf):
    out = audit.audit_requests(chat_requests(spark, sf), chat_cache(spark, sf), chat_catalogue(spark))
    return audit.total_max_cost(out).select("requests", F.col("max_cost").cast("decimal(18,6)").alias("max_cost"))


@query
def actual_cost(spark, sf):
    out = audit.actual_cost(responses(spark, sf), audit.model_catalogue(spark))
    return out.select("model", "responses", "total_tokens", F.col("cost").cast("decimal(18,6)").alias("cost"))


# ---------------------------------------------------------------- decisions

@query
def rule_scores(spark, sf):
    rules = decide.pair_rules()
    scored_pairs = pair_rows(spark, sf)
    return scored_pairs.select("pair_id", "rows_match", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()],
                               decide.rule_score().alias("score"))


def decided(spark: SparkSession, sf: str) -> DataFrame:
    answered = decide.decide(pair_rows(spark, sf), decide.rule_scorer())
    return decide.resolve(decide.with_parsed(answered))


@query
def rule_match_f1(spark, sf):
    counts = confusion.confusion_by(decided(spark, sf), ["match_category"])
    return confusion.with_scores(counts).select(
        "match_category", *confusion.COUNTS, "total", *[ratio(c).alias(c) for c in ("precision", "recall", "f1")])


@query
def rule_match_by_error(spark, sf):
    counts = confusion.confusion_by_label(decided(spark, sf))
    return confusion.with_scores(counts).select("label", *confusion.COUNTS, ratio("f1").alias("f1"))


# ---------------------------------------------------------------- generator, keyed on the orders

def generated(spark: SparkSession, sf: str, mode: str) -> dict[str, DataFrame]:
    """A dataset with one match per order."""
    keys = ranks.dense_id(bridge.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "match_id")
    return generate.generate(keys, keys.count(), generate.GenConfig(seed=SEED), mode)


@query
def generated_matches(spark, sf):
    m = generated(spark, sf, "multi")["matches"]
    lists = {c: F.array_join(c, ",") for c in ("invoice_ids", "payment_ids")}
    lists |= {c: F.array_join(F.sort_array(c), ",") for c in ("perturbation_categories", "effective_perturbations")}
    return m.withColumns(lists)


@query
def generated_many_to_many(spark, sf):
    """Matches with a fourth kind besides: several payments for several invoices. Every order is the key of a match."""
    keys = ranks.dense_id(bridge.table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], "match_id")
    kinds = {**generate.MATCH_KINDS, "multi_pay_multi_inv": generate.MatchKind(0.25, generate.some_payments, generate.some_invoices)}
    t = generate.generate(keys, keys.count(), generate.GenConfig(seed=SEED, kinds=kinds), "multi")
    m = t["matches"].where("match_category = 'multi_pay_multi_inv'")
    members = lambda c, i: pairs.members(m, c, i)
    inv = members("invoice_ids", "invoice_id").join(t["invoices"].select("invoice_id", "inv_amount"), "invoice_id").groupBy("match_id").agg(
        F.count(F.lit(1)).alias("invoices"), F.sum("inv_amount").cast(money.MONEY).alias("invoiced"))
    clean = ~F.array_contains("perturbation_categories", "small_deduction")
    pay = members("payment_ids", "payment_id").join(t["payments"].select("payment_id", "pay_amount"), "payment_id").groupBy("match_id").agg(
        F.count(F.lit(1)).alias("payments"), F.sum("pay_amount").cast(money.MONEY).alias("paid"))
    return m.select("match_id", clean.alias("in_full")).join(inv, "match_id").join(pay, "match_id").select(
        "match_id", "invoices", "payments", F.when(F.col("in_full"), F.col("invoiced") == F.col("paid")).otherwise(F.col("paid") < F.col("invoiced")).alias("adds_up"))


@query
def generated_invoices(spark, sf):
    return generated(spark, sf, "single")["invoices"]


@query
def generated_payments(spark, sf):
    return generated(spark, sf, "multi")["payments"]


@query
def schema_views(spark, sf):
    """Opaque invoices of the generated dataset, out of all its views."""
    t = generate.written(generated(spark, sf, "single"))
    return views.schema_views(t["invoices"], t["payments"], t["matches"])["opaque", "invoices"]


def row_digest(df: DataFrame) -> Column:
    """A number per row from all its columns as text, in their order."""
    shown = [F.coalesce(F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ",") if f.dataType.typeName() == "array" else F.col(f"`{f.name}`").cast("string"), F.lit(""))
             for f in df.schema.fields]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *shown)), 1, 13), 16, 10).cast("bigint")


@query
def schema_views_all(spark, sf):
    """Every view of both perturbation modes: its rows, and the sum of their digests. The base tables of a mode are written once."""
    out = []
    for mode in ("single", "multi"):
        t = generate.written(generated(spark, sf, mode))
        for (schema, name), df in views.schema_views(t["invoices"], t["payments"], t["matches"].withColumn(
                "perturbation_categories", F.sort_array("perturbation_categories"))).items():
            out.append(df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row_digest(df).cast("decimal(38,0)")).alias("digest")).select(
                F.lit(mode).alias("perturbation_mode"), F.lit(schema).alias("schema_mode"), F.lit(name).alias("table_name"), "rows", F.col("digest").cast("string").alias("digest")))
    return reduce(DataFrame.union, out)


def given_orders(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """A dataset whose matches of one invoice have the amounts and dates of the orders."""
    o = bridge.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("given_amount"), F.to_date("o_orderdate").alias("given_date"))
    keys = ranks.dense_id(o, ["o_orderkey"], "match_id")
    return generate.generate(keys, keys.count(), generate.GenConfig(seed=SEED), "single", invoice_fillers=generate.GIVEN_FILLERS)


@query
def generated_from_orders(spark, sf):
    """Invoices of a dataset made from the given orders."""
    return given_orders(spark, sf)["invoices"].select("invoice_id", "inv_fiscal_year", "inv_amount", "inv_currency_code", "inv_document_date", "inv_due_date")


@query
def generated_payments_of_orders(spark, sf):
    """What the payments of each match made from the given orders add up to."""
    t = given_orders(spark, sf)
    paid = pairs.members(t["matches"], "payment_ids", "payment_id").join(t["payments"].select("payment_id", "pay_amount", "pay_posting_date"), "payment_id")
    return paid.groupBy("match_id").agg(F.count(F.lit(1)).alias("payments"), F.sum("pay_amount").cast(money.MONEY).alias("paid"), F.max("pay_posting_date").alias("last_date"))


# ---------------------------------------------------------------- files

def _folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


@query
def csv_round_trip(spark, sf):
    """The one-table views under descriptive names, through CSV and back by explicit schemas."""
    m = bridge.matching(spark, sf)
    lists = m.info.select("match_id", "match_category", "perturbation_categories",
                          F.array("match_id").alias("invoice_ids"), F.array("match_id").alias("payment_ids"))
    shown = {"invoices": views.single_table_view(m.invoices, "invoice", "descriptive"),
             "payments": views.single_table_view(m.payments, "payment", "descriptive"),
             "matches": views.match_view(lists)}
    base = _folder(spark, "csv")
    tables.write_views({("descriptive", t): df for t, df in shown.items()}, base, "multi", "csv")
    return tables.read_tables(spark, base, "multi", "descriptive", "csv")["invoices"]


@query
def csv_round_trip_matches(spark, sf):
    """Matches of the generated dataset with their id lists and errors, through CSV and back."""
    t = generated(spark, sf, "multi")
    base = _folder(spark, "csv")
    tables.write_views({("opaque", "invoices"): views.single_table_view(t["invoices"], "invoice", "opaque"), ("opaque", "payments"): views.single_table_view(t["payments"], "payment", "opaque"),
                        ("opaque", "matches"): views.match_view(t["matches"].withColumn("perturbation_categories", F.sort_array("perturbation_categories")))}, base, "multi", "csv")
    back = tables.read_tables(spark, base, "multi", "opaque", "csv")["matches"]
    return back.select("match_id", "match_category", *[F.array_join(c, ",").alias(c) for c in ("perturbation_categories", "invoice_ids", "payment_ids")])


@query
def report_file(spark, sf):
    """Report 2 as one CSV file, read back: models in their order as line numbers."""
    path = _folder(spark, "report")
    tables.write_report(reports.report_precision_recall(evaluate.evaluate(scored(spark, sf))).select(
        "model", *[ratio(c).alias(c) for c in ("f1_score", "precision", "recall")]), path)
    back = spark.read.option("header", "true").schema("model string, f1_score decimal(18,10), precision decimal(18,10), recall decimal(18,10)").csv(path)
    return back.withColumn("line", F.monotonically_increasing_id())  # one file: its lines in order


@query
def both_modes(spark, sf):
    """Matches of both perturbation modes in one table, by mode, category and number of errors."""
    both = [generated(spark, sf, mode)["matches"].withColumn("perturbation_mode", F.lit(mode)) for mode in ("single", "multi")]
    return both[0].unionByName(both[1]).groupBy("perturbation_mode", "match_category", F.size("perturbation_categories").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query
def shown_rows(spark, sf):
    """Payments as the opaque view shows them, without their ids, and how often each row occurs."""
    shown = views.strip_ids(views.single_table_view(bridge.matching(spark, sf).payments, "payment", "opaque"), "payment")
    return shown.groupBy(*shown.columns).agg(F.count(F.lit(1)).alias("n"))


@query
def csv_round_trip_documents(spark, sf):
    """Whole texts with quotes and line breaks through CSV."""
    path = _folder(spark, "csv")
    d = bridge.table(spark, sf, "documents").select("doc_id", "text", "lang")
    d.write.options(**tables.CSV_WRITE).csv(path)
    return spark.read.schema("doc_id bigint, text string, lang string").options(**tables.CSV_LINES).csv(path)


@query
def json_round_trip(spark, sf):
    path = _folder(spark, "json")
    tables.write_responses(responses(spark, sf), path)
    read = tables.read_responses(spark, path)
    return read.select("pair_id", "model", text.response_text(F.col("choices")).alias("response_text"),
                       F.col("usage.total_tokens").alias("total_tokens"))


@query
def parquet_round_trip(spark, sf):
    """Labelled pairs with their rows through one nested table. It is written kind by kind: what a kind shuffles is gone before the next begins."""
    path = _folder(spark, "pairs")
    m = bridge.matching(spark, sf)
    plan, payments = plan_of(m), written_table(m.payments, "payments", STORED)
    for kind in pairs.KINDS:
        rows = rows_of_pairs(plan.rows(kind), m.invoices, payments, slim_first=True).withColumn("perturbation_mode", F.lit("multi"))
        tables.write_pairs(rows, path, "perturbation_mode", mode="append")
    back = tables.read_pairs(spark, path)
    return back.select("pair_id", "kind", F.col("source.inv_billing_number").alias("billing"),
                       F.col("target.pay_amount").alias("pay_amount"), "perturbation_mode")


@query
def list_columns_as_text(spark, sf):
    """Lists of whole texts' word lengths, as JSON text and read back."""
    d = bridge.table(spark, sf, "documents")
    lists = d.select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w).cast("bigint")).alias("lengths"))
    stored = tables.encode_lists(lists, "lengths")
    back = tables.decode_ids(stored.withColumn("stored", F.col("lengths")), "lengths")
    return back.select("doc_id", "stored", F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))
