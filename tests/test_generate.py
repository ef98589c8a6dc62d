"""The generator: laws, keys, groups, views."""

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from reckoner.functions import draws, text
from reckoner.operators import views
from reckoner.plans import generate
from reckoner.session import configure, written_table
from reckoner.sources import tables

N = 3000


@pytest.fixture(scope="module")
def data(spark):
    keys = spark.range(N).withColumnRenamed("id", "match_id")
    return {mode: {k: written_table(v, k) for k, v in generate.generate(keys, N, generate.GenConfig(seed=5), mode).items()}
            for mode in ("single", "multi")}


def test_shares_and_sizes(data):
    for mode in data:
        rows = data[mode]["matches"].collect()
        share = Counter(r.match_category for r in rows)
        assert share["one_pay_one_inv"] / N == pytest.approx(0.6, abs=0.03)
        assert sum(bool(r.perturbation_categories) for r in rows) / N == pytest.approx(0.75, abs=0.03)
        most = max(len(r.perturbation_categories) for r in rows)
        assert most == (1 if mode == "single" else 4)
        assert max(len(r.invoice_ids) for r in rows) <= 9 and max(len(r.payment_ids) for r in rows) <= 4
        assert all(len(r.invoice_ids) == 1 or r.match_category == "one_pay_multi_inv" for r in rows)


def test_ids_are_dense_and_owned_once(data):
    for t, ids in (("invoices", "invoice_ids"), ("payments", "payment_ids")):
        listed = [i for r in data["multi"]["matches"].orderBy("match_id").collect() for i in r[ids]]
        assert listed == list(range(len(listed)))
        assert sorted(r[0] for r in data["multi"][t].select(t[:-1] + "_id").collect()) == listed


def test_unique_numbers_and_fixed_choices(data):
    inv = data["multi"]["invoices"].collect()
    for c in ("inv_document_number", "inv_assignment_number", "inv_billing_number"):
        assert len({r[c] for r in inv}) == len(inv)
    assert all(len(r.inv_document_number) == 10 and len(r.inv_assignment_number) == 18 and len(r.inv_billing_number) == 10
               for r in inv)
    for c in ("inv_customer_name", "inv_currency_code", "inv_country_key"):
        assert len({(r.inv_customer_id, r[c]) for r in inv}) == 50
    assert len({r.inv_customer_name for r in inv}) == 50
    shared = {(r.inv_customer_id, r.inv_customer_name) for r in data["single"]["invoices"].collect()}
    assert shared == {(r.inv_customer_id, r.inv_customer_name) for r in inv}
    terms = {(r.inv_customer_id, r.inv_company_code, r.inv_terms_of_payment) for r in inv}
    assert len(terms) == len({t[:2] for t in terms})


def test_payments_settle_their_invoices(data):
    inv = {r.invoice_id: r for r in data["multi"]["invoices"].collect()}
    pay = {r.payment_id: r for r in data["multi"]["payments"].collect()}
    accounts = {}
    for m in data["multi"]["matches"].collect():
        invoices, payments = [inv[i] for i in m.invoice_ids], [pay[p] for p in m.payment_ids]
        total, paid = sum(r.inv_amount for r in invoices), sum(p.pay_amount for p in payments)
        if "small_deduction" in m.perturbation_categories:
            assert Decimal(0) <= total - paid <= Decimal(150 * len(payments))
        else:
            assert total == paid
        renamed = "perturbed_business_partner" in m.perturbation_categories
        assert all((p.pay_business_partner != invoices[0].inv_customer_name) == renamed for p in payments)
        assert all(p.pay_posting_date >= max(r.inv_document_date for r in invoices) for p in payments)
        if len(invoices) > 1 and "perturbed_billing_number" not in m.perturbation_categories:
            assert all(r.inv_billing_number in payments[0].pay_memo_line for r in invoices)
        if not {"perturbed_billing_number", "perturbed_assignment_number"} & set(m.perturbation_categories):
            first = invoices[0]
            assert all(first.inv_billing_number in p.pay_memo_line or first.inv_assignment_number in p.pay_memo_line
                       for p in payments)
        for p in payments:
            key = (invoices[0].inv_customer_id, invoices[0].inv_company_code)
            assert accounts.setdefault(key, p.pay_account_number) == p.pay_account_number
            assert p.pay_account_number[:2] == invoices[0].inv_country_key and len(p.pay_account_number) == 22


def test_same_rows_for_any_partitioning(spark):
    seen = set()
    for n in (1, 16):
        keys = spark.range(0, 200, 1, n).withColumnRenamed("id", "match_id")
        t = generate.generate(keys, 200, generate.GenConfig(seed=5), "multi")
        seen.add(tuple(repr(sorted(map(repr, t[k].collect()))) for k in ("invoices", "payments", "matches")))
    assert len(seen) == 1


def test_names_listed_by_the_user_and_added_columns(spark):
    rows = [(i, f"Firm {i % 40}", f"F{i}") for i in range(60)]
    names = spark.createDataFrame(rows, "pos int, name string, bank_statement string")
    cfg = generate.GenConfig(seed=1, num_customers=40)
    keys = spark.range(300).withColumnRenamed("id", "match_id")
    fillers = [*generate.INVOICE_FILLERS, ("inv_double", lambda c: F.col("inv_amount") * 2)]
    t = generate.generate(keys, 300, cfg, "single", names, invoice_fillers=fillers)
    inv = t["invoices"].collect()
    assert {r.inv_customer_name for r in inv} <= {f"Firm {i}" for i in range(40)}
    assert all(r.inv_double == r.inv_amount * 2 for r in inv)
    statements = {r.pay_business_partner for r in t["payments"].collect() if r.pay_business_partner.startswith("F")}
    assert statements & {f"F{i}" for i in range(40)} and not statements & {f"F{i}" for i in range(40, 60)}
    with pytest.raises(ValueError, match="names for 41 customers"):
        generate.customers_dim(spark, generate.GenConfig(num_customers=41), names)


def test_given_invoices_keep_their_amounts_and_dates(spark):
    keys = spark.range(400).select(F.col("id").alias("match_id"), (F.col("id") * 3 + 7).cast("decimal(15,2)").alias("given_amount"),
                                   F.when(F.col("id") % 5 != 0, F.date_add(F.lit("2011-02-20").cast("date"), F.col("id").cast("int"))).alias("given_date"))
    t = generate.generate(keys, 400, generate.GenConfig(seed=3), "single", invoice_fillers=generate.GIVEN_FILLERS)
    plain = {r.invoice_id: r for r in generate.generate(keys.select("match_id"), 400, generate.GenConfig(seed=3), "single")["invoices"].collect()}
    inv = {r.invoice_id: r for r in t["invoices"].collect()}
    given = {r.match_id: r for r in keys.collect()}
    several = 0
    for m in t["matches"].collect():
        for i in m.invoice_ids:
            if len(m.invoice_ids) > 1:
                several += 1
                assert inv[i] == plain[i]
            else:
                g = given[m.match_id]
                assert inv[i].inv_amount == g.given_amount
                assert inv[i].inv_document_date == (g.given_date.strftime("%Y%m%d") if g.given_date else plain[i].inv_document_date)
                assert inv[i].inv_due_date >= inv[i].inv_document_date
    assert several > 50


def test_a_kind_that_the_user_adds(spark):
    kinds = {"many": generate.MatchKind(1.0, generate.some_payments, lambda cfg, mode: F.lit(4).cast("bigint"))}
    t = generate.generate(spark.range(60).withColumnRenamed("id", "match_id"), 60, generate.GenConfig(seed=3, kinds=kinds, perturbation_probability=0.0), "multi")
    inv, pay = {r.invoice_id: r for r in t["invoices"].collect()}, {r.payment_id: r for r in t["payments"].collect()}
    for m in t["matches"].collect():
        assert m.match_category == "many" and len(m.invoice_ids) == 4 and 2 <= len(m.payment_ids) <= 4
        assert sum(inv[i].inv_amount for i in m.invoice_ids) == sum(pay[p].pay_amount for p in m.payment_ids)
        assert all(inv[i].inv_billing_number in pay[p].pay_memo_line for i in m.invoice_ids for p in m.payment_ids)


def test_views_through_files(spark, data, tmp_path):
    made = views.schema_views(*(data["multi"][t] for t in ("invoices", "payments", "matches")))
    for fmt in ("csv", "parquet"):
        base = str(tmp_path / fmt)
        tables.write_views(made, base, "multi", fmt)
        for mode in ("descriptive", "opaque", "multi-table"):
            for name, back in tables.read_tables(spark, base, "multi", mode, fmt).items():
                want = made[mode, name]
                assert back.columns == want.columns, (mode, name)
                assert sorted(map(repr, back.collect())) == sorted(map(repr, want.collect())), (fmt, mode, name)
    assert ("multi-table", "invoices_KNA-1") in made and ("multi-table", "payments_FEBEP") in made


def test_both_modes_in_one_dataset(spark):
    t = generate.generate_dataset(spark, 50)
    assert {r.perturbation_mode: r["count"] for r in t["matches"].groupBy("perturbation_mode").count().collect()} == {
        "single": 50, "multi": 50}


def test_weighted_subset_runs_in_generated_code(spark):
    """The planted errors are drawn once per match: an expression with a lambda falls out of generated code."""
    names = list("abcd")
    drawn = draws.weighted_subset(names, [1.0, 2.0, 3.0, 4.0], F.col("id") % 5, 3, "errors", "id")
    rows = spark.range(200).select("id", drawn.alias("v"), F.array(*[
        F.struct((-F.log(draws.u01(3, f"errors{i}", "id") + F.lit(2.0**-53)) / F.lit(float(i + 1))).alias("k"), F.lit(n).alias("v")) for i, n in enumerate(names)]).alias("all"))
    assert "lambda" not in spark.range(2).select(drawn)._jdf.queryExecution().optimizedPlan().toString()
    for r in rows.collect():
        assert r.v == [x.v for x in sorted(r["all"], key=lambda x: x.k)][:r.id % 5]


def test_wide_stages_are_not_left_uncompiled(spark):
    assert int(configure(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_one_number_decides_the_kind_of_an_error(spark):
    df = spark.range(5).select("id", F.lit("INV1234567").alias("s")).select(text.break_identifier("s", 1, "brk", "id").alias("b"))
    assert df._jdf.queryExecution().analyzed().toString().count("1|brk.branch") == 1


def test_accounts_are_drawn_per_customer_and_company(spark):
    """The account of a usual company code is looked up; that of a code the customers do not know is computed, with the same law."""
    cfg = generate.GenConfig(seed=3)
    keys = spark.range(400).withColumnRenamed("id", "match_id")
    rows = generate.customers_dim(spark, cfg).withColumn("inv_company_code", F.explode(F.array(F.lit("1000"), F.lit("9000"))))
    assert rows.where(F.col("_accounts")[F.col("inv_company_code")] != generate.account_number(cfg)).isEmpty()
    odd = [(n, (lambda c: F.lit("4711")) if n == "inv_company_code" else f) for n, f in generate.INVOICE_FILLERS]
    t = generate.generate(keys, 400, cfg, "multi", invoice_fillers=odd)
    made = generate.customers_dim(spark, cfg).withColumn("inv_company_code", F.lit("4711")).select(generate.account_number(cfg).alias("pay_account_number"))
    assert t["payments"].count() >= 400 and t["payments"].join(made, "pay_account_number", "left_anti").isEmpty()


def test_only_matches_of_several_invoices_are_grouped(spark):
    keys = spark.range(300).withColumnRenamed("id", "match_id")
    cfg = generate.GenConfig(seed=3)
    context = generate.Context(cfg, "multi", 300 * cfg.max_num_invoices)
    plan = generate.running_totals_dense(generate.plan_matches(keys, cfg, "multi"), "match_id", ["num_invoices", "num_payments"])
    carried = generate._carried(generate.build_invoices(plan, generate.customers_dim(spark, cfg), context))
    assert "Union" in carried._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.match_id, len(r._ids)) for r in carried.collect()} == {(r.match_id, r.num_invoices) for r in plan.collect()}


def test_shared_fields_of_a_payment_are_made_per_match(spark):
    """What all payments of a match share is made below the join that multiplies it, not in the last projection."""
    from reckoner.sources import bridge

    info = spark.createDataFrame(
        [(1, "10.00", "20240105", "CUS0000007", "Customer#000000007", "USD", "N01", "9000000007", "INV100000000000001", ["perturbed_business_partner"])],
        "match_id bigint, total_amount string, last_document_date string, inv_customer_id string, inv_customer_name string, inv_currency_code string, "
        "inv_country_key string, inv_billing_number string, inv_assignment_number string, perturbation_categories array<string>",
    ).withColumn("total_amount", F.col("total_amount").cast("decimal(15,2)"))
    members = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 2, 1)], "match_id bigint, payment_id bigint, line bigint, weight int").withColumn(
        "weight", F.col("weight").cast("decimal(25,2)"))
    out = bridge.payments(info, members)
    assert {(r.pay_business_partner, r.pay_account_number) for r in out.collect()} == {("CUST 00007", "N01" + "0000007".rjust(18, "7"))}
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert not any(c in top for c in ("inv_customer_name", "inv_customer_id", "last_document_date"))
