"""Invoices, payments and matches derived from order, line, customer and nation tables.

An order is an invoice. For about one (customer, year) in five, the year's orders are paid by one
payment advice; every other order with lines is paid by one payment per line number. Orders without either are open: invoices of no match.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reckoner.functions.draws import beta, u01, uint, weighted, weighted_subset
from reckoner.functions.money import MONEY, money, small_deduction
from reckoner.functions.text import break_identifier
from reckoner.operators.joined import split_group_total
from reckoner.operators.pairs import indexed_members
from reckoner.operators.ranks import dense_id
from reckoner.schema import MULTI_INV, MULTI_PAY, ONE_ONE, PERTURBATIONS
from reckoner.session import STORED, written_table

SEED = 11
CURRENCIES = ("USD", "EUR", "JPY", "GBP", "CNY")
ADVICE_SHARE = 0.2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def currency_of(nation: Column) -> Column:
    names = F.array(*[F.lit(c) for c in CURRENCIES])
    return F.element_at(names, (F.pmod(nation, F.lit(len(CURRENCIES))) + F.lit(1)).cast("int"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with customer and nation. The dimensions join by their keys; Spark broadcasts them
    only while they are below its own size threshold."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    wide = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("o_orderkey").cast("string")
    return wide.select(
        F.col("o_orderkey").alias("invoice_id"),
        F.lit("001").alias("inv_client"),
        F.concat((F.pmod(F.col("o_custkey"), F.lit(9)) + F.lit(1)).cast("string"), F.lit("000"))
        .alias("inv_company_code"),
        F.year("o_orderdate").alias("inv_fiscal_year"),
        F.concat(F.lit("1"), F.lpad(key, 9, "0")).alias("inv_document_number"),
        F.concat(F.lit("00"), uint(1, 9, u01(SEED, "item", "o_orderkey")).cast("string"))
        .alias("inv_line_item_number"),
        F.concat(F.lit("INV1"), F.lpad(key, 14, "0")).alias("inv_assignment_number"),
        F.concat(F.lit("9"), F.lpad((F.col("o_orderkey") * F.lit(7)).cast("string"), 9, "0"))
        .alias("inv_billing_number"),
        F.concat(F.lit("CUS"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("inv_customer_id"),
        F.substring("c_name", 1, 35).alias("inv_customer_name"),
        currency_of(F.col("c_nationkey")).alias("inv_currency_code"),
        F.upper(F.substring(F.replace(F.col("n_name"), F.lit("NATION_"), F.lit("N")), 1, 3)).alias("inv_country_key"),
        F.col("o_totalprice").cast(MONEY).alias("inv_amount"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("inv_document_date"),
        F.date_format(F.date_add(F.to_date("o_orderdate"), F.floor(
            beta(2, 5, SEED, "due", "o_orderkey") * F.lit(60)).cast("int")), "yyyyMMdd").alias("inv_due_date"),
        F.lpad(uint(1, 30, u01(SEED, "terms", "o_custkey")).cast("string"), 4, "0").alias("inv_terms_of_payment"),
    )


def _advice_group() -> Column:
    return u01(SEED, "advice", "o_custkey", F.year("o_orderdate")) < F.lit(ADVICE_SHARE)


def invoice_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, invoice_id, by_advice): the match of an advice bears its lowest invoice id.

    A customer-year is one match, whatever its size: it is found by a minimum and an equi join, which Spark splits where a customer-year is hot."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    paid = o.where(_advice_group()).select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    heads = paid.groupBy("o_custkey", "year").agg(F.min("o_orderkey").alias("match_id"))
    advised = paid.join(heads, ["o_custkey", "year"]).select("match_id", F.col("o_orderkey").alias("invoice_id"), F.lit(True).alias("by_advice"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()  # counted down before the shuffle
    direct = (o.where(~_advice_group()).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
              .select(F.col("o_orderkey").alias("match_id"), F.col("o_orderkey").alias("invoice_id"),
                      F.lit(False).alias("by_advice")))
    return advised.unionByName(direct)


def payment_members(spark: SparkSession, sf_dir: str, owners: DataFrame) -> DataFrame:
    """(match_id, payment_id, line, weight, _pay_index): line numbers of an order, or line 0 for an advice, numbered in the order (match, line);
    ``owners`` are the invoice members. Every payment belongs to a match, so a payment's id is its number among the members."""
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber")
             .agg(F.sum(F.col("l_extendedprice").cast(MONEY)).cast("decimal(25,2)").alias("weight")))
    per_line = (lines.join(owners.where(~F.col("by_advice")), F.col("l_orderkey") == F.col("match_id"))
                .select("match_id", F.col("l_linenumber").cast("bigint").alias("line"), "weight"))
    advices = (owners.where("by_advice").select("match_id").distinct()
               .select("match_id", F.lit(0).cast("bigint").alias("line"), F.lit(1).cast("decimal(25,2)").alias("weight")))
    numbered = dense_id(per_line.unionByName(advices), ["match_id", "line"], "_pay_index")
    return written_table(numbered.select("match_id", F.col("_pay_index").alias("payment_id"), "line", "weight", "_pay_index"), "members", STORED)


@dataclass(frozen=True)
class Matching:
    """Invoices, numbered members (open invoices last, without a match) and match rows; members and matches are written tables, so that the
    many steps that use them do not scan and group the order tables again."""
    invoices: DataFrame
    invoice_members: DataFrame
    payment_members: DataFrame
    info: DataFrame

    @property
    def payments(self) -> DataFrame:
        return payments(self.info, self.payment_members.drop("_pay_index"))


def matching(spark: SparkSession, sf_dir: str, columns: Sequence[str] = ()) -> Matching:
    """``columns`` of the match rows if not all are needed: texts and totals that only payments carry are then neither made nor written."""
    inv = invoices(spark, sf_dir)
    every = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"))
    im = indexed_members(invoice_members(spark, sf_dir), "invoice_id", "_inv_index", every)
    pm = payment_members(spark, sf_dir, im)
    info = match_info(inv, im, pm)
    return Matching(inv, im, pm, written_table(info.select(*columns) if columns else info, "matches", STORED))


def match_info(inv: DataFrame, inv_members: DataFrame, pay_members: DataFrame) -> DataFrame:
    """One row per match: category, planted errors, totals and the fields its payments carry over."""
    sums = (inv_members.where(F.col("match_id").isNotNull()).select("match_id", "invoice_id")
            .join(inv.select("invoice_id", "inv_amount", F.to_date("inv_document_date", "yyyyMMdd").alias("_day")),
                  "invoice_id")
            .groupBy("match_id").agg(
                F.count(F.lit(1)).alias("n_invoices"), F.sum("inv_amount").cast(MONEY).alias("total_amount"),
                F.date_format(F.max("_day"), "yyyyMMdd").alias("last_document_date")))
    # a match bears the id of its first invoice, whose fields it carries; its text columns are joined
    # to the sums, because a minimum over text would sort instead of hash
    head = inv.select(F.col("invoice_id").alias("match_id"), "inv_customer_id", "inv_customer_name",
                      "inv_currency_code", "inv_country_key", "inv_billing_number", "inv_assignment_number")
    facts = sums.join(head, "match_id")
    paid = pay_members.groupBy("match_id").agg(F.count(F.lit(1)).alias("n_payments"))
    n_errors = uint(1, len(PERTURBATIONS), u01(SEED, "n_errors", "match_id"))
    errors = weighted_subset(PERTURBATIONS, [1.0] * 4, n_errors, SEED, "errors", "match_id")
    dirty = u01(SEED, "dirty", "match_id") < F.lit(0.75)
    category = (F.when(F.col("n_invoices") > 1, MULTI_INV).when(F.col("n_payments") > 1, MULTI_PAY)
                .otherwise(ONE_ONE))
    return facts.join(paid, "match_id").withColumns({
        "match_category": category,
        "perturbation_categories": F.when(dirty, F.sort_array(errors)).otherwise(F.array().cast("array<string>")),
    })


def payments(info: DataFrame, pay_members: DataFrame) -> DataFrame:
    """Payment rows: split totals, planted errors, a memo line, a posting date. What the payments of a match share is made once per match,
    ahead of the join that multiplies it."""
    totals = pay_members.select("match_id", "payment_id", "weight").join(info.select("match_id", "total_amount"), "match_id")
    split = split_group_total(totals, "match_id", "total_amount", "weight", "payment_id", "part_amount")
    has = lambda e: F.array_contains("perturbation_categories", e)
    partner = F.when(has("perturbed_business_partner"),
                     F.upper(F.replace(F.col("inv_customer_name"), F.lit("Customer#0000"), F.lit("CUST ")))
                     ).otherwise(F.col("inv_customer_name"))
    shared = info.select(
        "match_id", "inv_billing_number", "inv_assignment_number", "inv_currency_code", partner.alias("pay_business_partner"),
        F.concat(F.col("inv_country_key"), F.lpad(F.substring("inv_customer_id", 4, 7), 18, "7")).alias("pay_account_number"),
        weighted(["PAY ", "RECEIPT ", ""], [1, 1, 1], u01(SEED, "prefix", "inv_customer_id")).alias("_prefix"),
        F.to_date("last_document_date", "yyyyMMdd").alias("_last_day"), has("perturbed_billing_number").alias("_bad_billing"),
        has("perturbed_assignment_number").alias("_bad_assignment"), has("small_deduction").alias("_less"))
    m = split.select("match_id", "payment_id", "part_amount").join(shared, "match_id")  # texts last
    # a number that several conditions look at is a column: it is drawn once
    m = m.withColumn("_which", u01(SEED, "which", "payment_id"))
    billing = F.when(F.col("_bad_billing"), break_identifier(
        F.col("inv_billing_number"), SEED, "bill", "payment_id")).otherwise(F.col("inv_billing_number"))
    assignment = F.when(F.col("_bad_assignment"), break_identifier(
        F.col("inv_assignment_number"), SEED, "assign", "payment_id")).otherwise(F.col("inv_assignment_number"))
    which = F.col("_which")
    memo = F.concat(F.col("_prefix"), F.when(which < F.lit(0.4), billing).when(which < F.lit(0.8), assignment)
                    .otherwise(F.concat(billing, F.lit(" "), assignment)))
    amount = F.when(F.col("_less"), small_deduction(
        F.col("part_amount"), F.col("inv_currency_code"), beta(3, 5, SEED, "less", "payment_id"))
    ).otherwise(F.col("part_amount"))
    days = F.floor(beta(2, 5, SEED, "posted", "payment_id") * F.lit(60)).cast("int")
    return m.select(
        "payment_id", "pay_business_partner", "pay_account_number",
        memo.alias("pay_memo_line"),
        money(amount).alias("pay_amount"),
        F.col("inv_currency_code").alias("pay_currency"),
        F.date_format(F.date_add(F.col("_last_day"), days), "yyyyMMdd").alias("pay_posting_date"),
    )
