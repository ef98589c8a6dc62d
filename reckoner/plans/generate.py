"""Invoices, payments and matches of any size as narrow expressions over match ids.

Each value is a draw keyed by the match, the slot in the match or the customer. The only shuffle is
the one that numbers invoices and payments; totals per match are grouped inside its partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reckoner.functions import draws, money, text
from reckoner.functions.draws import beta, u01, uint
from reckoner.operators.ranks import dense_id, running_totals_dense
from reckoner.schema import (MULTI_INV, MULTI_PAY, ONE_ONE, PERTURBATION_MODES, PERTURBATIONS, attributes, check_mode)
from reckoner.session import STORED, written_table

# Company codes, weights of errors and currencies, countries per currency, phrases of memo lines.
COMPANY_CODES = tuple(f"{i}000" for i in range(1, 10))
PERTURBATION_WEIGHTS = {p: 0.25 for p in PERTURBATIONS}
CURRENCY_WEIGHTS = {
    "USD": 89, "EUR": 31, "JPY": 17, "GBP": 13, "CNY": 7, "AUD": 6, "CAD": 6, "CHF": 5,
    "HKD": 3, "SGD": 2, "SEK": 2, "KRW": 2, "NOK": 2, "NZD": 2, "INR": 2,
}
COUNTRIES = {
    "USD": ("US", "EC", "SV", "PA", "ZW"), "EUR": ("EU", "DE", "FR", "IT", "ES", "IE", "PT", "GR"),
    "JPY": ("JP",), "GBP": ("GB", "GI", "JE", "GG"), "CNY": ("CN",), "AUD": ("AU", "NZ"), "CAD": ("CA",),
    "CHF": ("CH", "LI"), "HKD": ("HK",), "SGD": ("SG",), "SEK": ("SE",), "KRW": ("KR",), "NOK": ("NO",),
    "NZD": ("NZ",), "INR": ("IN", "NP"),
}
COUNTRY_NAMES = {
    "US": "United States", "EC": "Ecuador", "SV": "El Salvador", "PA": "Panama", "ZW": "Zimbabwe", "EU": "Eurozone",
    "DE": "Germany", "FR": "France", "IT": "Italy", "ES": "Spain", "IE": "Ireland", "PT": "Portugal", "GR": "Greece",
    "JP": "Japan", "GB": "United Kingdom", "GI": "Gibraltar", "JE": "Jersey", "GG": "Guernsey", "CN": "China",
    "AU": "Australia", "NZ": "New Zealand", "CA": "Canada", "CH": "Switzerland", "LI": "Liechtenstein",
    "HK": "Hong Kong", "SG": "Singapore", "SE": "Sweden", "KR": "South Korea", "NO": "Norway", "IN": "India",
    "NP": "Nepal",
}
MEMO_PREFIXES = ("#RECEIPT: ", "payment ", "ORDER OF ", "PAY ", "RECEIPT ", "receipt number ", "")
MEMO_TAILS = (" REF", " ref", " REFERENCE", " NUM", " NO")
ID_PREFIXES = ("REF {{idx}}: ", "ref {{idx}}: ", "no {{idx}}: ", "NO {{idx}}: ", "+ ", "- ", "")
ID_SEPARATORS = ("", " ", ", ", " & ", " | ")

# Parts of the default company names: a name is one of each, numbered when all are used up.
NAME_FIRST = ("Amber", "Birch", "Cedar", "Delta", "Ember", "Fjord", "Garnet", "Harbor", "Indigo", "Juniper",
              "Kestrel", "Lagoon", "Meadow", "Nimbus", "Orchid", "Prairie", "Quartz", "Raven", "Sable", "Tundra")
NAME_SECOND = ("Foods", "Freight", "Textiles", "Optics", "Timber", "Robotics", "Ceramics", "Energy", "Media", "Tools")
NAME_FORM = ("Inc", "LLC", "Group", "Ltd", "and Sons", "PLC")


Size = Callable[["GenConfig", str], Column]


def one(cfg: "GenConfig", mode: str) -> Column:
    return F.lit(1).cast("bigint")


def some_payments(cfg: "GenConfig", mode: str) -> Column:
    return F.lit(2) + F.floor(beta(*cfg.payments_beta, cfg.seed, mode + ".payments", "match_id") * F.lit(cfg.max_num_payments - 2))


def some_invoices(cfg: "GenConfig", mode: str) -> Column:
    return F.lit(2) + F.floor(beta(*cfg.invoices_beta, cfg.seed, mode + ".invoices", "match_id") * F.lit(cfg.max_num_invoices - 2))


@dataclass(frozen=True)
class MatchKind:
    """A kind of match group: its weight and how many payments (at most ``max_num_payments``) and invoices (``max_num_invoices``) it has, as columns over
    ``match_id``. Everything else follows from the numbers: the invoices' total is split over the payments, and a memo over several invoices lists them."""
    weight: float
    payments: Size = one
    invoices: Size = one


# The kinds of matches by name (weights are fixed values). Pass a larger mapping as ``GenConfig.kinds`` to generate further kinds.
MATCH_KINDS: dict[str, MatchKind] = {
    ONE_ONE: MatchKind(0.6),
    MULTI_PAY: MatchKind(0.2, payments=some_payments),
    MULTI_INV: MatchKind(0.2, invoices=some_invoices),
}
CATEGORY_WEIGHTS = {name: kind.weight for name, kind in MATCH_KINDS.items()}


# The defaults of sizes and laws.
@dataclass(frozen=True)
class GenConfig:
    """Sizes and laws of a dataset; ``*_beta`` are the (alpha, beta) of Beta laws in whole numbers."""
    seed: int = 0
    num_customers: int = 50
    perturbation_probability: float = 0.75
    kinds: Mapping[str, MatchKind] = field(default_factory=lambda: dict(MATCH_KINDS))
    perturbation_weights: Mapping[str, float] = field(default_factory=lambda: dict(PERTURBATION_WEIGHTS))
    currency_weights: Mapping[str, float] = field(default_factory=lambda: dict(CURRENCY_WEIGHTS))
    max_num_payments: int = 5
    payments_beta: tuple[int, int] = (1, 5)
    max_num_invoices: int = 10
    invoices_beta: tuple[int, int] = (2, 5)
    min_year: int = 2000
    max_year: int = 2024
    max_amount: int = 1_000_000
    amount_beta: tuple[int, int] = (2, 10)
    max_days: int = 60
    days_beta: tuple[int, int] = (2, 5)
    max_terms: int = 30
    company_drop: int = 2
    item_drop: int = 10
    not_from_assignment_number: float = 0.2
    max_deduction_usd: float = 0.1
    max_deduction_fraction: str = "0.1"
    deduction_beta: tuple[int, int] = (3, 5)
    name_mode: str = "listed"  # or "broken": what the payments of a renamed partner show


# ---------------------------------------------------------------- dimensions

def company_names(customers: DataFrame) -> DataFrame:
    """Default names by rule over a dense ``customer`` number: (customer, name, bank_statement)."""
    def part(values: Sequence[str], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + F.lit(1)).cast("int"))

    n1, n2, n3 = len(NAME_FIRST), len(NAME_SECOND), len(NAME_FORM)
    i = F.col("customer")
    first = part(NAME_FIRST, F.pmod(i, F.lit(n1)))
    second = part(NAME_SECOND, F.pmod(F.floor(i / n1), F.lit(n2)))
    form = part(NAME_FORM, F.pmod(F.floor(i / (n1 * n2)), F.lit(n3)))
    lap = F.floor(i / (n1 * n2 * n3))
    number = F.when(lap > 0, F.concat(F.lit(" "), lap.cast("string"))).otherwise(F.lit(""))
    statement = F.concat(F.upper(F.substring(first, 1, 3)), F.lit("-"), F.upper(F.substring(second, 1, 4)), number)
    return customers.select("customer", F.concat(first, number, F.lit(" "), second, F.lit(" "), form).alias("name"),
                            statement.alias("bank_statement"))


def listed_names(names: DataFrame) -> DataFrame:
    """A user's list (pos, name, bank_statement) with repeated names: the first statement name of a
    name counts, and the names are numbered by their lowest position. The list is a dimension of at
    most some thousand rows, numbered after grouping."""
    once = names.groupBy(F.substring("name", 1, 35).alias("name")).agg(
        F.min("pos").alias("_pos"), F.min_by("bank_statement", "pos").alias("bank_statement"))
    return dense_id(once, ["_pos"], "customer").select("customer", "name", "bank_statement")


def customers_dim(spark: SparkSession, cfg: GenConfig, names: DataFrame | None = None) -> DataFrame:
    """What is fixed per customer: id, names, currency, country, memo style. One row per customer."""
    n, s = cfg.num_customers, cfg.seed
    ids = spark.range(n).withColumnRenamed("id", "customer")
    named = company_names(ids) if names is None else listed_names(names).where(F.col("customer") < n)
    if names is not None and named.count() < n:
        raise ValueError(f"too few names for {n} customers")
    key = "customer"
    space = 26**3 * 10**7
    step = space // n
    spot = draws.permuted(F.col(key), n, s + 1) * F.lit(step) + draws.below(step, u01(s, "customer_id", key))
    letter = lambda div: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                                  (F.pmod(F.floor(spot / F.lit(div)), F.lit(26)) + F.lit(1)).cast("int"), F.lit(1))
    customer_id = F.concat(letter(26**2 * 10**7), letter(26 * 10**7), letter(10**7),
                           F.lpad(F.pmod(spot, F.lit(10**7)).cast("string"), 7, "0"))
    currency = draws.weighted(list(cfg.currency_weights), list(cfg.currency_weights.values()), u01(s, "currency", key))
    by_currency = F.create_map(*[x for k, v in COUNTRIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    country_names = F.create_map(*[F.lit(x) for kv in COUNTRY_NAMES.items() for x in kv])
    tail = F.when(u01(s, "tail", key) < F.lit(0.5), draws.pick(MEMO_TAILS, u01(s, "tail_word", key))).otherwise(F.lit(""))
    return named.select(
        key, customer_id.alias("inv_customer_id"), F.substring("name", 1, 35).alias("inv_customer_name"),
        "bank_statement", currency.alias("inv_currency_code"),
    ).withColumn("inv_country_key", draws.pick(F.element_at(by_currency, F.col("inv_currency_code")), u01(s, "country", key))
    ).withColumns({
        "inv_country_name": F.element_at(country_names, F.col("inv_country_key")),
        "memo_prefix": draws.pick(MEMO_PREFIXES, u01(s, "memo_prefix", key)),
        "memo_billing_first": u01(s, "memo_order", key) < F.lit(0.5),
        "memo_noise": u01(s, "memo_noise", key) < F.lit(0.2),
        "memo_tail": F.when(u01(s, "memo_tail", key) < F.lit(0.2), F.concat(tail, F.lit(" "))),
        "memo_id_template": F.concat(draws.pick(ID_PREFIXES, u01(s, "id_prefix", key)), F.lit("{{identifier}}")),
        "memo_id_separator": draws.pick(ID_SEPARATORS, u01(s, "id_separator", key)),
        "_accounts": F.create_map(*[x for code in map(F.lit, COMPANY_CODES) for x in (code, account_number(cfg, code))]),
    })


def account_number(cfg: GenConfig, company: Column | str = "inv_company_code") -> Column:
    """Account fixed per (customer, company), unique by construction: country, two digits, four
    letters and a 14-digit number."""
    s, n = cfg.seed, cfg.num_customers * 9
    index = F.col("customer") * F.lit(9) + (F.substring(company, 1, 1).cast("bigint") - F.lit(1))
    key = ("customer", company)
    step = 10**14 // n
    spot = draws.permuted(index, n, s + 2) * F.lit(step) + draws.below(step, u01(s, "account", *key))
    return F.concat("inv_country_key", draws.rand_chars("0123456789", 2, s, "account_check", *key),
                    draws.rand_chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4, s, "account_bank", *key),
                    F.lpad(spot.cast("string"), 14, "0"))


# ---------------------------------------------------------------- match plan

def plan_matches(keys: DataFrame, cfg: GenConfig, mode: str) -> DataFrame:
    """Category, planted errors and group sizes of each ``match_id``."""
    check_mode(mode, PERTURBATION_MODES, "perturbation mode")
    s, key = cfg.seed, "match_id"
    category = draws.weighted(list(cfg.kinds), [k.weight for k in cfg.kinds.values()], u01(s, mode + ".category", key))
    names, weights = list(cfg.perturbation_weights), list(cfg.perturbation_weights.values())
    if mode == "single":
        errors = F.array(draws.weighted(names, weights, u01(s, "single.error", key)))
    else:
        size = uint(1, len(names), u01(s, "multi.errors", key))
        errors = draws.weighted_subset(names, weights, size, s, "multi.error", key)
    dirty = u01(s, mode + ".dirty", key) < F.lit(cfg.perturbation_probability)

    def size(of: Callable[[MatchKind], Size]) -> Column:
        """The size column of each row's kind; kinds of one need no branch."""
        out = F
        for name, kind in cfg.kinds.items():
            if of(kind) is not one:
                out = out.when(F.col("match_category") == name, of(kind)(cfg, mode).cast("bigint"))
        return one(cfg, mode) if out is F else out.otherwise(one(cfg, mode))

    planned = keys.withColumn("match_category", category)
    return planned.withColumns({
        "perturbation_categories": F.when(dirty, errors).otherwise(F.array().cast("array<string>")),
        "num_payments": size(lambda kind: kind.payments),
        "num_invoices": size(lambda kind: kind.invoices),
    })


def effective_perturbations() -> Column:
    """Planted errors that can show: a memo of several invoices has no assignment number."""
    return F.when(F.col("num_invoices") > 1, F.array_remove(
        F.col("perturbation_categories"), "perturbed_assignment_number")).otherwise(F.col("perturbation_categories"))


# ---------------------------------------------------------------- invoices

@dataclass(frozen=True)
class Context:
    cfg: GenConfig
    mode: str
    n_slots: int  # bound of the unique slot number

    def u(self, tag: str, *key: str) -> Column:
        return u01(self.cfg.seed, f"{self.mode}.{tag}", *key)

    def beta(self, a: int, b: int, tag: str, *key: str) -> Column:
        return beta(a, b, self.cfg.seed, f"{self.mode}.{tag}", *key)

    def unique_rank(self, shift: int) -> Column:
        return draws.permuted(F.col("_slot_number"), self.n_slots, self.cfg.seed + shift)


def _assignment(c: Context) -> Column:
    return F.concat(F.lit("INV"), draws.unique_value(c.unique_rank(3), c.n_slots, 15).cast("string"))


def _billing(c: Context) -> Column:
    """The last ten digits of the assignment number (they stay in the lower half of the ten-digit
    numbers) or a number of the upper half."""
    step = 5 * 10**9 // c.n_slots
    if step < 1 or c.n_slots + 10**9 > 5 * 10**9:
        raise ValueError("too many invoices for unique ten-digit billing numbers")
    other = F.lit(5 * 10**9) + c.unique_rank(4) * F.lit(step) + draws.below(step, c.u("billing", "_slot_number"))
    own = c.u("billing_kind", "_slot_number") < F.lit(c.cfg.not_from_assignment_number)
    return F.when(own, other.cast("string")).otherwise(F.right(F.col("inv_assignment_number"), F.lit(10)))


Filler = tuple[str, Callable[[Context], Column]]

# Columns in the order in which they are added; a later one may read an earlier one. Add to a copy of
# this list to generate further columns.
INVOICE_FILLERS: list[Filler] = [
    ("inv_client", lambda c: F.lit("001")),
    ("inv_company_code", lambda c: draws.exp_drop(COMPANY_CODES, c.cfg.company_drop,
                                                     c.u("company", "match_id"))),
    ("inv_fiscal_year", lambda c: uint(c.cfg.min_year, c.cfg.max_year, c.u("year", "match_id")).cast("int")),
    ("inv_document_number", lambda c: draws.unique_value(c.unique_rank(5), c.n_slots, 10).cast("string")),
    ("inv_line_item_number", lambda c: draws.exp_drop([f"00{i}" for i in range(1, 10)], c.cfg.item_drop,
                                                         c.u("item", "_slot_number"))),
    ("inv_assignment_number", _assignment),
    ("inv_billing_number", _billing),
    ("inv_amount", lambda c: money.to_currency(
        c.beta(*c.cfg.amount_beta, "amount", "_slot_number") * F.lit(c.cfg.max_amount), F.col("inv_currency_code"))),
    ("inv_document_date", lambda c: money.format_day(
        money.day_in_year(F.col("inv_fiscal_year"), c.u("document", "_slot_number")))),
    ("inv_due_date", lambda c: money.add_days(F.col("inv_document_date"), F.floor(
        c.beta(*c.cfg.days_beta, "due", "_slot_number") * F.lit(c.cfg.max_days)))),
    ("inv_terms_of_payment", lambda c: F.lpad(uint(1, c.cfg.max_terms, u01(
        c.cfg.seed, "terms", "customer", "inv_company_code")).cast("string"), 4, "0")),
]


# Fillers for keys that come with an invoice of their own (columns given_amount, given_date): where a match has one invoice, it has that amount and date, whatever
# the number of its payments; the invoices of a larger match follow the laws.
def _given(name: str, given: Callable[[], Column]) -> Filler:
    law = dict(INVOICE_FILLERS)[name]
    return name, lambda c: F.when((F.col("num_invoices") == 1) & given().isNotNull(), given()).otherwise(law(c))


GIVEN_FILLERS: list[Filler] = [
    _given(name, {"inv_fiscal_year": lambda: F.year("given_date"), "inv_amount": lambda: F.col("given_amount").cast(money.MONEY),
                  "inv_document_date": lambda: money.format_day(F.to_date("given_date"))}[name])
    if name in ("inv_fiscal_year", "inv_amount", "inv_document_date") else (name, build) for name, build in INVOICE_FILLERS]


def fill(df: DataFrame, fillers: Sequence[Filler], context: Context) -> DataFrame:
    for name, build in fillers:
        df = df.withColumn(name, build(context))
    return df


def build_invoices(plan: DataFrame, customers: DataFrame, context: Context,
                   fillers: Sequence[Filler] = tuple(INVOICE_FILLERS)) -> DataFrame:
    """Invoice rows of a numbered plan; slots of a match share customer, company and year."""
    cfg = context.cfg
    placed = plan.withColumn("customer", draws.below(cfg.num_customers, context.u("customer", "match_id")))
    slots = (placed.join(customers, "customer")
             .withColumn("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("num_invoices") - F.lit(1))))
             .withColumn("_slot_number", F.col("match_id") * F.lit(cfg.max_num_invoices) + F.col("slot"))
             .withColumn("invoice_id", F.col("num_invoices_before") + F.col("slot")))
    # the account of a usual company code is looked up among those of its customer; payments compute that of any other code
    return fill(slots, fillers, context).withColumn("_account", F.try_element_at("_accounts", F.col("inv_company_code"))).drop("_accounts")


# ---------------------------------------------------------------- payments

def _carried(invoices: DataFrame) -> DataFrame:
    """One row per match: total, latest date and ids of its invoices. Most matches have one invoice, whose row says all that; only the others are grouped.
    Grouping on ``_slice`` as well keeps the partitions of the numbering; a match has at most ``max_num_invoices`` invoices."""
    keep = ("match_category", "perturbation_categories", "num_payments", "num_payments_before", "customer",
            "inv_company_code", "inv_customer_id", "inv_customer_name", "inv_currency_code", "inv_country_key",
            "bank_statement", "memo_prefix", "memo_billing_first", "memo_noise", "memo_tail", "memo_id_template",
            "memo_id_separator", "_account")
    shown = F.struct("slot", "inv_billing_number", "inv_assignment_number")
    alone = invoices.where("num_invoices = 1").select(
        "_slice", "match_id", F.col("inv_amount").cast(money.MONEY).alias("total_amount"),
        F.col("inv_document_date").alias("last_document_date"), F.array(shown).alias("_ids"), *keep)
    grouped = invoices.where("num_invoices <> 1").groupBy("_slice", "match_id").agg(
        F.sum("inv_amount").cast(money.MONEY).alias("total_amount"),
        F.max("inv_document_date").alias("last_document_date"), F.array_sort(F.collect_list(shown)).alias("_ids"),
        *[F.first(c).alias(c) for c in keep])
    return alone.unionByName(grouped)


def has(error: str) -> Column:
    return F.array_contains("perturbation_categories", error)


def memo_line(c: Context) -> Column:
    """Memo in the customer's style around the ids of the match, broken where so planned.

    One invoice: a broken id is always shown, an unbroken one for a fifth of the payments, and one of
    the two when neither is. Several invoices: all billing numbers, no assignment number."""
    key, s = "payment_id", c.cfg.seed
    billing, assignment = F.col("_ids")[0]["inv_billing_number"], F.col("_ids")[0]["inv_assignment_number"]
    noise_1 = draws.sap_number(uint(3, 15, c.u("noise1_len", key)), c.u("noise1", key))
    noise_2 = draws.rand_chars("abcdefghijklmnopqrstuvwxyz0123456789", uint(3, 15, c.u("noise2_len", key)),
                               s, c.mode + ".noise2", key)
    broken_b, broken_a = has("perturbed_billing_number"), has("perturbed_assignment_number")
    shown_b, shown_a = F.col("_shown_billing"), F.col("_shown_assignment")
    neither, by_billing = ~shown_b & ~shown_a, c.u("show_one", key) < F.lit(0.5)
    text_b = F.when(broken_b, text.break_identifier(billing, s, c.mode + ".billing", key)).when(
        shown_b | (neither & by_billing), billing).otherwise(F.lit(""))
    text_a = F.when(broken_a, text.break_identifier(assignment, s, c.mode + ".assignment", key)).when(
        shown_a | (neither & ~by_billing), assignment).otherwise(F.lit(""))
    several = F.transform("_ids", lambda x: F.when(broken_b, text.break_identifier(
        x["inv_billing_number"], s, c.mode + ".billing_of", key, x["slot"])).otherwise(x["inv_billing_number"]))
    all_b = text.join_ids(several, F.col("memo_id_template"), F.col("memo_id_separator"))
    is_multi = F.size("_ids") > 1
    text_b = F.when(is_multi, all_b).otherwise(text_b)
    text_a = F.when(is_multi, F.lit("")).otherwise(text_a)
    noise = F.when(F.col("memo_noise"), F.concat(noise_1, F.lit(" "))).otherwise(F.lit(""))
    first_b = F.col("memo_billing_first")
    tail = F.when(F.col("memo_tail").isNotNull(), F.concat(F.col("memo_tail"), noise_2)).otherwise(F.lit(""))
    return F.concat("memo_prefix", F.when(first_b, text_b).otherwise(text_a), F.lit(" "), noise,
                    F.when(first_b, text_a).otherwise(text_b), tail)


def _partner(c: Context) -> Column:
    name = F.col("inv_customer_name")
    check_mode(c.cfg.name_mode, ("listed", "broken"), "name mode")
    if c.cfg.name_mode == "listed":
        missing = F.raise_error(F.concat(F.lit("no statement name for "), name)).cast("string")
        other = F.coalesce(F.col("bank_statement"), missing)
    else:
        other = text.break_name(name, c.cfg.seed, c.mode + ".name", "payment_id")
    return F.when(has("perturbed_business_partner"), other).otherwise(name)


PAYMENT_FILLERS: list[Filler] = [
    ("pay_business_partner", _partner),
    ("pay_account_number", lambda c: F.coalesce(F.col("_account"), account_number(c.cfg))),
    ("pay_memo_line", memo_line),
    ("pay_amount", lambda c: F.when(has("small_deduction"), money.small_deduction(
        F.col("_amount"), F.col("inv_currency_code"), c.beta(*c.cfg.deduction_beta, "deduction", "payment_id"),
        c.cfg.max_deduction_usd, c.cfg.max_deduction_fraction)).otherwise(F.col("_amount"))),
    ("pay_currency", lambda c: F.col("inv_currency_code")),
    ("pay_posting_date", lambda c: money.add_days(F.col("last_document_date"), F.floor(
        c.beta(*c.cfg.days_beta, "posting", "payment_id") * F.lit(c.cfg.max_days)))),
]


def build_payments(invoices: DataFrame, context: Context,
                   fillers: Sequence[Filler] = tuple(PAYMENT_FILLERS)) -> DataFrame:
    """Payment rows of the invoice rows of ``build_invoices``."""
    weights = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("num_payments")),
                          lambda i: context.u("part", "match_id", i))
    parts = F.when(F.col("num_payments") == 1, F.array("total_amount")).otherwise(
        money.split_amount(F.col("total_amount"), weights))
    slots = (_carried(invoices).select("*", F.posexplode(parts).alias("pay_slot", "_amount"))
             .withColumn("payment_id", F.col("num_payments_before") + F.col("pay_slot"))
             .withColumns({f"_shown_{t}": has(f"perturbed_{t}_number") | (context.u(f"show_{t}", "payment_id") < F.lit(0.2))
                           for t in ("billing", "assignment")}))  # the memo looks at them more than once
    return fill(slots, fillers, context)


# ---------------------------------------------------------------- dataset

def generate(keys: DataFrame, n: int, cfg: GenConfig, mode: str, names: DataFrame | None = None,
             invoice_fillers: Sequence[Filler] = tuple(INVOICE_FILLERS),
             payment_fillers: Sequence[Filler] = tuple(PAYMENT_FILLERS)) -> dict[str, DataFrame]:
    """Tables of one perturbation mode for the dense match ids 0..n-1 in ``keys``."""
    context = Context(cfg, mode, n * cfg.max_num_invoices)
    plan = running_totals_dense(plan_matches(keys, cfg, mode), "match_id", ["num_invoices", "num_payments"])
    customers = customers_dim(keys.sparkSession, cfg, names)
    wide_invoices = build_invoices(plan, customers, context, invoice_fillers)
    wide_payments = build_payments(wide_invoices, context, payment_fillers)
    extra_i = [f[0] for f in invoice_fillers if f[0] not in {a.name for a in attributes("invoice")}]
    extra_p = [f[0] for f in payment_fillers if f[0] not in {a.name for a in attributes("payment")}]

    def ids(name: str) -> Column:
        return F.sequence(F.col(f"{name}_before"), F.col(f"{name}_before") + F.col(name) - F.lit(1))

    return {
        "invoices": wide_invoices.select("invoice_id", *[a.name for a in attributes("invoice")], *extra_i),
        "payments": wide_payments.select("payment_id", *[a.name for a in attributes("payment")], *extra_p),
        "matches": plan.select("match_id", "match_category", "perturbation_categories",
                               ids("num_invoices").alias("invoice_ids"), ids("num_payments").alias("payment_ids"),
                               effective_perturbations().alias("effective_perturbations")),
    }


def written(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The base tables of a mode, written once: views and reports read them, the dataset is not computed again for each."""
    return {name: written_table(df, f"generated-{name}", STORED) for name, df in tables.items()}


def generate_dataset(spark: SparkSession, n: int, cfg: GenConfig = GenConfig(),
                     names: DataFrame | None = None) -> dict[str, DataFrame]:
    """Both perturbation modes in one table each, with the mode as a column; customers are shared."""
    both = {mode: generate(spark.range(n).withColumnRenamed("id", "match_id"), n, cfg, mode, names)
            for mode in PERTURBATION_MODES}
    return {
        name: both["single"][name].withColumn("perturbation_mode", F.lit("single")).unionByName(
            both["multi"][name].withColumn("perturbation_mode", F.lit("multi")))
        for name in ("invoices", "payments", "matches")
    }
