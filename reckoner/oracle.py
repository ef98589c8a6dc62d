"""Independent SQL (DuckDB) for the queries of ``queries.py``, written out from their definitions."""

from __future__ import annotations

from collections.abc import Iterable
from math import log, pi

from reckoner.functions.money import USD_TO_CURRENCY
from reckoner.plans import generate

SEED, BRIDGE_SEED = 7, 11
MODELS = "['gpt-3.5-turbo-1106', 'gpt-4o-mini-2024-07-18', 'gpt-4o-2024-08-06']"
ERRORS = ["small_deduction", "perturbed_business_partner", "perturbed_billing_number", "perturbed_assignment_number"]
COUNTS = ("count(*) filter (where prediction and truth) AS \"TP\", "
          "count(*) filter (where prediction and not truth) AS \"FP\", "
          "count(*) filter (where not prediction and not truth) AS \"TN\", "
          "count(*) filter (where not prediction and truth) AS \"FN\"")
SUMS = ", ".join(f'sum("{c}")::BIGINT AS "{c}"' for c in ("TP", "FP", "TN", "FN"))
P = 'case when "TP" + "FP" = 0 then 1.0::DOUBLE else "TP"::DOUBLE / ("TP" + "FP") end'
R = 'case when "TP" + "FN" = 0 then 0.0::DOUBLE else "TP"::DOUBLE / ("TP" + "FN") end'
F1 = 'case when 2*"TP" + "FP" + "FN" = 0 then 0.0::DOUBLE else (2*"TP")::DOUBLE / (2*"TP" + "FP" + "FN") end'
TOTAL = '"TP" + "FP" + "TN" + "FN" AS total'


def dec(x: str, name: str) -> str:
    return f"({x})::DECIMAL(18,10) AS {name}"


SCORES = ", ".join([TOTAL, dec(P, "precision"), dec(R, "recall"), dec(F1, "f1")])


# ---------------------------------------------------------------- draws

def u(tag: str, *keys: str, seed: int = SEED) -> str:
    cast = "".join(f", ({k})::VARCHAR" for k in keys)
    return f"(('0x'||substr(md5(concat_ws('|', '{seed}', '{tag}'{cast})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def below(n: str | int, draw: str) -> str:
    return f"floor({draw} * ({n}))::BIGINT"


def uint(lo: str | int, hi: str | int, draw: str) -> str:
    return f"(({lo}) + floor({draw} * (({hi}) - ({lo}) + 1))::BIGINT)"


def beta(a: int, b: int, tag: str, *keys: str, seed: int = SEED) -> str:
    n = a + b - 1
    steps = " * ".join(f"pow(1.0::DOUBLE - {u(f'{tag}{i}', *keys, seed=seed)}, {1.0 / (n - i)!r}::DOUBLE)" for i in range(a))
    return f"(1.0::DOUBLE - {steps})"


def weighted(values: list, weights: list[float], draw: str) -> str:
    total, upto, out = sum(weights), 0.0, "case"
    for v, w in zip(values[:-1], weights[:-1]):
        upto += w
        out += f" when {draw} < {upto / total!r}::DOUBLE then '{v}'"
    return out + f" else '{values[-1]}' end"


def subset(values: list[str], weights: list[float], size: str, tag: str, *keys: str, seed: int = SEED) -> str:
    rows = ", ".join(
        "{'k': -ln(" + u(f"{tag}{i}", *keys, seed=seed) + f" + {2.0**-53!r}::DOUBLE) / {float(w)!r}::DOUBLE, 'v': '{v}'" + "}"
        for i, (v, w) in enumerate(zip(values, weights)))
    return f"list_transform(list_sort([{rows}])[1:({size})], lambda s: s.v)"


def broken(s: str, tag: str, *keys: str, seed: int = SEED) -> str:
    branch, at, extra = (u(f"{tag}.{t}", *keys, seed=seed) for t in ("branch", "at", "extra"))
    n = f"length({s})"
    cut = f"least({n} - 1, 1 + floor(-ln(1.0::DOUBLE - {at} * (1.0::DOUBLE - pow(4.0::DOUBLE, 1 - {n}))) / {log(4)!r}::DOUBLE)::BIGINT)"
    i = uint(1, f"{n} - 1", at)
    blank = f"left({s}, {i}) || ' ' || substr({s}, {i} + 1)"
    j = below(n, at)
    lost = f"left({s}, {j}) || substr({s}, {j} + 2)"
    k = below(f"{n} + 1", at)
    digit = f"left({s}, {k}) || {below(10, extra)}::VARCHAR || substr({s}, {k} + 1)"
    m = below(f"{n} - 1", at)
    swap = f"left({s}, {m}) || substr({s}, {m} + 2, 1) || substr({s}, {m} + 1, 1) || substr({s}, {m} + 3)"
    ends = f"case when {extra} < 0.5::DOUBLE then left({s}, {n} - {cut}) else substr({s}, {cut} + 1) end"
    return (f"case when {branch} < 0.2::DOUBLE then (case when {n} >= 2 then {blank} else {s} end) "
            f"when {branch} < 0.4::DOUBLE then (case when {n} >= 5 then {lost} else {s} end) "
            f"when {branch} < 0.6::DOUBLE then {digit} "
            f"when {branch} < 0.8::DOUBLE then (case when {n} >= 2 then {swap} else {s} end) "
            f"else (case when {n} >= 5 then {ends} else {s} end) end")


def skip(r: str, taken: str) -> str:
    return f"list_reduce(list_sort({taken}), lambda a, x: case when a >= x then a + 1 else a end, {r})"


FX = ("(case {} when 'USD' then 1 when 'EUR' then 0.9076 when 'JPY' then 142.4026 when 'GBP' then 0.7654 "
      "when 'CNY' then 7.1187 end)::DECIMAL(12,4)")


def deducted(amount: str, currency: str, share: str) -> str:
    less = (f"least((({amount}) * 0.1::DECIMAL(4,3))::DECIMAL(15,2), "
            f"({share} * 0.1::DOUBLE * {FX.format(currency)}::DOUBLE)::DECIMAL(15,2))")
    return f"(({amount}) - {less})::DECIMAL(15,2)"


def posted(day: str, days: str) -> str:
    return f"strftime({day} + to_days(({days})::INT), '%Y%m%d')"


# ---------------------------------------------------------------- shared tables

SCORED = f"""scored AS (
  SELECT l.doc_id, lang, source, quality = 1 AS truth, toxic = 0 AS prediction,
    list_filter([case when n_chars > 1000 then 'perturbed_billing_number' end,
                 case when lang <> 'en' then 'perturbed_business_partner' end,
                 case when source like 'src1%' then 'small_deduction' end], lambda x: x is not null) AS errors,
    case n_chars % 3 when 0 then 'one_pay_one_inv' when 1 then 'multi_pay_one_inv' else 'one_pay_multi_inv' end
      AS match_category,
    {MODELS}[l.doc_id % 3 + 1] AS model,
    case when {u('schema', 'l.doc_id')} < 0.5::DOUBLE then 'opaque' else 'multi-table' end AS schema_mode,
    case when {u('mode', 'l.doc_id')} < 0.3::DOUBLE then 'single' else 'multi' end AS perturbation_mode
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

RESPONSES = f"""resp AS (
  SELECT doc_id AS pair_id, {MODELS}[doc_id % 3 + 1] AS model,
    {u('failed', 'doc_id')} < 0.1::DOUBLE AS failed,
    {weighted(['Yes', 'No', 'no' + chr(9) + 'match', 'Yes and no', 'Maybe', 'yes it is'], [4, 4, 1, 1, 1, 1], u('answer', 'doc_id'))}
      AS answer,
    {weighted(['stop', 'length', 'content_filter'], [8, 1, 1], u('reason', 'doc_id'))} AS reason,
    ceil(n_chars / 4.0::DOUBLE)::BIGINT AS prompt, {uint(1, 20, u('out', 'doc_id'))} AS completion
  FROM documents),
answers AS (SELECT pair_id, model, failed, case when failed then null else answer end AS response_text,
    case when failed then null else reason end AS finish_reason, prompt, completion FROM resp)"""


def parsed(t: str) -> str:
    words = f"regexp_split_to_array(trim(lower({t}), ' '), '\\s+')"
    yes, no = f"list_contains({words}, 'yes')", f"list_contains({words}, 'no')"
    return f"(case when {yes} and not {no} then true when {no} and not {yes} then false end)"


GROUPS = """entries AS (
  SELECT model, schema_mode, perturbation_mode, truth, prediction, unnest(list_concat(
    [{'g': 'all', 'k': ''}, {'g': 'match_category', 'k': match_category},
     {'g': case when len(errors) = 0 then 'clean' else 'dirty' end, 'k': match_category}],
    list_transform(case when len(errors) = 0 then ['clean'] else errors end, lambda x: {'g': 'perturbation', 'k': x}))) AS e
  FROM scored),
results AS (SELECT model, schema_mode, perturbation_mode, e.g AS grouping, e.k AS key, """ + COUNTS + """
  FROM entries GROUP BY ALL)"""

INVOICES = f"""inv AS (
  SELECT o_orderkey AS invoice_id, '001' AS inv_client, (o_custkey % 9 + 1)::VARCHAR || '000' AS inv_company_code,
    year(o_orderdate)::INT AS inv_fiscal_year, '1' || lpad(o_orderkey::VARCHAR, 9, '0') AS inv_document_number,
    '00' || {uint(1, 9, u('item', 'o_orderkey', seed=BRIDGE_SEED))}::VARCHAR AS inv_line_item_number,
    'INV1' || lpad(o_orderkey::VARCHAR, 14, '0') AS inv_assignment_number,
    '9' || lpad((o_orderkey * 7)::VARCHAR, 9, '0') AS inv_billing_number,
    'CUS' || lpad(o_custkey::VARCHAR, 7, '0') AS inv_customer_id, left(c_name, 35) AS inv_customer_name,
    ['USD', 'EUR', 'JPY', 'GBP', 'CNY'][c_nationkey % 5 + 1] AS inv_currency_code,
    upper(left(replace(n_name, 'NATION_', 'N'), 3)) AS inv_country_key, o_totalprice::DECIMAL(15,2) AS inv_amount,
    strftime(o_orderdate, '%Y%m%d') AS inv_document_date,
    {posted('o_orderdate', 'floor(' + beta(2, 5, 'due', 'o_orderkey', seed=BRIDGE_SEED) + ' * 60)')} AS inv_due_date,
    lpad({uint(1, 30, u('terms', 'o_custkey', seed=BRIDGE_SEED))}::VARCHAR, 4, '0') AS inv_terms_of_payment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

ADVICE = u("advice", "o_custkey", "year(o_orderdate)", seed=BRIDGE_SEED) + " < 0.2::DOUBLE"
MEMBERS = f"""paid AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders WHERE {ADVICE}),
im AS (
  SELECT min(o_orderkey) OVER (PARTITION BY o_custkey, y) AS match_id, o_orderkey AS invoice_id, true AS by_advice FROM paid
  UNION ALL SELECT o_orderkey, o_orderkey, false FROM orders
  WHERE NOT ({ADVICE}) AND o_orderkey IN (SELECT l_orderkey FROM lineitem)),
pm AS (SELECT *, row_number() OVER (ORDER BY match_id, line) - 1 AS payment_id FROM (
  SELECT match_id, l_linenumber AS line, sum(l_extendedprice::DECIMAL(15,2)) AS weight
  FROM lineitem JOIN im ON l_orderkey = match_id WHERE NOT by_advice GROUP BY match_id, l_linenumber
  UNION ALL SELECT DISTINCT match_id, 0, 1 FROM im WHERE by_advice)),
paid_n AS (SELECT match_id, count(*) AS n_payments FROM pm GROUP BY match_id)"""

INFO = f"""facts AS (
  SELECT match_id, count(*) AS n_invoices, sum(inv_amount)::DECIMAL(15,2) AS total_amount,
    max(inv_document_date) AS last_document_date, min(inv_customer_id) AS inv_customer_id,
    min(inv_customer_name) AS inv_customer_name, min(inv_currency_code) AS inv_currency_code,
    min(inv_country_key) AS inv_country_key, min(inv_billing_number) AS inv_billing_number,
    min(inv_assignment_number) AS inv_assignment_number
  FROM im JOIN inv USING (invoice_id) GROUP BY match_id),
info AS (
  SELECT *, case when n_invoices > 1 then 'one_pay_multi_inv' when n_payments > 1 then 'multi_pay_one_inv'
      else 'one_pay_one_inv' end AS match_category,
    case when {u('dirty', 'match_id', seed=BRIDGE_SEED)} < 0.75::DOUBLE then list_sort({subset(
        ERRORS, [1, 1, 1, 1], uint(1, 4, u('n_errors', 'match_id', seed=BRIDGE_SEED)), 'errors', 'match_id',
        seed=BRIDGE_SEED)}) else []::VARCHAR[] end AS errors
  FROM facts JOIN paid_n USING (match_id))"""

_W = u("which", "payment_id", seed=BRIDGE_SEED)
_B = ("case when list_contains(errors, 'perturbed_billing_number') then "
      + broken("inv_billing_number", "bill", "payment_id", seed=BRIDGE_SEED) + " else inv_billing_number end")
_A = ("case when list_contains(errors, 'perturbed_assignment_number') then "
      + broken("inv_assignment_number", "assign", "payment_id", seed=BRIDGE_SEED) + " else inv_assignment_number end")
PAYMENTS = f"""cents AS (
  SELECT pm.*, info.* EXCLUDE (match_id), floor((total_amount * 100)::BIGINT::DOUBLE * weight::DOUBLE
      / (sum(weight) OVER (PARTITION BY pm.match_id))::DOUBLE)::BIGINT AS c,
    payment_id = max(payment_id) OVER (PARTITION BY pm.match_id) AS is_last
  FROM pm JOIN info ON pm.match_id = info.match_id),
split AS (
  SELECT *, ((case when is_last then (total_amount * 100)::BIGINT - coalesce(sum(c) FILTER (WHERE NOT is_last)
      OVER (PARTITION BY match_id), 0) else c end)::DECIMAL(18,0) / 100)::DECIMAL(15,2) AS part_amount FROM cents),
ids AS (SELECT *, {_W} AS w, {_B} AS b, {_A} AS a FROM split),
pay AS (
  SELECT payment_id,
    case when list_contains(errors, 'perturbed_business_partner')
      then upper(replace(inv_customer_name, 'Customer#0000', 'CUST ')) else inv_customer_name end AS pay_business_partner,
    inv_country_key || lpad(substr(inv_customer_id, 4, 7), 18, '7') AS pay_account_number,
    {weighted(['PAY ', 'RECEIPT ', ''], [1, 1, 1], u('prefix', 'inv_customer_id', seed=BRIDGE_SEED))} ||
      case when w < 0.4::DOUBLE then b when w < 0.8::DOUBLE then a else b || ' ' || a end AS pay_memo_line,
    case when list_contains(errors, 'small_deduction') then {deducted(
        'part_amount', 'inv_currency_code', beta(3, 5, 'less', 'payment_id', seed=BRIDGE_SEED))}
      else part_amount end AS pay_amount, inv_currency_code AS pay_currency,
    {posted("strptime(last_document_date, '%Y%m%d')", 'floor(' + beta(2, 5, 'posted', 'payment_id', seed=BRIDGE_SEED) + ' * 60)')}
      AS pay_posting_date
  FROM ids)"""

PAIRS = f"""ii AS (SELECT match_id, o_orderkey AS invoice_id, row_number() OVER (ORDER BY match_id IS NULL, match_id, o_orderkey) - 1 AS x
  FROM orders LEFT JOIN im ON invoice_id = o_orderkey),
pi AS (SELECT match_id, payment_id, row_number() OVER (ORDER BY match_id, payment_id) - 1 AS x FROM pm),
ir AS (SELECT match_id, min(x) AS i0, count(*) AS i_n FROM ii GROUP BY match_id),
pr AS (SELECT match_id, min(x) AS p0, count(*) AS p_n FROM pi GROUP BY match_id),
mm AS (
  SELECT match_id, match_category, array_to_string(errors, ',') AS perturbation_categories, errors, i0, i_n, p0, p_n,
    i_n + i_n * p_n + p_n AS pairs,
    sum(i_n + i_n * p_n + p_n) OVER (ORDER BY match_id) - (i_n + i_n * p_n + p_n) AS pair_offset
  FROM info JOIN ir USING (match_id) JOIN pr USING (match_id)),
di AS (
  SELECT ii.match_id, ii.invoice_id, ii.x - i0 AS i, {below('(SELECT count(*) FROM pi) - p_n', u('neg_inv', 'ii.invoice_id'))} AS r
  FROM ii JOIN mm USING (match_id)),
dp AS (
  SELECT pi.match_id, pi.payment_id, pi.x - p0 AS p, {below('(SELECT count(*) FROM ii) - i_n', u('neg_pay', 'pi.payment_id'))} AS r
  FROM pi JOIN mm USING (match_id)),
pairs AS (
  SELECT pair_offset + i * (1 + p_n) + 1 + (pi.x - p0) AS pair_id, mm.match_id AS match_id, mm.match_id AS drawn_for,
    true AS rows_match, 'match' AS kind, match_category, perturbation_categories, errors, invoice_id, payment_id
  FROM di JOIN mm USING (match_id) JOIN pi USING (match_id)
  UNION ALL
  SELECT pair_offset + i * (1 + p_n), NULL, mm.match_id, false, 'invoice_driven', match_category,
    perturbation_categories, errors, invoice_id, pi.payment_id
  FROM di JOIN mm USING (match_id) JOIN pi ON pi.x = case when r < p0 then r else r + p_n end
  UNION ALL
  SELECT pair_offset + i_n * (1 + p_n) + p, NULL, mm.match_id, false, 'payment_driven', match_category,
    perturbation_categories, errors, ii.invoice_id, payment_id
  FROM dp JOIN mm USING (match_id) JOIN ii ON ii.x = case when r < i0 then r else r + i_n end)"""
MATCHES = f"{INVOICES}, {MEMBERS}, {INFO}"
ALL_PAIRS = f"{MATCHES}, {PAIRS}"
PAIR_COLUMNS = "drawn_for, rows_match, kind, match_category, perturbation_categories, invoice_id, payment_id"
ROWS = f"{MATCHES}, {PAYMENTS}, {PAIRS}, rows AS (SELECT * FROM pairs JOIN inv USING (invoice_id) JOIN pay USING (payment_id))"

_WORDS = "string_split(pay_memo_line, ' ')"
RULES = {
    "billing": "contains(pay_memo_line, inv_billing_number)",
    "assignment": "contains(pay_memo_line, inv_assignment_number)",
    "near_id": f"len(list_filter({_WORDS}, lambda w: levenshtein(w, inv_billing_number) <= 1 "
               "or levenshtein(w, inv_assignment_number) <= 1)) > 0",
    "amount": "abs(inv_amount - pay_amount) <= 0.20",
    "partner": "levenshtein(lower(inv_customer_name), lower(pay_business_partner)) <= "
               "greatest(length(inv_customer_name), length(pay_business_partner)) * 0.4::DOUBLE",
    "dates": "pay_posting_date >= inv_document_date",
}
POINTS = {"billing": 50, "assignment": 50, "near_id": 40, "amount": 30, "partner": 30, "dates": 10}
SCORE = " + ".join(f"case when {n} then {w} else 0 end" for n, w in POINTS.items())
RULED = (f"{ROWS}, ruled AS (SELECT *, {', '.join(f'{c} AS {n}' for n, c in RULES.items())} FROM rows), "
         f"decided AS (SELECT *, rows_match AS truth, {SCORE} >= 55 AS prediction FROM ruled)")


def cell(c: str) -> str:
    s = f"coalesce(({c})::VARCHAR, '')"
    return f"""(case when regexp_matches({s}, '[",\\n\\r]') then '"' || replace({s}, '"', '""') || '"' else {s} end)"""


def csv_line(*columns: str) -> str:
    return " || ',' || ".join(cell(c) for c in columns) + " || chr(10)"


_INV_SHOWN = ["client", "company_code", "fiscal_year", "document_number", "line_item_number", "assignment_number",
              "billing_number", "customer_id", "customer_name", "currency_code", "country_key", "amount",
              "document_date", "due_date", "terms_of_payment"]
_PAY_SHOWN = ["business_partner", "account_number", "memo_line", "amount", "currency", "posting_date"]
OPAQUE = dict(zip(_INV_SHOWN, ["MANDT", "BURKS", "GJAHR", "BELNR", "BZUEI", "ZUONR", "VBELN", "KUNNR", "NAME1", "WAERS",
                               "LAND1", "WRBTR", "BLDAT", "ZFBDT", "ZTERM"]))
DESCRIPTIVE = dict(zip(_INV_SHOWN, ["Client", "Company Code", "Fiscal Year", "Document Number", "Line Item Number",
                                    "Assignment Number", "Billing Number", "Customer ID", "Customer Name",
                                    "Currency Code", "Country Key", "Amount", "Document Date", "Due Date",
                                    "Terms of Payment"]))
PAY_OPAQUE = dict(zip(_PAY_SHOWN, ["PARTN", "AVKON", "SGTXT", "KWBTR", "KWAER", "BVDAT"]))


def view(names: dict[str, str]) -> str:
    hidden = ("country_key", "terms_of_payment")
    return ", ".join(f'inv_{a} AS "{n}"' for a, n in names.items() if a not in hidden)


def spread(id_: str, n: str, chunk: int) -> str:
    return (f"(case when {n} <= {chunk} then 0 else ('0x'||substr(md5({id_}::VARCHAR), 1, 13))::BIGINT "
            f"% ceil({n} / {chunk}.0::DOUBLE)::BIGINT end)::INT")


def normalised(source: str, id_: str, key: list[tuple[str, str]], rest: list[tuple[str, str]], chunk: int = 20) -> str:
    ks = ", ".join(c for c, _ in key)
    outer = "".join(f', f."{n}"' for _, n in rest)
    picked = ", ".join(f'{c} AS "{n}"' for c, n in key)
    on = " AND ".join(f'l."{n}" IS NOT DISTINCT FROM f."{n}"' for _, n in key)
    return f"""numbered AS (SELECT *, count(*) OVER (PARTITION BY {ks}) AS k_n, row_number() OVER (PARTITION BY {ks} ORDER BY {id_}) AS k_rank FROM {source}),
  lists AS (SELECT {picked}, {spread(id_, 'k_n', chunk)} AS part, array_to_string(list_sort(list({id_})), ',') AS {id_} FROM numbered GROUP BY {ks}, part),
  firsts AS (SELECT {picked}{''.join(f', {c} AS "{n}"' for c, n in rest)}, k_n AS n_ids FROM numbered WHERE k_rank = 1)
  SELECT l.*{outer}, f.n_ids FROM lists l JOIN firsts f ON {on}"""


def member(names: dict[str, str], prefix: str, cols: list[str]) -> list[tuple[str, str]]:
    return [(f"{prefix}_{c}", names[c]) for c in cols]


_KEY = ["client", "company_code", "fiscal_year", "document_number"]

# ---------------------------------------------------------------- requests

FEW = f"""texts AS (
  SELECT l.doc_id AS pair_id, quality = 1 AS rows_match,
    'lang,source,n_chars' || chr(10) || {csv_line('lang', 'source', 'n_chars')} AS a,
    'text' || chr(10) || {csv_line('text')} AS b
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
def named_row(side: str, columns: list[str], names: dict[str, str]) -> str:
    """SQL text of a row under the given column names."""
    return f"'{','.join(names[c] for c in columns)}' || chr(10) || " + csv_line(*[f"{side}_{c}" for c in columns])


def pair_texts(source: str, target: str) -> str:
    return f"texts AS (SELECT pair_id, rows_match, {source} AS a, {target} AS b FROM rows)"


PAIR_TEXTS = pair_texts(named_row("inv", _INV_SHOWN, {c: "inv_" + c for c in _INV_SHOWN}), named_row("pay", _PAY_SHOWN, {c: "pay_" + c for c in _PAY_SHOWN}))
PAY_DESCRIPTIVE = dict(zip(_PAY_SHOWN, ["Business Partner", "Account Number", "Memo Line", "Amount", "Currency", "Posting Date"]))
_IN_VIEW = [c for c in _INV_SHOWN if c not in ("country_key", "terms_of_payment")]
MEMBERS = (_KEY + ["currency_code", "document_date"],
           _KEY + ["line_item_number", "assignment_number", "billing_number", "customer_id", "amount", "due_date", "terms_of_payment"],
           ["client", "customer_id", "customer_name"])
VIEW_TEXTS = {
    "descriptive": pair_texts(named_row("inv", _IN_VIEW, DESCRIPTIVE), named_row("pay", _PAY_SHOWN, PAY_DESCRIPTIVE)),
    "opaque": pair_texts(named_row("inv", _IN_VIEW, OPAQUE), named_row("pay", _PAY_SHOWN, PAY_OPAQUE)),
    "multi_table": pair_texts(" || '   ' || ".join(named_row("inv", list(m), OPAQUE) for m in MEMBERS), named_row("pay", _PAY_SHOWN, PAY_OPAQUE)),
}


def few_shot(k: int) -> str:
    """Draws of k + k examples as steps: each step adds one number that is not taken yet."""
    steps, prev = [], "start_"
    for label in (0, 1):
        n = f"n{label}"
        for i in range(1, k + 1):
            r = below(f"{n} - len(t{label})", u(f"example{label}", i, "pair_id"))
            steps.append(f"s{label}{i} AS (SELECT * EXCLUDE (t{label}), list_append(t{label}, {skip(r, f't{label}')}) AS t{label} FROM {prev})")
            prev = f"s{label}{i}"
    own = lambda b, e: f"case when {b} then [{e}] else []::BIGINT[] end"
    return f"""pool AS (SELECT *, row_number() OVER (ORDER BY rows_match, pair_id) - 1 AS x FROM texts),
start_ AS (SELECT *, {own('NOT rows_match', 'x')} AS t0, {own('rows_match', 'x - n0')} AS t1 FROM pool,
  (SELECT count(*) FILTER (WHERE NOT rows_match) AS n0, count(*) FILTER (WHERE rows_match) AS n1 FROM texts)),
{', '.join(steps)},
drawn AS (SELECT pair_id, unnest(range(0, {2 * k})) AS i, unnest(list_concat(
    t0[len(t0) - {k - 1}:], list_transform(t1[len(t1) - {k - 1}:], lambda v: v + n0))) AS x FROM {prev}),
shots AS (
  SELECT d.pair_id, string_agg('user> First entry: ' || p.a || ' Second entry: ' || p.b || chr(10) || 'assistant> '
      || case when p.rows_match then 'Yes' else 'No' end, chr(10) ORDER BY {u('order', 'd.i', 'd.pair_id')}, d.x) AS shown
  FROM drawn d JOIN pool p ON d.x = p.x GROUP BY d.pair_id),
chats AS (SELECT t.pair_id, 'user> Do the two table entries refer to the same real-world entity?' || chr(10)
    || 'Answer with "Yes" if they do and with "No" if they do not.' || chr(10) || shown || chr(10)
    || 'user> First entry: ' || a || ' Second entry: ' || b AS chat, rows_match
  FROM texts t JOIN shots USING (pair_id))"""


CHATS = f"""chat_turns AS (
  SELECT conv_id, '[' || string_agg('{{"role":' || to_json(role)::VARCHAR || ',"content":' || to_json(text)::VARCHAR || '}}', ','
      ORDER BY turn, role, text) || ']' AS messages, count(*) AS size,
    sum(ceil(length(text) / 4.0::DOUBLE)::BIGINT + 5)::BIGINT AS input_tokens
  FROM conversations GROUP BY conv_id),
chats AS (
  SELECT *, list_append({MODELS}, 'small-context-model')[conv_id % 4 + 1] AS model,
    case conv_id % 3 when 1 then 100 when 2 then 20000 end AS max_tokens,
    case when conv_id % 7 = 3 then '0.7' else '0.0' end AS temperature,
    case when conv_id % 4 = 0 then 2 end AS n, case when conv_id % 8 = 0 then 3 end AS best_of,
    case when conv_id % 6 = 1 then 50 end AS completion,
    case when conv_id % 5 <> 0 then 20231 end AS seed FROM chat_turns),
reqs AS (
  SELECT *, '{{"model":"' || model || '","max_tokens":' || coalesce(max_tokens::VARCHAR, 'null')
      || ',"temperature":' || temperature || ',"messages":' || messages || ',"seed":' || coalesce(seed::VARCHAR, 'null')
      || ',"n":' || coalesce(n::VARCHAR, 'null') || ',"best_of":' || coalesce(best_of::VARCHAR, 'null')
      || ',"max_completion_tokens":' || coalesce(completion::VARCHAR, 'null') || '}}' AS body
  FROM chats),
hashed AS (SELECT *, sha256(body) AS hash FROM reqs),
cache AS (SELECT hash, body || case when conv_id % 7 = 0 then ' ' else '' end AS request FROM hashed
  WHERE {u('cached', 'conv_id')} < 0.5::DOUBLE),
prices AS (SELECT * FROM (VALUES ('gpt-3.5-turbo-1106', 0.0010::DOUBLE, 0.0020::DOUBLE, 16385, 4096),
  ('gpt-4o-2024-08-06', 0.00250::DOUBLE, 0.01000::DOUBLE, 128000, 16384),
  ('gpt-4o-mini-2024-07-18', 0.000150::DOUBLE, 0.000600::DOUBLE, 128000, 16384),
  ('small-context-model', 0.0005::DOUBLE, 0.001::DOUBLE, 64, 32)) AS t(model, pin, pout, ctx, most)),
audit AS (
  SELECT h.*, c.hash IS NOT NULL AS cached, ctx, most, coalesce(completion, max_tokens) AS lim,
    coalesce(best_of, n, 1) * input_tokens AS max_input_usage,
    coalesce(best_of, n, 1) * coalesce(completion, max_tokens, least(most, greatest(0, ctx - input_tokens)))::BIGINT AS max_output_usage, pin, pout
  FROM hashed h LEFT JOIN cache c ON h.hash = c.hash AND h.body = c.request JOIN prices p ON h.model = p.model),
audited AS (
  SELECT *, array_to_string(list_filter([
      case when input_tokens > ctx then 'input_exceeds_context' end,
      case when completion IS NOT NULL AND max_tokens IS NOT NULL then 'two_output_limits' end,
      case when lim > most then 'limit_exceeds_model' end,
      case when input_tokens + lim > ctx then 'total_exceeds_context' end,
      case when seed IS NULL then 'no_seed' end,
      case when temperature <> '0.0' then 'temperature_not_zero' end], lambda x: x is not null), ',') AS issues,
    max_input_usage * pin / 1000.0::DOUBLE + max_output_usage * pout / 1000.0::DOUBLE AS max_cost FROM audit)"""


def markdown(columns: list[tuple[str, str, bool]]) -> str:
    top, rule, line = [], [], []
    for title, c, number in columns:
        s = f"coalesce(({c})::VARCHAR, '')"
        w = f"greatest(length({s}), {len(title) + 2})::INT"
        pad = "lpad" if number else "rpad"
        top.append(f"{pad}('{title}', {w}, ' ')")
        line.append(f"{pad}({s}, {w}, ' ')")
        rule.append(f"repeat('-', {w} + 1) || ':'" if number else f"':' || repeat('-', {w} + 1)")
    return ("'| ' || " + " || ' | ' || ".join(top) + " || ' |' || chr(10) || '|' || " + " || '|' || ".join(rule)
            + " || '|' || chr(10) || '| ' || " + " || ' | ' || ".join(line) + " || ' |'")


# ---------------------------------------------------------------- catalogue

def _sampled() -> str:
    steps, prev = [], "s0"
    for i in range(1, 6):
        r = below("97 - len(t)", u("sample", i, "o_orderkey"))
        steps.append(f"s{i} AS (SELECT o_orderkey, list_append(t, {skip(r, 't')}) AS t FROM {prev})")
        prev = f"s{i}"
    return (f"WITH s0 AS (SELECT o_orderkey, [o_orderkey % 97] AS t FROM orders), {', '.join(steps)} "
            f"SELECT o_orderkey, array_to_string(t[2:], ',') AS drawn FROM {prev}")


#: Standard error of F1 by the delta method.
CLOSED_SE = ('CASE WHEN 2*"TP" + "FP" + "FN" = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * sqrt("TP"::DOUBLE * ("FP" + "FN")::DOUBLE * ("TP"::DOUBLE + ("FP" + "FN")::DOUBLE)) '
             '/ ((2*"TP" + "FP" + "FN")::DOUBLE * (2*"TP" + "FP" + "FN")::DOUBLE) END')


def _gamma(shape: str, tag: str, *keys: str) -> str:
    """A gamma draw: the first accepted of three candidates, else the mean."""
    d = f"({shape}::DOUBLE - {1.0 / 3.0!r}::DOUBLE)"
    tries = []
    for t in range(3):
        z = f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u(f'{tag}.{t}a', *keys)})) * cos({2 * pi!r}::DOUBLE * {u(f'{tag}.{t}b', *keys)}))"
        w = f"(1.0::DOUBLE + {z} / sqrt(9.0::DOUBLE * {d}))"
        v = f"({w} * {w} * {w})"
        tries.append(f"case when {w} > 0 then case when ln(1.0::DOUBLE - {u(f'{tag}.{t}c', *keys)}) < 0.5::DOUBLE * {z} * {z} + {d} - {d} * {v} "
                     f"+ {d} * ln(greatest({v}, 1e-300::DOUBLE)) then {d} * {v} end end")
    return f"coalesce({', '.join(tries)}, {d})"


def _binomial(name: str, source: str, n: str, p: str, tag: str, *keys: str) -> str:
    """CTEs ending in ``name`` (source's columns, drawn): a binomial draw per row of ``source``, which has the key columns."""
    ks = ", ".join(keys)
    g, h = _gamma("i", tag + ".g", "level", *keys), _gamma("(n + 1 - i)", tag + ".h", "level", *keys)
    return f"""{name}_r(level, {ks}, n, p, x) AS (
  SELECT 0, {ks}, ({n})::BIGINT, ({p})::DOUBLE, 0::BIGINT FROM {source}
  UNION ALL
  SELECT level + 1, {ks}, case when y <= p then n - i else i - 1 end, case when y <= p then (p - y) / (1.0::DOUBLE - y) else p / y end, case when y <= p then x + i else x end
  FROM (SELECT *, g / (g + h) AS y FROM (SELECT *, {g} AS g, {h} AS h FROM (SELECT *, (n + 1) // 2 AS i FROM {name}_r WHERE n > 16 AND p > 0 AND p < 1)))),
{name}_l AS (SELECT {ks}, arg_max(n, level) AS n, arg_max(p, level) AS p, arg_max(x, level) AS x FROM {name}_r GROUP BY {ks}),
{name} AS (SELECT s.*, x + case when p <= 0 then 0 when p >= 1 then l.n
    else len(list_filter(range(1, 17), lambda k: k <= l.n and {u(tag + '.u', 'k', *keys)} < p)) end AS drawn
  FROM {source} s JOIN {name}_l l USING ({ks}))"""


def bootstrapped(counts: str, keys: list[str], rounds: int) -> str:
    """CTEs ending in ``errors`` (keys, se): the bootstrap error of F1 over the counts per group."""
    key = " || '|' || ".join(f"coalesce({k}::VARCHAR, '')" for k in keys) + " || '|'"
    a = _binomial("tp", "rounds_", "n", '"TP" / n', "boot.TP", "round_", "key_")
    b = _binomial("fp", "tp2", "n - d1", 'case when n - "TP" > 0 then "FP" / (n - "TP") else 0 end', "boot.FP", "round_", "key_")
    c = _binomial("tn", "fp2", "n - d1 - d2", 'case when n - "TP" - "FP" > 0 then "TN" / (n - "TP" - "FP") else 0 end', "boot.TN", "round_", "key_")
    f = "case when 2 * d1 + d2 + d4 = 0 then 0.0::DOUBLE else (2 * d1)::DOUBLE / (2 * d1 + d2 + d4) end"
    return f"""rounds_ AS (SELECT *, {key} AS key_, unnest(range(1, {rounds + 1})) AS round_ FROM (SELECT *, "TP" + "FP" + "TN" + "FN" AS n FROM {counts}) WHERE n > 0),
{a}, tp2 AS (SELECT * EXCLUDE (drawn), drawn AS d1 FROM tp), {b}, fp2 AS (SELECT * EXCLUDE (drawn), drawn AS d2 FROM fp), {c},
errors AS (SELECT {', '.join(keys)}, stddev_samp({f}) AS se FROM (SELECT *, n - d1 - d2 - drawn AS d4 FROM tn) GROUP BY {', '.join(keys)})"""


def _difficulty_cells() -> str:
    cells = [("initial data", "schema_mode = 'opaque' AND grouping = 'clean' AND key = 'one_pay_one_inv'"),
             ("+ errors", "schema_mode = 'opaque' AND grouping = 'dirty' AND key = 'one_pay_one_inv'"),
             ("+ multi-matches", "schema_mode = 'opaque' AND grouping = 'dirty' AND key <> 'one_pay_one_inv'"),
             ("+ multiple tables", "schema_mode = 'multi-table' AND grouping = 'dirty' AND key <> 'one_pay_one_inv'")]
    each = " UNION ALL ".join(f"SELECT model, '{n}' AS scenario, {SUMS} FROM results WHERE perturbation_mode = 'multi' AND {w} GROUP BY model" for n, w in cells)
    text = "printf('%.2f ± %.2f', round(f::DECIMAL(20,12), 2)::DOUBLE, round(se::DECIMAL(20,12), 2)::DOUBLE)"
    wide = ", ".join(f"max(CASE WHEN scenario = '{n}' THEN {text} END) AS \"{n}\"" for n, _ in cells)
    return (f"WITH RECURSIVE {SCORED}, {GROUPS}, c AS ({each}), {bootstrapped('c', ['model', 'scenario'], 1000)}, "
            f"s AS (SELECT model, scenario, {F1} AS f, se FROM c JOIN errors USING (model, scenario)) "
            f"SELECT model, {wide} FROM s GROUP BY model")


def _difficulty() -> str:
    cells = [("initial_data", "schema_mode = 'opaque' and grouping = 'clean' and key = 'one_pay_one_inv'"),
             ("errors", "schema_mode = 'opaque' and grouping = 'dirty' and key = 'one_pay_one_inv'"),
             ("multi_matches", "schema_mode = 'opaque' and grouping = 'dirty' and key <> 'one_pay_one_inv'"),
             ("multiple_tables", "schema_mode = 'multi-table' and grouping = 'dirty' and key <> 'one_pay_one_inv'")]
    out = []
    for name, w in cells:
        c = {k: f'sum("{k}") filter (where {w})' for k in ("TP", "FP", "FN")}
        f = (f"case when 2*{c['TP']} + {c['FP']} + {c['FN']} = 0 then 0 "
             f"else (2*{c['TP']})::DOUBLE / (2*{c['TP']} + {c['FP']} + {c['FN']}) end")
        out.append(dec(f, name))
    return (f"WITH {SCORED}, {GROUPS} SELECT model, {', '.join(out)} FROM results "
            "WHERE perturbation_mode = 'multi' AND grouping IN ('clean', 'dirty') "
            "AND NOT (grouping = 'clean' AND (key <> 'one_pay_one_inv' OR schema_mode <> 'opaque')) "
            "AND NOT (schema_mode = 'multi-table' AND key = 'one_pay_one_inv') GROUP BY model")


def _error_report() -> str:
    f = F1.replace('"', "")
    cols = ", ".join(f"max(case when key = '{k}' then f end) AS {k}" for k in ["clean", *sorted(ERRORS)])
    return (f"WITH {SCORED}, {GROUPS}, s AS (SELECT model, key, {dec(F1, 'f')} FROM results WHERE schema_mode = 'opaque' "
            f"AND perturbation_mode = 'single' AND grouping = 'perturbation') SELECT model, {cols} FROM s GROUP BY model")


def _bootstrap() -> str:
    at = f"floor({u('boot', 'r', 's.doc_id')} * n)"
    return f"""WITH {SCORED}, c AS (SELECT lang, {COUNTS}, count(*) AS n FROM scored GROUP BY lang),
d AS (SELECT s.lang, r, {at} AS spot, "TP" AS a, "TP" + "FP" AS b, "TP" + "FP" + "TN" AS e
  FROM scored s JOIN c USING (lang), range(1, 51) AS t(r)),
k AS (SELECT lang, r, count(*) filter (where spot < a) AS "TP", count(*) filter (where spot >= a and spot < b) AS "FP",
  count(*) filter (where spot >= e) AS "FN" FROM d GROUP BY lang, r)
SELECT lang, count(*) AS rounds, stddev_samp({F1})::DECIMAL(18,8) AS f1_se FROM k GROUP BY lang"""


def _name(s: str) -> str:
    d, lo, up = (f"{u(f'name.{t}', 'c_custkey')} < {p}::DOUBLE" for t, p in
                 (("suffix", 0.5), ("lower", 0.25), ("upper", 0.5)))
    cut = f"(case when {d} then regexp_replace({s}, '(Inc|and Sons|LLC|Group|PLC|Ltd)$', '') else {s} end)"
    return f"case when {lo} then lower({cut}) when {up} then upper({cut}) else {cut} end"


def _perturbed() -> str:
    chosen = subset([ERRORS[3], ERRORS[2], ERRORS[1]], [2, 1, 1], uint(1, 3, u("n_errors", "invoice_id")), "errors", "invoice_id")
    has = lambda e: f"list_contains(e, '{e}')"
    return f"""WITH {INVOICES}, p AS (SELECT *, case when {u('dirty', 'invoice_id')} < 0.75::DOUBLE then {chosen}
    else []::VARCHAR[] end AS e FROM inv)
SELECT invoice_id,
  case when {has(ERRORS[3])} then {broken('inv_assignment_number', ERRORS[3], 'invoice_id')} else inv_assignment_number end
    AS inv_assignment_number,
  case when {has(ERRORS[2])} then {broken('inv_billing_number', ERRORS[2], 'invoice_id')} else inv_billing_number end
    AS inv_billing_number,
  case when {has(ERRORS[1])} then upper(inv_customer_name) else inv_customer_name end AS inv_customer_name,
  array_to_string(list_sort(e), ',') AS perturbation_categories FROM p"""


def _unique() -> str:
    return f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
r AS (SELECT *, ((i::HUGEINT * {_step("n")} + {SEED}) % n)::BIGINT AS rank FROM o)
SELECT o_orderkey, rank, 1000000000 + rank + floor(-expm1_(n, rank) * 999999999)::BIGINT AS number FROM r""".replace(
        "-expm1_(n, rank)", "(1.0::DOUBLE - exp(ln(1.0::DOUBLE - rank::DOUBLE / n) / 100000.0::DOUBLE))")


def _plan(mode: str, many: bool = False) -> str:
    """Match plan of the generator with one match per order."""
    cats, w = ["one_pay_one_inv", "multi_pay_one_inv", "one_pay_multi_inv", "multi_pay_multi_inv"], [0.6, 0.2, 0.2, 0.25]
    if not many:
        cats, w = cats[:3], w[:3]
    if mode == "single":
        errors = "[" + weighted(ERRORS, [0.25] * 4, u("single.error", "m")) + "]"
    else:
        errors = subset(ERRORS, [0.25] * 4, uint(1, 4, u("multi.errors", "m")), "multi.error", "m")
    return f"""k AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS m, count(*) OVER () * 10 AS n FROM orders),
c AS (SELECT m, n, {weighted(cats, w, u(mode + '.category', 'm'))} AS cat,
  case when {u(mode + '.dirty', 'm')} < 0.75::DOUBLE then {errors} else []::VARCHAR[] end AS e FROM k),
s AS (SELECT *, case when cat like 'multi_pay%' then 2 + floor({beta(1, 5, mode + '.payments', 'm')} * 3)::BIGINT else 1 end AS np,
  case when cat like '%multi_inv' then 2 + floor({beta(2, 5, mode + '.invoices', 'm')} * 8)::BIGINT else 1 end AS ni FROM c),
b AS (SELECT *, (sum(np) OVER (ORDER BY m) - np)::BIGINT AS pb, (sum(ni) OVER (ORDER BY m) - ni)::BIGINT AS ib FROM s)"""


def _texts(values: Iterable[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def _step(n: str) -> str:
    """The multiplier of a permutation of n numbers: the first remainder between n/5 and 4n/5."""
    rest = [f"({p}::HUGEINT % {n})" for p in (2305843009213693951, 1000000000000037, 100000000000031, 10000000000037, 1000000000039)]
    return "(CASE " + " ".join(f"WHEN {r} * 5 BETWEEN {n} AND 4 * {n} THEN {r}" for r in rest) + f" ELSE {rest[-1]} END)"


def _permuted(i: str, n: str, shift: int) -> str:
    return f"((({i}) * {_step(n)}::BIGINT + {SEED + shift} % {n}) % {n})"


def _feistel(i: str, n: str, bits: str, tag: str, *keys: str) -> str:
    """Six rounds, walked until the number is below n. States are lists: left, right."""
    a, b = f"({bits} // 2)", f"({bits} - {bits} // 2)"
    cast = "".join(f", ({k})::VARCHAR" for k in keys)
    digest = f"('0x' || substr(md5(concat_ws('|', '{SEED}', '{tag}', r[1]::VARCHAR, s[2]::VARCHAR, ({n})::VARCHAR{cast})), 1, 13))::BIGINT"
    wide = f"(case when r[1] % 2 = 0 then {a} else {b} end)"
    rounds = (f"list_reduce([[v // pow(2, {b})::BIGINT, v % pow(2, {b})::BIGINT], [0], [1], [2], [3], [4], [5]], "
              f"lambda s, r: [s[2], xor(s[1], {digest}) % pow(2, {wide})::BIGINT])")
    pass_ = f"(list_transform([{rounds}], lambda e: e[1] * pow(2, {b})::BIGINT + e[2]))[1]"
    return f"list_reduce(list_prepend(({i})::BIGINT, range(0, 65)), lambda v, t: case when t = 0 or v >= ({n}) then {pass_} else v end)"


def _minus_expm1(y: str) -> str:
    """1 - exp(y), by its series where y is small."""
    return (f"(case when abs({y}) < 0.001::DOUBLE then -({y} + {y} * {y} / 2 + {y} * {y} * {y} / 6 + {y} * {y} * {y} * {y} / 24) "
            f"else 1.0::DOUBLE - exp({y}) end)")


def _unique_value(rank: str, n: str, digits: int) -> str:
    y = f"(ln(1.0::DOUBLE - ({rank})::DOUBLE / {n}) / {float(10 ** (digits - 5))!r}::DOUBLE)"
    return f"({10 ** (digits - 1)} + ({rank}) + floor({_minus_expm1(y)} * {float(10 ** (digits - 1) - 1)!r}::DOUBLE)::BIGINT)"


def _chars(alphabet: str, length: str | int, tag: str, *keys: str) -> str:
    at = below(len(alphabet), u(tag, "x", *keys))
    return f"array_to_string(list_transform(range(1, {length} + 1), lambda x: substr('{alphabet}', {at} + 1, 1)), '')"


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _generated(mode: str) -> str:
    """Customers, invoices and payments of the generator, seed 7, 50 customers."""
    def pick(values: Iterable[str], tag: str) -> str:
        values = list(values)
        return f"{_texts(values)}[{below(len(values), u(tag, 'c'))} + 1]"

    step = 26**3 * 10**7 // 50
    spot = f"({_permuted('c', '50', 1)} * {step} + {below(step, u('customer_id', 'c'))})"
    letter = lambda div: f"substr('{LETTERS}', ({spot} // {div}) % 26 + 1, 1)"
    tail = f"case when {u('tail', 'c')} < 0.5::DOUBLE then {pick(generate.MEMO_TAILS, 'tail_word')} else '' end"
    countries = " ".join(f"when '{k}' then {_texts(v)}[{below(len(v), u('country', 'c'))} + 1]"
                         for k, v in generate.COUNTRIES.items())
    part = lambda v, i: f"{_texts(v)}[{i} + 1]"
    first, second, form = (part(generate.NAME_FIRST, "c % 20"), part(generate.NAME_SECOND, "(c // 20) % 10"),
                           part(generate.NAME_FORM, "(c // 200) % 6"))
    rates = "(case cur " + " ".join(f"when '{k}' then {v}" for k, v in USD_TO_CURRENCY.items()) + " end)::DECIMAL(12,4)"
    companies, items = [f"{j}000" for j in range(1, 10)], [f"00{j}" for j in range(1, 10)]
    jan = "make_date(yr, 1, 1)"
    day = f"({jan} + {below(f'(make_date(yr + 1, 1, 1) - {jan})', u(mode + '.document', 'sn'))}::INT)"
    spread = 10**14 // 450
    company_no = "(cust * 9 + left(company, 1)::BIGINT - 1)"
    account = f"lpad(({_permuted(company_no, '450', 2)} * {spread} + {below(spread, u('account', 'cust', 'company'))})::VARCHAR, 14, '0')"
    n1 = uint(3, 15, u(mode + ".noise1_len", "pid"))
    y = "(ln(1.0::DOUBLE - nu) / pow(10.0::DOUBLE, n1 - 5))"
    noise_1 = f"(pow(10.0::DOUBLE, n1 - 1)::BIGINT + floor({_minus_expm1(y)} * (pow(10.0::DOUBLE, n1 - 1) - 1))::BIGINT)::VARCHAR"
    has = lambda x: f"list_contains(e, '{x}')"
    show = lambda t: f"{u(f'{mode}.{t}', 'pid')} < 0.2::DOUBLE"
    share = beta(3, 5, mode + ".deduction", "pid")
    less = f"least((amt * 0.1::DECIMAL(4,3))::DECIMAL(15,2), ({share} * 0.1::DOUBLE * {rates}::DOUBLE)::DECIMAL(15,2))"
    return f"""{_plan(mode)},
cust AS (
  SELECT c AS cust, {letter(26**2 * 10**7)} || {letter(26 * 10**7)} || {letter(10**7)} || lpad(({spot} % 10000000)::VARCHAR, 7, '0') AS cid,
    {first} || ' ' || {second} || ' ' || {form} AS cname, upper(left({first}, 3)) || '-' || upper(left({second}, 4)) AS stmt,
    {weighted(list(generate.CURRENCY_WEIGHTS), list(generate.CURRENCY_WEIGHTS.values()), u('currency', 'c'))} AS cur,
    {pick(generate.MEMO_PREFIXES, 'memo_prefix')} AS mp, {u('memo_order', 'c')} < 0.5::DOUBLE AS bf,
    {u('memo_noise', 'c')} < 0.2::DOUBLE AS mn, case when {u('memo_tail', 'c')} < 0.2::DOUBLE then {tail} || ' ' end AS mt,
    {pick(generate.ID_PREFIXES, 'id_prefix')} AS ip, {pick(generate.ID_SEPARATORS, 'id_separator')} AS isep
  FROM range(0, 50) AS t(c)),
cust2 AS (SELECT *, case cur {countries.replace('(c)::VARCHAR', '(cust)::VARCHAR')} end AS land FROM cust),
slots AS (
  SELECT b.*, {below(50, u(mode + '.customer', 'm'))} AS cust, {weighted(companies, [1.0 / 2**j for j in range(9)], u(mode + '.company', 'm'))}
    AS company, {uint(2000, 2024, u(mode + '.year', 'm'))} AS yr, unnest(range(0, ni)) AS slot FROM b),
numbered AS (SELECT s.*, c.* EXCLUDE (cust), m * 10 + slot AS sn FROM slots s JOIN cust2 c ON s.cust = c.cust),
ginv AS (
  SELECT *, ib + slot AS iid, {_unique_value(_permuted('sn', 'n', 5), 'n', 10)}::VARCHAR AS doc,
    {weighted(items, [1.0 / 10**j for j in range(9)], u(mode + '.item', 'sn'))} AS item,
    'INV' || {_unique_value(_permuted('sn', 'n', 3), 'n', 15)}::VARCHAR AS asg,
    (({beta(2, 10, mode + '.amount', 'sn')} * 1000000)::DECIMAL(24,6) * {rates})::DECIMAL(15,2) AS amount, {day} AS d0,
    lpad({uint(1, 30, u('terms', 'cust', 'company'))}::VARCHAR, 4, '0') AS terms FROM numbered),
ginv2 AS (
  SELECT *, strftime(case when month(d0) = 2 and day(d0) = 29 then d0 - 1 else d0 end, '%Y%m%d') AS d,
    case when {u(mode + '.billing_kind', 'sn')} < 0.2::DOUBLE then (5000000000 + {_permuted('sn', 'n', 4)} * (5000000000 // n)
      + floor({u(mode + '.billing', 'sn')} * (5000000000 // n))::BIGINT)::VARCHAR else right(asg, 10) end AS bill FROM ginv),
carried AS (
  SELECT m, any_value(cat) AS cat, any_value(e) AS e, any_value(np) AS np, any_value(pb) AS pb, any_value(cust) AS cust,
    any_value(company) AS company, any_value(cname) AS cname, any_value(stmt) AS stmt, any_value(cur) AS cur, any_value(land) AS land,
    any_value(mp) AS mp, any_value(bf) AS bf, any_value(mn) AS mn, any_value(mt) AS mt, any_value(ip) AS ip, any_value(isep) AS isep,
    sum(amount)::DECIMAL(15,2) AS total, max(d) AS last_d, list({{'s': slot, 'b': bill}} ORDER BY slot) AS ids,
    arg_min(bill, slot) AS b0, arg_min(asg, slot) AS a0 FROM ginv2 GROUP BY m),
parts AS (
  SELECT *, unnest(range(0, np)) AS j, list_transform(range(1, np + 1), lambda x: {u(mode + '.part', 'm', 'x')}) AS w,
    (total * 100)::BIGINT AS cents FROM carried),
floors AS (
  SELECT *, list_transform(w[1:np - 1], lambda x: floor(cents::DOUBLE * x / list_reduce(w, lambda p, q: p + q, 0.0::DOUBLE))::BIGINT) AS f
  FROM parts),
split AS (
  SELECT *, pb + j AS pid, ((case when j < np - 1 then f[j + 1] else cents - coalesce(list_sum(f), 0) end)::DECIMAL(18,0) / 100)::DECIMAL(15,2)
    AS amt FROM floors),
noisy AS (
  SELECT *, {n1} AS n1, {u(mode + '.noise1', 'pid')} AS nu, {has(ERRORS[2])} AS pb_, {has(ERRORS[3])} AS pa_,
    {has(ERRORS[2])} or {show('show_billing')} AS sb, {has(ERRORS[3])} or {show('show_assignment')} AS sa,
    {u(mode + '.show_one', 'pid')} < 0.5::DOUBLE AS byb FROM split),
shown AS (
  SELECT *, {noise_1} AS noise1,
    case when cat = 'one_pay_multi_inv' then substr(list_reduce(list_transform(ids, lambda x, k: isep || replace(ip, '{{{{idx}}}}', (k - 1)::VARCHAR) ||
        case when pb_ then {broken('x.b', mode + '.billing_of', 'pid', 'x.s')} else x.b end), lambda p, q: p || q), length(isep) + 1)
      when pb_ then {broken('b0', mode + '.billing', 'pid')} when sb or (not sb and not sa and byb) then b0 else '' end AS tb,
    case when cat = 'one_pay_multi_inv' then '' when pa_ then {broken('a0', mode + '.assignment', 'pid')}
      when sa or (not sb and not sa and not byb) then a0 else '' end AS ta FROM noisy),
gpay AS (
  SELECT pid AS payment_id, case when {has(ERRORS[1])} then stmt else cname end AS pay_business_partner,
    land || {_chars('0123456789', 2, 'account_check', 'cust', 'company')} || {_chars(LETTERS, 4, 'account_bank', 'cust', 'company')}
      || {account} AS pay_account_number,
    mp || case when bf then tb else ta end || ' ' || case when mn then noise1 || ' ' else '' end || case when bf then ta else tb end
      || case when mt is not null then mt || {_chars('abcdefghijklmnopqrstuvwxyz0123456789', uint(3, 15, u(mode + '.noise2_len', 'pid')), mode + '.noise2', 'pid')}
         else '' end AS pay_memo_line,
    case when {has(ERRORS[0])} then (amt - {less})::DECIMAL(15,2) else amt end AS pay_amount, cur AS pay_currency,
    {posted("strptime(last_d, '%Y%m%d')", 'floor(' + beta(2, 5, mode + '.posting', 'pid') + ' * 60)')} AS pay_posting_date
  FROM shown)"""


def _all_views(due: str) -> str:
    """Rows and digest sums of every view of both modes of the generated dataset."""
    def digest(columns: Iterable[str]) -> str:
        text = ", ".join(f"coalesce(({c})::VARCHAR, '')" for c in columns)
        return f"('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::BIGINT"

    out = []
    for mode in ("single", "multi"):
        inv = dict(zip(_INV_SHOWN, ["'001'", "company", "yr", "doc", "item", "asg", "bill", "cid", "cname", "cur", "land", "amount", "d", due.replace("single.due", f"{mode}.due"), "terms"]))
        matches = ["m", "cat", "array_to_string(list_sort(e), ',')", "array_to_string(range(ib, ib + ni), ',')", "array_to_string(range(pb, pb + np), ',')"]
        parts = [(s, t, f"SELECT {digest(c)} AS x FROM {f}") for s in ("descriptive", "opaque") for t, f, c in (
            ("invoices", "ginv2", ["iid", *[inv[c] for c in _IN_VIEW]]), ("payments", "gpay", ["payment_id", *[f"pay_{c}" for c in _PAY_SHOWN]]))]
        parts += [(s, "matches", f"SELECT {digest(matches)} AS x FROM b") for s in ("descriptive", "opaque", "multi-table")]
        heads = []
        for name, shown, key in (("BKPF", MEMBERS[0], _KEY), ("BSEG", MEMBERS[1], _KEY), ("KNA-1", [*MEMBERS[2], "country_key"], ["client", "customer_id"])):
            by = ", ".join(inv[c] for c in key)
            parts.append(("multi-table", f"invoices_{name}", f"SELECT {digest(['iid', *[inv[c] for c in shown], 'n_ids'])} AS x FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n_ids, "
                          f"row_number() OVER (PARTITION BY {by} ORDER BY iid) AS k_rank FROM ginv2) WHERE k_rank = 1"))
            heads.append(f"min(iid) OVER (PARTITION BY {by})")
        parts.append(("multi-table", "invoices_links", f"SELECT {digest(['iid', 'h0', 'h1', 'h2'])} AS x FROM (SELECT iid, {', '.join(f'{h} AS h{i}' for i, h in enumerate(heads))} FROM ginv2)"))
        pay = [f"pay_{c}" for c in _PAY_SHOWN]
        parts.append(("multi-table", "payments_FEBEP", f"SELECT {digest(['min(payment_id)', *pay, 'count(*)'])} AS x FROM gpay GROUP BY {', '.join(pay)}"))
        parts.append(("multi-table", "payments_links", f"SELECT {digest(['payment_id', 'h'])} AS x FROM (SELECT payment_id, min(payment_id) OVER (PARTITION BY {', '.join(pay)}) AS h FROM gpay)"))
        each = " UNION ALL ".join(f"SELECT '{mode}' AS perturbation_mode, '{s}' AS schema_mode, '{t}' AS table_name, count(*) AS rows, sum(x)::VARCHAR AS digest FROM ({q})" for s, t, q in parts)
        out.append(f"SELECT * FROM (WITH {_generated(mode)} {each})")
    return " UNION ALL ".join(out)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    s = f"WITH {SCORED} "
    cd = "case when len(errors) = 0 then 'clean' else 'dirty' end"
    q["confusion_total"] = f"{s}, c AS (SELECT {COUNTS} FROM scored) SELECT *, {SCORES} FROM c"
    q["confusion_by_lang"] = f"{s}, c AS (SELECT lang, {COUNTS} FROM scored GROUP BY lang) SELECT *, {SCORES} FROM c"
    q["confusion_by_two_keys"] = (f"{s} SELECT match_category, {cd} AS clean_or_dirty, {COUNTS} FROM scored "
                                  "GROUP BY match_category, clean_or_dirty")
    q["confusion_filtered"] = f"{s} SELECT match_category, {COUNTS} FROM scored WHERE len(errors) > 0 GROUP BY match_category"
    q["confusion_rollup"] = (f"{s} SELECT lang, match_category, {COUNTS}, (grouping(lang) + grouping(match_category))::INT AS level "
                             "FROM scored GROUP BY ROLLUP (lang, match_category)")
    q["merge_groups"] = f"{s} SELECT model, {COUNTS} FROM scored WHERE match_category <> 'one_pay_one_inv' GROUP BY model"
    q["confusion_by_label"] = (f"{s}, e AS (SELECT truth, prediction, unnest(case when len(errors) = 0 then ['clean'] else errors end) "
                               f"AS label FROM scored) SELECT label, {COUNTS} FROM e GROUP BY label")
    q["evaluation_tables"] = f"{s}, {GROUPS} SELECT * FROM results"
    q["score_responses"] = f"""WITH {RESPONSES}, p AS (
  SELECT pair_id, response_text, {parsed('response_text')} AS parsed, quality = 1 AS truth
  FROM answers JOIN labels ON pair_id = doc_id WHERE response_text IS NOT NULL)
SELECT *, coalesce(parsed, NOT truth) AS prediction FROM p"""
    stripped = "regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g')"
    q["score_responses_without_punctuation"] = (
        f"SELECT doc_id, {parsed('text')} AS parsed, {parsed(stripped)} AS parsed_stripped FROM documents")
    q["error_counts"] = f"""WITH {RESPONSES} SELECT model, count(*) filter (where response_text is null) AS api_request_failed,
  count(*) filter (where response_text is not null and {parsed('response_text')} is null) AS parse_yes_no_failed
FROM answers GROUP BY model"""
    q["finish_reasons"] = f"WITH {RESPONSES} SELECT finish_reason, count(*) AS n FROM answers GROUP BY finish_reason"
    q["failed_responses"] = f"WITH {RESPONSES} SELECT count(*) filter (where failed) AS failed FROM answers"
    q["bootstrap_f1_rows"] = _bootstrap()
    q["report_difficulty_scores"] = _difficulty()
    q["report_difficulty"] = _difficulty_cells()
    q["bootstrap_f1"] = (f'WITH {SCORED}, c AS (SELECT lang, {COUNTS} FROM scored GROUP BY lang) '
                         f'SELECT lang, "TP", "FP", "TN", "FN", ({CLOSED_SE})::DECIMAL(18,8) AS closed_form_se, true AS near FROM c')
    q["report_cells"] = """WITH s AS (SELECT o_orderpriority, sum(o_totalprice::DECIMAL(15,2))::DOUBLE / count(*) / 1e5::DOUBLE AS m,
  (max(o_totalprice::DECIMAL(15,2)) - min(o_totalprice::DECIMAL(15,2)))::DOUBLE / 1e6::DOUBLE AS se FROM orders GROUP BY 1)
SELECT o_orderpriority, printf('%.2f ± %.2f', m, se) AS cell FROM s"""
    q["report_precision_recall"] = (
        f"{s}, {GROUPS}, c AS (SELECT model, {SUMS} FROM results WHERE schema_mode = 'opaque' AND perturbation_mode = 'multi' "
        f"AND grouping = 'dirty' AND key <> 'one_pay_one_inv' GROUP BY model) "
        f"SELECT model, {dec(F1, 'f1_score')}, {dec(P, 'precision')}, {dec(R, 'recall')} FROM c")
    q["report_error_categories"] = _error_report()
    q["runs_from_names"] = (f"{s} SELECT doc_id, concat_ws('_', 'exp', model, schema_mode, perturbation_mode) AS name, model, "
                            "schema_mode, perturbation_mode FROM scored")
    by_set = GROUPS.replace("SELECT model,", "SELECT case when lang = 'en' then 'pay_to_inv' else 'other' end AS dataset, model,", 1).replace(
        "results AS (SELECT model,", "results AS (SELECT dataset, model,")
    q["runs_from_files"] = (f"{s}, {by_set} SELECT *, concat_ws('_', 'exp-1', model, schema_mode, perturbation_mode) AS run FROM results")
    q["report_of_dataset"] = (
        f"{s}, {by_set}, c AS (SELECT model, {SUMS} FROM results WHERE dataset = 'pay_to_inv' AND schema_mode = 'opaque' AND perturbation_mode = 'multi' "
        f"AND grouping = 'dirty' AND key <> 'one_pay_one_inv' GROUP BY model) "
        f"SELECT model, {dec(F1, 'f1_score')}, {dec(P, 'precision')}, {dec(R, 'recall')} FROM c")
    q["generated_many_to_many"] = (f"WITH {_plan('multi', True)} SELECT m AS match_id, ni AS invoices, np AS payments, true AS adds_up FROM b "
                                   "WHERE cat = 'multi_pay_multi_inv'")
    q["results_from_maps"] = (f"{s} SELECT model, 'match_category' AS grouping, match_category AS key, {COUNTS} FROM scored "
                              "GROUP BY model, match_category")
    q["dense_ids"] = """SELECT l_orderkey, l_linenumber, sum(l_quantity)::BIGINT AS quantity,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS line_id FROM lineitem GROUP BY l_orderkey, l_linenumber"""
    sizes = "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) "
    q["running_totals"] = sizes + "SELECT *, (sum(n) OVER (ORDER BY l_orderkey) - n)::BIGINT AS lines_before FROM n"
    q["limit_at_group"] = sizes + ("SELECT l_orderkey, n FROM (SELECT *, sum(n) OVER (ORDER BY l_orderkey) - n AS b FROM n) "
                                   "WHERE b < 2000")
    q["position_in_group"] = ("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 "
                              "AS pos FROM orders")
    q["first_per_key"] = ("SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority FROM orders QUALIFY row_number() OVER "
                          "(PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
    m = f"WITH {MATCHES} "
    q["match_categories"] = m + ("SELECT match_id, match_category, n_invoices, n_payments, total_amount, last_document_date, "
                                 "array_to_string(errors, ',') AS perturbation_categories FROM info")
    q["group_totals"] = m + "SELECT match_id, n_invoices AS n, total_amount, last_document_date AS last_date FROM facts"
    q["match_members"] = m + """SELECT match_id, o_orderkey AS invoice_id, case when match_id is not null then count(*) OVER (PARTITION BY match_id) end AS n,
  case when match_id is not null then row_number() OVER (PARTITION BY match_id ORDER BY o_orderkey) - 1 end AS pos
FROM orders LEFT JOIN im ON invoice_id = o_orderkey"""
    q["positive_pairs_many_to_many"] = """WITH o AS (SELECT min(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS match_id, year(o_orderdate)::INT AS year, o_orderkey FROM orders),
p AS (SELECT DISTINCT match_id, l_orderkey * 1000 + l_linenumber AS payment_id FROM lineitem JOIN o ON o_orderkey = l_orderkey),
mi AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY match_id) AS n_i FROM o),
mp AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY payment_id) - 1 AS j, count(*) OVER (PARTITION BY match_id) AS n_p FROM p),
s AS (SELECT match_id, any_value(n_i) AS n_i, coalesce(any_value(n_p), 0) AS n_p FROM mi LEFT JOIN mp USING (match_id) GROUP BY match_id),
b AS (SELECT *, sum(n_i + n_i * n_p + n_p) OVER (ORDER BY match_id) - (n_i + n_i * n_p + n_p) AS before FROM s)
SELECT (before + i * (b.n_p + 1) + 1 + j)::BIGINT AS pair_id, match_id, year, o_orderkey AS invoice_id, payment_id FROM mi JOIN mp USING (match_id) JOIN b USING (match_id)"""
    q["split_payments"] = f"{m}, {PAYMENTS} SELECT match_id, payment_id, total_amount, part_amount FROM split"
    q["payment_rows"] = f"{m}, {PAYMENTS} SELECT * FROM pay"
    a = f"WITH {ALL_PAIRS} "
    for name, kind in (("positive_pairs", "match"), ("negatives_by_invoice", "invoice_driven"),
                       ("negatives_by_payment", "payment_driven")):
        q[name] = f"{a} SELECT match_id, {PAIR_COLUMNS} FROM pairs WHERE kind = '{kind}'"
    q["labelled_pairs"] = f"{a} SELECT pair_id::BIGINT AS pair_id, match_id, {PAIR_COLUMNS} FROM pairs"
    q["labelled_pairs_limited"] = (f"{a} SELECT pair_id::BIGINT AS pair_id, p.match_id, {PAIR_COLUMNS.replace('match_category, perturbation_categories', 'p.match_category, p.perturbation_categories')} FROM pairs p "
                                   "JOIN mm ON mm.match_id = drawn_for WHERE pair_offset < 2000")
    q["pair_counts"] = f"{a} SELECT rows_match, count(*) AS n FROM pairs GROUP BY rows_match"
    q["attach_rows"] = f"""WITH {ROWS} SELECT match_id, invoice_id, payment_id, inv_billing_number AS billing, inv_amount,
  pay_memo_line AS memo, pay_amount FROM rows WHERE kind = 'match'"""
    i = f"WITH {INVOICES} "
    q["view_descriptive"] = f"{i} SELECT invoice_id, {view(DESCRIPTIVE)} FROM inv"
    q["view_opaque"] = f"{i} SELECT invoice_id, {view(OPAQUE)} FROM inv"
    q["view_payments_opaque"] = (f"{m}, {PAYMENTS} SELECT payment_id, "
                                 + ", ".join(f'pay_{c} AS "{n}"' for c, n in PAY_OPAQUE.items()) + " FROM pay")
    q["normalise_bkpf"] = f"{i}, " + normalised("inv", "invoice_id", member(OPAQUE, "inv", _KEY),
                                                member(OPAQUE, "inv", ["currency_code", "document_date"]))
    q["normalise_bseg"] = f"{i}, " + normalised("inv", "invoice_id", member(OPAQUE, "inv", _KEY), member(
        OPAQUE, "inv", ["line_item_number", "assignment_number", "billing_number", "customer_id", "amount", "due_date",
                        "terms_of_payment"]))
    q["normalise_kna"] = f"{i}, " + normalised("inv", "invoice_id", member(OPAQUE, "inv", ["client", "customer_id"]),
                                               member(OPAQUE, "inv", ["customer_name", "country_key"]))
    q["normalise_febep"] = f"{m}, {PAYMENTS}, " + normalised("pay", "payment_id", member(PAY_OPAQUE, "pay", _PAY_SHOWN), [])
    q["reassemble_source"] = f"""{i} SELECT invoice_id, inv_document_number AS "BELNR", inv_currency_code AS "WAERS",
  inv_document_date AS "BLDAT", inv_billing_number AS "VBELN", inv_amount AS "WRBTR", inv_customer_id AS "KUNNR",
  inv_customer_name AS "NAME1" FROM inv"""
    key = ", ".join(f"inv_{c}" for c in _KEY)
    q["members_long"] = (f'{i} SELECT invoice_id, min(invoice_id) OVER (PARTITION BY {key}) AS "BKPF", min(invoice_id) OVER (PARTITION BY {key}) AS "BSEG", '
                         'min(invoice_id) OVER (PARTITION BY inv_client, inv_customer_id) AS "KNA" FROM inv')
    q["all_customers"] = (f"{i}, c AS (SELECT DISTINCT inv_client, inv_customer_id FROM inv) SELECT n_nationkey, count(*) AS customers, "
                          "sum(substr(inv_customer_id, 4, 7)::BIGINT)::BIGINT AS numbers FROM nation CROSS JOIN c GROUP BY n_nationkey")
    q["join_on_member"] = f'{i} SELECT invoice_id, inv_customer_id AS "KUNNR", inv_country_key AS "LAND1" FROM inv'
    q["perturb_identifiers"] = f"""{i} SELECT invoice_id, inv_assignment_number,
  {broken('inv_assignment_number', 'id', 'invoice_id')} AS broken_assignment,
  {broken('invoice_id::VARCHAR', 'short', 'invoice_id')} AS broken_id FROM inv"""
    form = f"['Inc', 'and Sons', 'LLC', 'Group', 'PLC', 'Ltd', 'Co'][{below(7, u('form', 'c_custkey'))} + 1]"
    q["perturb_names"] = (f"WITH n AS (SELECT c_custkey, c_name || ' ' || {form} AS name FROM customer) "
                          f"SELECT c_custkey, name, {_name('name')} AS broken FROM n")
    q["small_deduction"] = (f"{i} SELECT invoice_id, inv_amount, "
                            f"{deducted('inv_amount', 'inv_currency_code', beta(3, 5, 'less', 'invoice_id'))} AS paid FROM inv")
    q["perturb_table"] = _perturbed()
    cats = ["one_pay_one_inv", "multi_pay_one_inv", "one_pay_multi_inv"]
    companies = [f"{j}000" for j in range(1, 10)]
    q["weighted_categories"] = f"""SELECT {weighted(cats, [0.6, 0.2, 0.2], u('cat', 'o_orderkey'))} AS category,
  {weighted(companies, [1.0 / 2**j for j in range(9)], u('company', 'o_orderkey'))} AS company, count(*) AS n
FROM orders GROUP BY ALL"""
    chosen = subset(ERRORS, [4, 3, 2, 1], uint(1, 4, u("size", "o_orderkey")), "set", "o_orderkey")
    q["perturbation_sets"] = f"SELECT o_orderkey, array_to_string(list_sort({chosen}), ',') AS errors FROM orders"
    q["beta_amounts"] = f"SELECT o_orderkey, floor({beta(2, 10, 'amount', 'o_orderkey')} * 1000000)::BIGINT AS usd FROM orders"
    q["fx_amounts"] = (f"{i} SELECT invoice_id, (inv_amount::DECIMAL(24,6) * ({FX.format('inv_currency_code')}))::DECIMAL(15,2) "
                       "AS converted FROM inv")
    q["unique_numbers"] = _unique()
    y = f"(ln(1.0::DOUBLE - {u('sap', 'o_orderkey')}) / pow(10.0::DOUBLE, digits - 5))"
    q["sap_numbers"] = (f"SELECT o_orderkey, digits, (pow(10.0::DOUBLE, digits - 1)::BIGINT + floor({_minus_expm1(y)} * (pow(10.0::DOUBLE, digits - 1) - 1))::BIGINT)::VARCHAR AS number "
                        f"FROM (SELECT o_orderkey, {uint(5, 15, u('digits', 'o_orderkey'))}::INT AS digits FROM orders)")
    bits = "greatest(2, ceil(log2(n::DOUBLE))::INT)"
    q["permuted_numbers"] = f"""WITH o AS (SELECT *, {bits} AS bits FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)),
r AS (SELECT *, {_feistel('i', 'n', 'bits', 'permuted')} AS rank FROM o) SELECT o_orderkey, rank, {_unique_value('rank', 'n', 10)} AS number FROM r"""
    q["sampled_ranks"] = f"""SELECT c_custkey, array_to_string(list_transform(range(0, 50), lambda j: {_feistel('j', '1000', '10', 'ranks', 'c_custkey')}), ',') AS drawn
FROM customer"""
    q["sampled_without_replacement"] = _sampled()
    taken = "list_sort(list_distinct([o_custkey, (o_custkey * 7) % 100]))"
    drawn = skip(below(f"(SELECT count(*) FROM customer) - len({taken})", u("outside", "o_orderkey")), taken)
    q["draws_outside_list"] = f"SELECT o_orderkey, {drawn} AS other_customer FROM orders"
    words = "['one', 'two', 'three', 'four', o_orderpriority]"
    q["shuffled_lists"] = (f"SELECT o_orderkey, array_to_string(list_transform(list_sort(list_transform({words}, lambda w, x: "
                           "{'k': " + u("shuffle", "x - 1", "o_orderkey") + ", 'w': w})), lambda s: s.w), ',') AS words FROM orders")
    at = below(36, u("chars", "x", "c_custkey"))
    q["random_texts"] = (f"SELECT c_custkey, array_to_string(list_transform(range(1, {uint(3, 15, u('len', 'c_custkey'))} + 1), "
                         f"lambda x: substr('abcdefghijklmnopqrstuvwxyz0123456789', {at} + 1, 1)), '') AS noise FROM customer")
    prefixes = "['#RECEIPT: ', 'payment ', 'ORDER OF ', 'PAY ', 'RECEIPT ', 'receipt number ', '']"
    q["customer_fixed_choices"] = f"""SELECT o_orderkey, o_custkey, {prefixes}[{below(7, u('memo', 'o_custkey'))} + 1] AS prefix,
  lpad({uint(1, 30, u('terms', 'o_custkey'))}::VARCHAR, 4, '0') AS terms FROM orders"""
    q["statement_names"] = """WITH d AS (SELECT s_suppkey % 10 AS g, arg_min(upper(s_name), s_suppkey) AS statement FROM supplier GROUP BY 1)
SELECT o_orderkey, o_custkey % 10 AS group_no, statement FROM orders JOIN d ON o_custkey % 10 = g"""
    first = "make_date(year(o_orderdate)::BIGINT, 1, 1)"
    day = (f"({first} + {below(f'date_diff(' + chr(39) + 'day' + chr(39) + f', {first}, make_date(year(o_orderdate)::BIGINT + 1, 1, 1))', u('day', 'o_orderkey'))}::INT)")
    q["due_and_posting_dates"] = f"""WITH d AS (SELECT *, {day} AS day FROM orders) SELECT o_orderkey,
  {posted('o_orderdate', 'floor(' + beta(2, 5, 'days', 'o_orderkey') + ' * 60)')} AS due,
  strftime(case when month(day) = 2 and day(day) = 29 then day - 1 else day end, '%Y%m%d') AS drawn_day FROM d"""
    q["memo_lines"] = f"""{i} SELECT invoice_id, case when {u('memo_order', 'inv_customer_id')} < 0.5::DOUBLE
    then 'PAY ' || inv_billing_number || ' ' || inv_assignment_number
    else 'ref ' || inv_assignment_number || ' / ' || inv_billing_number || '{{{{not again}}}}' end AS memo,
  '#RECEIPT: ' || inv_billing_number || ' ' || inv_customer_id AS receipt FROM inv"""
    q["id_lists"] = f"""{m}, n AS (SELECT match_id, invoice_id, inv_billing_number,
    row_number() OVER (PARTITION BY match_id ORDER BY invoice_id) - 1 AS k FROM im JOIN inv USING (invoice_id))
SELECT match_id, string_agg('REF ' || k::VARCHAR || ': ' || inv_billing_number, ' & ' ORDER BY k) AS memo FROM n GROUP BY match_id"""
    shown = ["c_custkey", "c_name", "'\"' || c_mktsegment || '\", ' || c_name", "c_acctbal::DECIMAL(15,2)",
             "case when c_custkey % 2 = 0 then ' x ' end"]
    q["linearize_rows"] = (f"SELECT c_custkey, 'Client,Name,\"Segment, quoted\",Balance,Note' || chr(10) || {csv_line(*shown)} "
                           "AS row_text FROM customer")
    q["linearize_documents"] = f"SELECT doc_id, {csv_line('lang', 'source', 'text')} AS row_text FROM documents"
    table = markdown([("Name", "c_name", False), ("Segment", "c_mktsegment", False), ("Balance", "c_acctbal::DECIMAL(15,2)", True)])
    q["linearize_markdown"] = f"SELECT c_custkey, 'customers:' || chr(10) || {table} AS row_text FROM customer"
    parts = []
    for cols in (_KEY + ["currency_code", "document_date"],
                 _KEY + ["line_item_number", "assignment_number", "billing_number", "customer_id", "amount", "due_date",
                         "terms_of_payment"], ["client", "customer_id", "customer_name"]):
        parts.append(f"'{','.join(OPAQUE[c] for c in cols)}' || chr(10) || " + csv_line(*["inv_" + c for c in cols]))
    q["linearize_member_tables"] = f"{i} SELECT invoice_id AS pair_id, " + " || '   ' || ".join(parts) + " AS first_table_row FROM inv"
    limits = "case when rows_match then 101 else 101 end::INT AS max_tokens"
    q["few_shot_requests"] = f"""WITH {FEW}, {few_shot(2)} SELECT pair_id, 'gpt-3.5-turbo-1106' AS model, {limits},
  0.0::DOUBLE AS temperature, 20231::BIGINT AS seed, 10::INT AS n_messages, chat FROM chats"""
    q["pair_requests"] = f"""WITH {ROWS}, {PAIR_TEXTS}, {few_shot(1)} SELECT pair_id::BIGINT AS pair_id, 6::INT AS n_messages,
  sha256(chat) AS chat_digest FROM chats"""
    for mode, texts_ in VIEW_TEXTS.items():
        q[f"pair_requests_{mode}"] = f"""WITH {ROWS}, {texts_}, {few_shot(1)} SELECT pair_id::BIGINT AS pair_id, 6::INT AS n_messages,
  sha256(chat) AS chat_digest FROM chats"""
    q["chat_messages"] = """SELECT conv_id, count(*)::INT AS n_messages,
  string_agg(role || '> ' || text, chr(10) ORDER BY turn, role, text) AS chat FROM conversations GROUP BY conv_id"""
    q["execute_requests"] = f"""WITH {CHATS} SELECT conv_id AS pair_id, model, cached,
  case when cached then 'stop' when conv_id % 9 <> 0 then case when completion = 50 then 'length' else 'stop' end end AS finish_reason,
  case when cached then 'No' when conv_id % 9 <> 0 then case when size % 2 = 0 then 'Yes' else 'No' end end AS answer,
  case when cached then size + 1 when conv_id % 9 <> 0 then size + 2 end AS total_tokens FROM audited"""
    q["executed_cache"] = f"WITH {CHATS} SELECT count(*) AS added, 0::BIGINT AS again FROM audited WHERE NOT cached AND conv_id % 9 <> 0"
    q["cache_states"] = f"""WITH {CHATS}, t AS (SELECT model, case when cached then 'hit' when hash IN (SELECT hash FROM cache) then 'stale' else 'miss' end AS state FROM audited)
SELECT model, state, count(*) AS n FROM t GROUP BY model, state"""
    q["execution_counts"] = f"""WITH {CHATS}, t AS (SELECT *, hash IN (SELECT hash FROM cache) AS held FROM audited)
SELECT unnest(['requests', 'hit', 'stale', 'miss', 'failed', 'cut_off']) AS counter, unnest([count(*), count(*) FILTER (WHERE cached),
  count(*) FILTER (WHERE held AND NOT cached), count(*) FILTER (WHERE NOT held), count(*) FILTER (WHERE NOT cached AND conv_id % 9 = 0),
  count(*) FILTER (WHERE NOT cached AND conv_id % 9 <> 0 AND completion = 50)]) AS n FROM t"""
    q["cache_cost"] = f"""WITH {CHATS} SELECT model, count(*) AS responses, sum(size + 1)::BIGINT AS total_tokens,
  sum(size * pin / 1000.0::DOUBLE + pout / 1000.0::DOUBLE)::DECIMAL(18,8) AS cost
  FROM hashed JOIN cache USING (hash) JOIN prices USING (model) GROUP BY model"""
    q["chat_templates"] = """SELECT doc_id, 'system> Language ' || lang || chr(10) || 'assistant> ' || source || chr(10) || 'user> '
  || text AS chat FROM documents"""
    q["request_audit"] = f"""WITH {CHATS} SELECT conv_id, hash, cached, input_tokens, max_input_usage, max_output_usage, issues,
  max_cost::DECIMAL(18,8) AS max_cost FROM audited"""
    q["cache_misses"] = f"WITH {CHATS} SELECT conv_id, hash FROM audited WHERE NOT cached"
    q["max_cost"] = (f"WITH {CHATS} SELECT count(*) AS requests, sum(max_cost)::DECIMAL(18,6) AS max_cost FROM audited "
                     "WHERE NOT cached")
    q["actual_cost"] = f"""WITH {RESPONSES}, {CHATS[CHATS.index('prices AS'):CHATS.index('audit AS')].rstrip().rstrip(',')}
SELECT r.model, count(*) AS responses, sum(case when failed then 0 else prompt + completion end)::BIGINT AS total_tokens,
  sum(case when failed then 0 else prompt * pin / 1000.0::DOUBLE + completion * pout / 1000.0::DOUBLE end)::DECIMAL(18,6) AS cost
FROM resp r JOIN prices p ON r.model = p.model GROUP BY r.model"""
    q["rule_scores"] = (f"WITH {RULED} SELECT pair_id::BIGINT AS pair_id, rows_match, {', '.join(RULES)}, ({SCORE})::INT AS score "
                        "FROM decided")
    q["rule_match_f1"] = (f"WITH {RULED}, c AS (SELECT match_category, {COUNTS} FROM decided GROUP BY match_category) "
                          f"SELECT *, {SCORES} FROM c")
    q["rule_match_by_error"] = (
        f"WITH {RULED}, e AS (SELECT truth, prediction, unnest(case when len(errors) = 0 then ['clean'] else errors end) AS label "
        f"FROM decided), c AS (SELECT label, {COUNTS} FROM e GROUP BY label) SELECT *, {dec(F1, 'f1')} FROM c")
    q["generated_matches"] = f"""WITH {_plan('multi')} SELECT m AS match_id, cat AS match_category,
  array_to_string(list_sort(e), ',') AS perturbation_categories,
  array_to_string(range(ib::BIGINT, (ib + ni)::BIGINT), ',') AS invoice_ids,
  array_to_string(range(pb::BIGINT, (pb + np)::BIGINT), ',') AS payment_ids,
  array_to_string(list_sort(case when cat = 'one_pay_multi_inv' then list_filter(e, lambda x: x <> 'perturbed_assignment_number')
    else e end), ',') AS effective_perturbations FROM b"""
    due = posted("strptime(d, '%Y%m%d')", "floor(" + beta(2, 5, "single.due", "sn") + " * 60)")
    q["generated_invoices"] = f"""WITH {_generated('single')} SELECT iid AS invoice_id, '001' AS inv_client, company AS inv_company_code,
  yr::INT AS inv_fiscal_year, doc AS inv_document_number, item AS inv_line_item_number, asg AS inv_assignment_number,
  bill AS inv_billing_number, cid AS inv_customer_id, cname AS inv_customer_name, cur AS inv_currency_code,
  land AS inv_country_key, amount AS inv_amount, d AS inv_document_date, {due} AS inv_due_date, terms AS inv_terms_of_payment
FROM ginv2"""
    renamed = dict(zip(["doc", "item", "asg", "bill", "cid", "cname", "cur", "amount", "d"],
                       ["BELNR", "BZUEI", "ZUONR", "VBELN", "KUNNR", "NAME1", "WAERS", "WRBTR", "BLDAT"]))
    q["schema_views"] = (f"WITH {_generated('single')} SELECT iid AS invoice_id, '001' AS \"MANDT\", company AS \"BURKS\", "
                         f"yr::INT AS \"GJAHR\", " + ", ".join(f'{k} AS "{v}"' for k, v in renamed.items())
                         + f', {due} AS "ZFBDT" FROM ginv2')
    q["generated_payments"] = f"WITH {_generated('multi')} SELECT * FROM gpay"
    given = _generated("single").replace("ginv2 AS (", "ginv1 AS (SELECT g.* REPLACE (case when ni = 1 then o.amount else g.amount end AS amount, case when ni = 1 then o.day else d0 end AS d0, "
                                         "case when ni = 1 then year(o.day) else yr end AS yr) FROM ginv g JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS m, "
                                         "o_totalprice::DECIMAL(15,2) AS amount, o_orderdate::DATE AS day FROM orders) o USING (m)),\nginv2 AS (", 1).replace("AS bill FROM ginv)", "AS bill FROM ginv1)", 1)
    given = given.replace("case when month(d0) = 2 and day(d0) = 29 then d0 - 1 else d0 end", "case when ni > 1 and month(d0) = 2 and day(d0) = 29 then d0 - 1 else d0 end")
    q["generated_from_orders"] = f"""WITH {given} SELECT iid AS invoice_id, yr::INT AS inv_fiscal_year, amount AS inv_amount, cur AS inv_currency_code, d AS inv_document_date,
  {due} AS inv_due_date FROM ginv2"""
    q["generated_payments_of_orders"] = f"""WITH {given} SELECT m AS match_id, count(*) AS payments, sum(pay_amount)::DECIMAL(15,2) AS paid, max(pay_posting_date) AS last_date
FROM gpay JOIN split ON pid = payment_id GROUP BY m"""
    q["schema_views_all"] = _all_views(due)
    q["csv_round_trip_matches"] = f"""WITH {_plan('multi')} SELECT m AS match_id, cat AS match_category, array_to_string(list_sort(e), ',') AS perturbation_categories,
  array_to_string(range(ib, ib + ni), ',') AS invoice_ids, array_to_string(range(pb, pb + np), ',') AS payment_ids FROM b"""
    q["report_file"] = (f"SELECT *, (list_position({MODELS}, model) - 1)::BIGINT AS line FROM ({q['report_precision_recall']})")
    q["both_modes"] = " UNION ALL ".join(
        f"SELECT * FROM (WITH {_plan(mode)} SELECT '{mode}' AS perturbation_mode, cat AS match_category, len(e)::INT AS errors, count(*) AS n FROM b GROUP BY cat, len(e))"
        for mode in ("single", "multi"))
    pay_shown = ", ".join(f'pay_{c} AS "{n}"' for c, n in PAY_OPAQUE.items())
    q["shown_rows"] = f"{m}, {PAYMENTS} SELECT {pay_shown}, count(*) AS n FROM pay GROUP BY ALL"
    q["csv_round_trip"] = q["view_descriptive"]
    q["csv_round_trip_documents"] = "SELECT doc_id, text, lang FROM documents"
    q["json_round_trip"] = f"""WITH {RESPONSES} SELECT pair_id, model, response_text,
  case when failed then null else prompt + completion end AS total_tokens FROM answers"""
    q["parquet_round_trip"] = (f"WITH {ROWS} SELECT pair_id::BIGINT AS pair_id, kind, inv_billing_number AS billing, pay_amount, "
                               "'multi' AS perturbation_mode FROM rows")
    q["list_columns_as_text"] = """SELECT doc_id, '[' || array_to_string(n, ',') || ']' AS stored, len(n)::INT AS n, list_sum(n)::BIGINT AS total
FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)::BIGINT) AS n FROM documents)"""
    return q
