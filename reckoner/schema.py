"""Attribute catalogue: one record per attribute drives the views, the names and the member tables."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Attribute:
    name: str
    descriptive: str
    opaque: str
    type: str
    tables: tuple[str, ...]  # member tables of the multi-table view
    key_of: tuple[str, ...] = ()  # member tables whose primary key it belongs to
    in_view: bool = True  # shown in the one-table views


# Names, visibility and table membership of the attributes, in the order of the views.
INVOICE_ATTRIBUTES = (
    Attribute("inv_client", "Client", "MANDT", "string", ("BKPF", "BSEG", "KNA-1"), ("BKPF", "BSEG", "KNA-1")),
    Attribute("inv_company_code", "Company Code", "BURKS", "string", ("BKPF", "BSEG"), ("BKPF", "BSEG")),
    Attribute("inv_fiscal_year", "Fiscal Year", "GJAHR", "int", ("BKPF", "BSEG"), ("BKPF", "BSEG")),
    Attribute("inv_document_number", "Document Number", "BELNR", "string", ("BKPF", "BSEG"), ("BKPF", "BSEG")),
    Attribute("inv_line_item_number", "Line Item Number", "BZUEI", "string", ("BSEG",)),
    Attribute("inv_assignment_number", "Assignment Number", "ZUONR", "string", ("BSEG",)),
    Attribute("inv_billing_number", "Billing Number", "VBELN", "string", ("BSEG",)),
    Attribute("inv_customer_id", "Customer ID", "KUNNR", "string", ("BSEG", "KNA-1"), ("KNA-1",)),
    Attribute("inv_customer_name", "Customer Name", "NAME1", "string", ("KNA-1",)),
    Attribute("inv_currency_code", "Currency Code", "WAERS", "string", ("BKPF",)),
    Attribute("inv_country_key", "Country Key", "LAND1", "string", ("KNA-1",), in_view=False),
    Attribute("inv_amount", "Amount", "WRBTR", "decimal(15,2)", ("BSEG",)),
    Attribute("inv_document_date", "Document Date", "BLDAT", "string", ("BKPF",)),
    Attribute("inv_due_date", "Due Date", "ZFBDT", "string", ("BSEG",)),
    Attribute("inv_terms_of_payment", "Terms of Payment", "ZTERM", "string", ("BSEG",), in_view=False),
)
PAYMENT_ATTRIBUTES = (
    Attribute("pay_business_partner", "Business Partner", "PARTN", "string", ("FEBEP",), ("FEBEP",)),
    Attribute("pay_account_number", "Account Number", "AVKON", "string", ("FEBEP",), ("FEBEP",)),
    Attribute("pay_memo_line", "Memo Line", "SGTXT", "string", ("FEBEP",), ("FEBEP",)),
    Attribute("pay_amount", "Amount", "KWBTR", "decimal(15,2)", ("FEBEP",), ("FEBEP",)),
    Attribute("pay_currency", "Currency", "KWAER", "string", ("FEBEP",), ("FEBEP",)),
    Attribute("pay_posting_date", "Posting Date", "BVDAT", "string", ("FEBEP",), ("FEBEP",)),
)

# Categories as they stand in the data.
ONE_ONE, MULTI_PAY, MULTI_INV = "one_pay_one_inv", "multi_pay_one_inv", "one_pay_multi_inv"
PERTURBATIONS = (
    "small_deduction", "perturbed_business_partner", "perturbed_billing_number", "perturbed_assignment_number")
SCHEMA_MODES = ("descriptive", "opaque", "multi-table")
PERTURBATION_MODES = ("single", "multi")

MATCHES = ("match_id bigint, match_category string, perturbation_categories array<string>, "
           "invoice_ids array<bigint>, payment_ids array<bigint>")
REQUESTS = ("pair_id bigint, model string, max_tokens int, temperature double, seed bigint, "
            "messages array<struct<role:string,content:string>>, n int, best_of int, max_completion_tokens int")
RESPONSES = ("pair_id bigint, model string, "
             "choices array<struct<finish_reason:string,message:struct<content:string>>>, "
             "usage struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")
CACHE = "hash string, request string, response string"


def attributes(side: str) -> tuple[Attribute, ...]:
    return {"invoice": INVOICE_ATTRIBUTES, "payment": PAYMENT_ATTRIBUTES}[side]


def member_tables(side: str) -> dict[str, tuple[list[Attribute], list[Attribute]]]:
    """Member table to its attributes and to its primary key."""
    names = dict.fromkeys(t for a in attributes(side) for t in a.tables)
    return {
        t: ([a for a in attributes(side) if t in a.tables], [a for a in attributes(side) if t in a.key_of])
        for t in names
    }


def view_schema(side: str, mode: str, table: str | None = None) -> str:
    """Schema of one table of a view: the id, then the attributes in catalogue order. A member table bears the lowest id of each key and counts its ids; ``links`` has the
    id that an id's row of each member table bears."""
    check_mode(mode, SCHEMA_MODES, "schema mode")
    if table == "links":
        shown = [(t, "bigint") for t in member_tables(side)]
    elif mode == "multi-table":
        shown = [*[(a.opaque, a.type) for a in member_tables(side)[table][0]], ("n_ids", "bigint")]
    else:
        shown = [(getattr(a, mode), a.type) for a in attributes(side) if a.in_view]
    return ", ".join(f"`{n}` {t}" for n, t in [(f"{side}_id", "bigint"), *shown])


def check_mode(value: str, allowed: tuple[str, ...], what: str) -> None:
    if value not in allowed:
        raise ValueError(f"unknown {what} {value!r}, expected one of {', '.join(allowed)}")
