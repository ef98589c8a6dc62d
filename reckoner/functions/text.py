"""Text: broken identifiers and names, memo parts, templates, answers, rendered rows, hashes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from reckoner.functions.draws import below, col, exp_drop_length, let, u01, uint

# Fixed value: how a template writes a variable.
VARIABLE = r"\{\{([^{}]+)\}\}"

# Legal forms that a broken company name may lose.
NAME_SUFFIXES = ("Inc", "and Sons", "LLC", "Group", "PLC", "Ltd")

# Tokens that a chat message costs besides its content.
TOKENS_PER_MESSAGE = 5


# ---------------------------------------------------------------- identifiers and names

def break_identifier(c: Column | str, seed: int, tag: str, *key: Column | str) -> Column:
    """One typing error: a blank put in, a character lost, a digit put in, two neighbours swapped or
    an end cut off, each for a fifth of the rows; texts too short for their error stay as they are."""
    s = col(c)
    n = F.length(s)
    branch, where = u01(seed, tag + ".branch", *key), u01(seed, tag + ".at", *key)
    extra = u01(seed, tag + ".extra", *key)

    def replaced(by: Column, at: Column, length: int) -> Column:  # at counts from 0; each position is used once
        return F.overlay(s, by, (at + F.lit(1)).cast("int"), F.lit(length))

    blank = replaced(F.lit(" "), uint(1, n - 1, where), 0)
    lost = replaced(F.lit(""), below(n, where), 1)
    digit = replaced(below(10, extra).cast("string"), below(n + 1, where), 0)
    at = below(n - 1, where)
    swapped = replaced(F.reverse(F.substr(s, (at + F.lit(1)).cast("int"), F.lit(2))), at, 2)
    cut = exp_drop_length(n - 1, 4, where).cast("int")
    ends = F.when(extra < F.lit(0.5), F.substr(s, F.lit(1), n - cut)).otherwise(F.substr(s, cut + F.lit(1)))
    # elt draws its index once and computes the chosen error only; a CASE would draw again for each condition
    return F.elt((below(5, branch) + F.lit(1)).cast("int"), F.when(n >= 2, blank).otherwise(s), F.when(n >= 5, lost).otherwise(s), digit,
                 F.when(n >= 2, swapped).otherwise(s), F.when(n >= 5, ends).otherwise(s))


def break_name(c: Column | str, seed: int, tag: str, *key: Column | str) -> Column:
    """Company name without its legal form (half of the rows), in lower or upper case."""
    s = col(c)
    drop, lower, upper = (u01(seed, f"{tag}.{t}", *key) < F.lit(p)
                          for t, p in (("suffix", 0.5), ("lower", 0.25), ("upper", 0.5)))
    short = F.regexp_replace(s, "(" + "|".join(NAME_SUFFIXES) + ")$", "")
    s = F.when(drop, short).otherwise(s)
    return F.when(lower, F.lower(s)).when(upper, F.upper(s)).otherwise(s)


def join_ids(ids: Column, template: str | Column, separator: str | Column) -> Column:
    """One text of an id list: each id in ``template`` ({{idx}} from 0, {{identifier}})."""
    sep = F.lit(separator) if isinstance(separator, str) else separator
    if isinstance(template, str):
        parts = F.transform(ids, lambda x, i: fill_template(template, idx=i.cast("string"), identifier=x))
    else:  # a row's template is taken apart once, not for each id
        parts = let(_template_pieces(template), lambda t: F.transform(ids, lambda x, i: _fill_pieces(t, idx=i.cast("string"), identifier=x)))
    # array_join takes a constant separator only, so a per-row one is put in front of each part
    return F.substr(
        F.array_join(F.transform(parts, lambda p: F.concat(sep, p)), ""), (F.length(sep) + F.lit(1)).cast("int"))


# ---------------------------------------------------------------- templates

def fill_template(template: str, **values: Column) -> Column:
    """Constant template with {{variables}}: split here, so rows see one ``concat``.

    A variable without a value raises; values that are not needed are ignored; text that comes in
    with a value is not searched again."""
    parts: list[Column] = []
    for i, piece in enumerate(re.split(VARIABLE, template)):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in values:
            parts.append(values[piece].cast("string"))
        else:
            raise ValueError(f"no value for template variable {piece}")
    return F.concat(*parts)


def fill_template_column(template: Column, **values: Column) -> Column:
    """The same for a template that is data: one pass over the variables of each row's template."""
    return let(_template_pieces(template), lambda t: _fill_pieces(t, **values))


def _template_pieces(template: Column) -> Column:
    return F.struct(F.split(template, VARIABLE).alias("texts"), F.regexp_extract_all(template, F.lit(VARIABLE), F.lit(1)).alias("names"))


def _fill_pieces(template: Column, **values: Column) -> Column:
    texts, names = template["texts"], template["names"]
    filling = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])

    def value(name: Column) -> Column:
        missing = F.raise_error(F.concat(F.lit("no value for template variable "), name)).cast("string")
        return F.coalesce(F.try_element_at(filling, name), missing)

    piece = F.transform(
        texts, lambda t, i: F.when(i < F.size(names), F.concat(t, value(F.get(names, i)))).otherwise(t))
    return F.array_join(piece, "")


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


MESSAGES = "array<struct<role:string,content:string>>"


def fill_chat(template: Sequence[Mapping[str, str] | str], **values: Column | dict[str, Column]) -> Column:
    """Chat template to an array of messages.

    An entry "{{name}}" stands for a list of messages (an array column) or for one message (a dict
    of columns); variables inside contents take text columns."""
    texts = {k: v for k, v in values.items() if isinstance(v, Column)}
    parts = []
    for entry in template:
        if isinstance(entry, str):
            found = re.fullmatch(VARIABLE, entry)
            value = values.get(found.group(1)) if found else None
            if value is None:
                raise ValueError(f"no value for template message {entry}")
            if isinstance(value, dict):
                value = F.array(message(value["role"], value["content"]))
            parts.append(value)
        else:
            parts.append(F.array(message(entry["role"], fill_template(entry["content"], **texts))))
    return F.concat(*[p.cast(MESSAGES) for p in parts])


# ---------------------------------------------------------------- answers

def parse_yes_no(c: Column | str, strip_punctuation: bool = False) -> Column:
    """True for a text with the word yes, False for one with no, NULL for both or neither."""
    s = F.lower(col(c))
    if strip_punctuation:
        s = F.regexp_replace(s, r"[^\p{L}\p{N}\s]", " ")
    words = F.split(F.trim(s), r"\s+")
    yes, no = F.array_contains(words, "yes"), F.array_contains(words, "no")
    return F.when(yes & ~no, True).when(no & ~yes, False)


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def resolve_prediction(prediction: Column, truth: Column) -> Column:
    """An answer that could not be read counts as wrong."""
    return F.coalesce(prediction, ~truth)


def response_text(choices: Column) -> Column:
    """Text of the first choice; NULL for a failed request."""
    return F.get(choices, F.lit(0))["message"]["content"]


def response_text_json(raw: Column) -> Column:
    """The same from the raw JSON text of a response."""
    return F.get_json_object(raw, "$.choices[0].message.content")


# ---------------------------------------------------------------- rows as text

def csv_cell(c: Column) -> Column:
    """Minimal CSV quoting; NULL is empty."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    special = s.contains('"') | s.contains(",") | s.contains("\n") | s.contains("\r")
    return F.when(special, quoted).otherwise(s)


def _csv_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"' if re.search('[",\n\r]', name) else name


def linearize_csv(columns: Sequence[str] | Mapping[str, Column], header: bool = True,
                  template: str = "{{table}}", table_name: Column | None = None) -> Column:
    """A row as CSV text: header line and value line, placed in a table template."""
    columns = columns if isinstance(columns, Mapping) else {c: F.col(f"`{c}`") for c in columns}
    line = F.concat(*_between([csv_cell(c) for c in columns.values()], ","), F.lit("\n"))
    if header:
        line = F.concat(F.lit(",".join(_csv_name(n) for n in columns) + "\n"), line)
    return _in_table_template(line, template, table_name)


def linearize_markdown(columns: Mapping[str, Column], numeric: Sequence[str] = (),
                       template: str = "{{table}}", table_name: Column | None = None) -> Column:
    """A row as Markdown table: text to the left, the ``numeric`` columns to the right."""
    names, rules, cells = [], [], []
    for name, c in columns.items():
        s = F.coalesce(c.cast("string"), F.lit(""))
        width = F.greatest(F.length(s), F.lit(len(name) + 2))
        if name in numeric:
            names.append(F.lpad(F.lit(name), width, F.lit(" ")))
            rules.append(F.concat(F.repeat(F.lit("-"), width + 1), F.lit(":")))
            cells.append(F.lpad(s, width, F.lit(" ")))
        else:
            names.append(F.rpad(F.lit(name), width, F.lit(" ")))
            rules.append(F.concat(F.lit(":"), F.repeat(F.lit("-"), width + 1)))
            cells.append(F.rpad(s, width, F.lit(" ")))
    lines = [
        F.concat(F.lit("| "), *_between(names, " | "), F.lit(" |")),
        F.concat(F.lit("|"), *_between(rules, "|"), F.lit("|")),
        F.concat(F.lit("| "), *_between(cells, " | "), F.lit(" |")),
    ]
    return _in_table_template(F.concat(*_between(lines, "\n")), template, table_name)


def _between(columns: Sequence[Column], separator: str) -> list[Column]:
    out = [columns[0]]
    for c in columns[1:]:
        out += [F.lit(separator), c]
    return out


def _in_table_template(text: Column, template: str, table_name: Column | None) -> Column:
    if template == "{{table}}":
        return text
    values = {"newline": F.lit("\n"), "table": text}
    if table_name is not None:
        values["table_name"] = table_name
    return fill_template(template, **values)


def linearize_multi(texts: Sequence[Column]) -> Column:
    """Texts of member tables, in the given order, with three blanks between them."""
    return F.concat_ws("   ", *texts)


def mean_se(value: Column, se: Column) -> Column:
    """Report cell such as ``0.97 ± 0.02``."""
    return F.format_string("%.2f ± %.2f", *[F.round(c.cast("decimal(20,12)"), 2).cast("double") for c in (value, se)])


# ---------------------------------------------------------------- requests

REQUEST_FIELDS = {"model": "string", "max_tokens": "int", "temperature": "double", "messages": MESSAGES, "seed": "bigint",
                  "n": "int", "best_of": "int", "max_completion_tokens": "int"}


def request_json(columns: Sequence[str]) -> Column:
    """A request as JSON with all fields in a fixed order; missing values, and fields that are not among ``columns``, are written as null."""
    fields = [(F.col(c) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in REQUEST_FIELDS.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def request_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def token_estimate(c: Column | str) -> Column:
    """Tokens of a text, about one per four characters, rounded up."""
    return F.ceil(F.length(col(c)) / F.lit(4.0))


def message_tokens(messages: Column) -> Column:
    """Input tokens of a chat: contents plus a fixed charge per message."""
    return F.aggregate(
        messages, F.lit(0).cast("bigint"),
        lambda acc, m: acc + F.coalesce(token_estimate(m["content"]), F.lit(0)) + F.lit(TOKENS_PER_MESSAGE))


def max_tokens(label: Column, margin: int | None) -> Column:
    """Output limit: tokens of the label and a margin; no margin means no limit."""
    return F.lit(None).cast("int") if margin is None else (token_estimate(label) + F.lit(margin)).cast("int")
