"""Chat requests: rows as text, few-shot examples, templates, output limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from reckoner.functions import text
from reckoner.functions.draws import sample_k, u01
from reckoner.operators.ranks import dense_id

# Wording of the default prompt.
PROMPT_TEMPLATE = (
    {"role": "user", "content": "Do the two table entries refer to the same real-world entity?\n"
                                "Answer with \"Yes\" if they do and with \"No\" if they do not."},
    "{{examples}}",
    {"role": "user", "content": "First entry: {{first_table_row}} Second entry: {{second_table_row}}"},
)
EXAMPLE_TEMPLATE = (
    {"role": "user", "content": "First entry: {{first_table_row}} Second entry: {{second_table_row}}"},
    {"role": "assistant", "content": "{{ground_truth}}"},
)


@dataclass(frozen=True)
class RequestConfig:
    model: str
    num_examples: int = 1  # of each label
    temperature: float = 0.0
    max_tokens_over_label: int | None = 100
    request_seed: int = 20_231
    draw_seed: int = 0
    prompt: Sequence = field(default=PROMPT_TEMPLATE)
    example: Sequence = field(default=EXAMPLE_TEMPLATE)


def _rendered(fields: Mapping[str, Column], kinds: Mapping[str, str], markdown: bool) -> Column:
    if not markdown:
        return text.linearize_csv(fields)
    numeric = [n for n, k in kinds.items() if k in ("integer", "long", "double", "decimal")]
    return text.linearize_markdown(fields, numeric)


def pair_texts(pairs: DataFrame, source: str | Sequence[str] = "source", target: str = "target",
               markdown: bool = False) -> DataFrame:
    """Linearise the source and target struct of each pair; several source structs make member tables."""
    sources = [source] if isinstance(source, str) else list(source)

    def render(struct: str) -> Column:
        inner = pairs.schema[struct].dataType
        return _rendered({n: F.col(struct)[n] for n in inner.names},
                         {f.name: f.dataType.typeName() for f in inner.fields}, markdown)

    first = text.linearize_multi([render(s) for s in sources]) if len(sources) > 1 else render(sources[0])
    return pairs.select("pair_id", "rows_match", first.alias("first_table_row"),
                        render(target).alias("second_table_row"))


def row_texts(df: DataFrame, id_col: str, name: str, markdown: bool = False) -> DataFrame:
    """(id, text) of a table: a row that many pairs share is linearised once."""
    shown = [f for f in df.schema.fields if f.name != id_col]
    return df.select(id_col, _rendered({f.name: F.col(f"`{f.name}`") for f in shown},
                                       {f.name: f.dataType.typeName() for f in shown}, markdown).alias(name))


def source_texts(rows: DataFrame, id_col: str, structs: Sequence[str], name: str, markdown: bool = False) -> DataFrame:
    """(id, text) of rows that carry their member tables as structs."""
    def render(struct: str) -> Column:
        inner = rows.schema[struct].dataType
        return _rendered({n: F.col(struct)[n] for n in inner.names}, {f.name: f.dataType.typeName() for f in inner.fields}, markdown)

    return rows.select(id_col, text.linearize_multi([render(s) for s in structs]).alias(name))


def attach_texts(pairs: DataFrame, invoices: DataFrame, payments: DataFrame, markdown: bool = False) -> DataFrame:
    """``pair_texts`` of (pair_id, rows_match, invoice_id, payment_id) from the two tables."""
    return (pairs.select("pair_id", "rows_match", "invoice_id", "payment_id")
            .join(row_texts(invoices, "invoice_id", "first_table_row", markdown), "invoice_id")
            .join(row_texts(payments, "payment_id", "second_table_row", markdown), "payment_id")
            .select("pair_id", "rows_match", "first_table_row", "second_table_row"))


def drawn_examples(pool: DataFrame, k: int, seed: int) -> DataFrame:
    """(pair_id, rows_match, o, label, _at): for each row the labels and numbers of k other rows of either label, and their place ``o`` in keyed random order.

    ``pool`` has the rows numbered by (label, pair_id) as ``_at``: a label is a range of numbers, and draws are numbers in it."""
    sizes = pool.agg(F.struct(F.count_if(~F.col("rows_match")).alias("no"),
                              F.count_if(F.col("rows_match")).alias("yes")))
    rows = pool.select("pair_id", "rows_match", "_at").withColumn("_n", sizes.scalar())
    nothing = F.array().cast("array<bigint>")

    def draws(label: bool) -> Column:
        n, first = (F.col("_n.yes"), F.col("_n.no")) if label else (F.col("_n.no"), F.lit(0).cast("bigint"))
        same = F.col("rows_match") if label else ~F.col("rows_match")
        own = F.when(same, F.array(F.col("_at") - first)).otherwise(nothing)
        few = F.raise_error(F.lit(f"fewer than {k} other rows of a label")).cast("bigint")
        checked = F.when(n - F.size(own) >= k, n).otherwise(few)
        numbers = sample_k(checked, k, own, seed, f"example{int(label)}", "pair_id")
        return F.transform(numbers, lambda x: x + first)

    both = F.concat(draws(False), draws(True))
    order = F.array_sort(F.transform(both, lambda x, i: F.struct(u01(seed, "order", i, "pair_id").alias("o"), x.alias("x"), (i >= k).alias("label"))))
    placed = rows.select("pair_id", "rows_match", F.posexplode(order).alias("o", "_d"))  # a place is slimmer than the draw it comes from
    return placed.select("pair_id", "rows_match", "o", "_d.label", F.col("_d.x").alias("_at"))


EXAMPLES = "array<struct<first_table_row:string,second_table_row:string,ground_truth:string>>"


def _with_examples(texts: DataFrame, pool: DataFrame, k: int, seed: int) -> DataFrame:
    """``texts`` (pair_id, rows_match, two texts) with their ``examples``. What is numbered and drawn are the ids in ``pool``; a drawn row's texts come by its pair_id, so texts are
    dealt by pair_id for the lookup and for the requests alike."""
    drawn = drawn_examples(pool, k, seed).drop("rows_match").join(pool.select("_at", F.col("pair_id").alias("_shown")), "_at").select("pair_id", "o", "_shown")
    example = F.struct("first_table_row", "second_table_row", text.yes_no(F.col("rows_match")).alias("ground_truth"))
    lists = (drawn.join(texts.select(F.col("pair_id").alias("_shown"), example.alias("example")), "_shown")
             .groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("o", "example"))).alias("_e")))  # 2 k examples
    return texts.join(lists, "pair_id").withColumn("examples", F.transform("_e", lambda s: s["example"])).drop("_e")


def attach_examples(texts: DataFrame, k: int, seed: int) -> DataFrame:
    """Give each row k other rows of either label, in keyed random order, as an array ``examples``."""
    if k == 0:
        return texts.withColumn("examples", F.array().cast(EXAMPLES))
    return _with_examples(texts, dense_id(texts.select("rows_match", "pair_id"), ["rows_match", "pair_id"], "_at"), k, seed)


def chat_requests(texts: DataFrame, cfg: RequestConfig) -> DataFrame:
    """Requests of rows that carry their examples."""
    label = text.yes_no(F.col("rows_match"))

    def example_messages(e: Column) -> Column:
        return text.fill_chat(cfg.example, **{n: e[n] for n in ("first_table_row", "second_table_row", "ground_truth")})

    examples = F.flatten(F.transform("examples", example_messages))
    messages = text.fill_chat(
        cfg.prompt, examples=examples, first_table_row=F.col("first_table_row"),
        second_table_row=F.col("second_table_row"), ground_truth=label)
    return texts.select(
        "pair_id", F.lit(cfg.model).alias("model"), text.max_tokens(label, cfg.max_tokens_over_label).alias("max_tokens"),
        F.lit(float(cfg.temperature)).alias("temperature"), F.lit(cfg.request_seed).cast("bigint").alias("seed"),
        messages.alias("messages"))


def build_requests(texts: DataFrame, cfg: RequestConfig) -> DataFrame:
    """(pair_id, rows_match, first_table_row, second_table_row) to chat requests."""
    return chat_requests(attach_examples(texts, cfg.num_examples, cfg.draw_seed), cfg)


def pair_requests(pairs: DataFrame, sources: DataFrame, targets: DataFrame, cfg: RequestConfig) -> DataFrame:
    """Requests of (pair_id, rows_match, invoice_id, payment_id) from the row texts (invoice_id, first_table_row) and (payment_id, second_table_row).

    Only ids are numbered, drawn and written; each pair (its ``pair_id`` is unique) meets its two texts once, and examples are looked up among the pairs' texts."""
    pool = dense_id(pairs.select("rows_match", "pair_id", "invoice_id", "payment_id"), ["rows_match", "pair_id"], "_at")
    told = pool.join(targets, "payment_id").join(sources, "invoice_id")  # the text that travels to meet the other one is the payment's, which is shorter in all views
    if not cfg.num_examples:
        return chat_requests(attach_examples(told.select("pair_id", "rows_match", "first_table_row", "second_table_row"), 0, cfg.draw_seed), cfg)
    # labels come with the drawn numbers, so that both joins take the same three columns of the pairs' texts: they are made and dealt by pair_id once (a reused exchange)
    texts = told.select("pair_id", "first_table_row", "second_table_row")
    shown = pool.select("_at", F.col("pair_id").alias("_shown"))
    drawn = drawn_examples(pool, cfg.num_examples, cfg.draw_seed).withColumnRenamed("pair_id", "_of").join(shown, "_at").drop("_at").hint("merge")
    found = drawn.join(texts, F.col("_shown") == F.col("pair_id")).drop("_shown", "pair_id")
    # dealt before they are grouped: a request has few examples, so grouping them where they are found would sort all texts once more and save nothing
    lists = found.repartition("_of").groupBy("_of").agg(F.any_value("rows_match").alias("rows_match"), F.array_sort(
        F.collect_list(F.struct("o", "first_table_row", "second_table_row", "label"))).alias("_e"))
    example = lambda e: F.struct(e["first_table_row"], e["second_table_row"], text.yes_no(e["label"]).alias("ground_truth"))
    rows = texts.join(lists, F.col("pair_id") == F.col("_of")).withColumn("examples", F.transform("_e", example))
    return chat_requests(rows.drop("_of", "_e"), cfg)


def chat_from_turns(turns: DataFrame, key: str, turn: str, role: str, content: str) -> DataFrame:
    """Turns of a dialogue to one ordered message list: a request holds its whole dialogue, so a row is as long as that is."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"),
                                                   F.col(content).alias("content"))))
    return (turns.groupBy(key).agg(ordered.alias("_turns"))
            .withColumn("messages", F.transform("_turns", lambda s: F.struct(s["role"], s["content"]))
                        .cast(text.MESSAGES)).drop("_turns"))


