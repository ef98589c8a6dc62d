"""Pair decisions: a scorer gives each pair an answer, answers become predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reckoner.functions import text

Scorer = Column | Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

# Weights of the built-in rules; a pair is a match when the weights of its holding rules reach the threshold.
RULE_WEIGHTS = {"billing": 0.5, "assignment": 0.5, "near_id": 0.4, "amount": 0.3, "partner": 0.3, "dates": 0.1}
RULE_THRESHOLD = 0.55


def decide(pairs: DataFrame, scorer: Scorer) -> DataFrame:
    """Add ``response_text``: from a column expression, or from a batch function (for a model that
    runs in Python) over whole partitions of pairs."""
    if isinstance(scorer, Column):
        return pairs.withColumn("response_text", scorer.cast("string"))
    schema = T.StructType([*pairs.schema.fields, T.StructField("response_text", T.StringType())])
    return pairs.mapInPandas(scorer, schema)


def pair_rules(max_edits: int = 1, amount_tolerance: float = 0.2, name_distance: float = 0.4,
               source: str = "source", target: str = "target") -> dict[str, Column]:
    """The rules as boolean columns over invoice (source) and payment (target) structs."""
    inv = {a: F.col(f"{source}.inv_{a}") for a in ("billing_number", "assignment_number", "amount",
                                                   "customer_name", "document_date")}
    pay = {a: F.col(f"{target}.pay_{a}") for a in ("memo_line", "amount", "business_partner", "posting_date")}
    words = F.split(pay["memo_line"], " ")

    def near(identifier: Column) -> Column:
        return F.exists(words, lambda w: F.levenshtein(w, identifier, max_edits) >= 0)

    name_a, name_b = F.lower(inv["customer_name"]), F.lower(pay["business_partner"])
    longest = F.greatest(F.length(name_a), F.length(name_b))
    return {
        "billing": F.contains(pay["memo_line"], inv["billing_number"]),
        "assignment": F.contains(pay["memo_line"], inv["assignment_number"]),
        "near_id": near(inv["billing_number"]) | near(inv["assignment_number"]),
        "amount": F.abs(inv["amount"] - pay["amount"]) <= F.lit(amount_tolerance).cast("decimal(6,2)"),
        "partner": F.levenshtein(name_a, name_b) <= longest * F.lit(name_distance),
        "dates": pay["posting_date"] >= inv["document_date"],
    }


def rule_score(weights: Mapping[str, float] = RULE_WEIGHTS, **options) -> Column:
    """Sum of the weights of the rules that hold, in hundredths (whole numbers compare exactly)."""
    rules = pair_rules(**options)
    return sum((F.when(rules[n], F.lit(round(w * 100))).otherwise(F.lit(0)) for n, w in weights.items()), F.lit(0))


def rule_scorer(weights: Mapping[str, float] = RULE_WEIGHTS, threshold: float = RULE_THRESHOLD, **options) -> Column:
    """Answer Yes when the rules that hold reach the threshold."""
    return text.yes_no(rule_score(weights, **options) >= F.lit(round(threshold * 100)))


def attach_response(pairs: DataFrame, responses: DataFrame) -> DataFrame:
    """Join responses by pair id; a pair without a response row raises.

    The check sits in the ``choices`` column that every later step reads: as a filter it could be
    optimised away by a later test for NULL."""
    found = pairs.join(responses.withColumn("_found", F.lit(True)), "pair_id", "left")
    missing = F.raise_error(F.concat(F.lit("no response for pair "), F.col("pair_id").cast("string")))
    checked = F.when(F.col("_found"), F.col("choices")).otherwise(missing.cast(responses.schema["choices"].dataType))
    return found.withColumn("choices", checked).drop("_found")


def with_parsed(df: DataFrame, strip_punctuation: bool = False) -> DataFrame:
    """Add ``parsed``: the answer as true, false or NULL."""
    return df.withColumn("parsed", text.parse_yes_no("response_text", strip_punctuation))


def resolve(parsed: DataFrame, truth: str = "rows_match") -> DataFrame:
    """Add ``truth`` and ``prediction``; failed requests drop out, unread answers count as wrong."""
    return parsed.where(F.col("response_text").isNotNull()).withColumns({
        "truth": F.col(truth), "prediction": text.resolve_prediction(F.col("parsed"), F.col(truth))})


def score_responses(pairs: DataFrame, responses: DataFrame, strip_punctuation: bool = False) -> DataFrame:
    """Pairs and their raw responses to (truth, prediction)."""
    answered = attach_response(pairs, responses).withColumn("response_text", text.response_text(F.col("choices")))
    return resolve(with_parsed(answered, strip_punctuation))
