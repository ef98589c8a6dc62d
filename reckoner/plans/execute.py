"""Requests to responses: from the cache where they are known, from a scorer where they are not."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, functions as F

from reckoner.operators import audit
from reckoner.schema import RESPONSES
from reckoner.session import written_table
from reckoner.sources import tables

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Execution:
    """What a run did. ``split``: all requests with their state; ``responses`` of all of them; ``added``: rows that the cache lacks; ``counts``: requests, hits, stale rows and
    misses, failed and cut-off responses, taken from the job that wrote the responses."""
    split: DataFrame
    responses: DataFrame
    added: DataFrame
    counts: dict[str, int]


def execute(requests: DataFrame, cache: DataFrame, scorer: Scorer) -> Execution:
    """Run ``requests``. ``scorer`` turns requests into responses (pair_id, model, choices, usage; choices NULL if it failed)
    and is given what the cache does not answer, each distinct request once per pair_id. ``responses`` adds ``cached``.

    Requests meet the cache once; hits, misses and new rows are views of that written result. The scorer runs once, its answers are written."""
    states = Observation()
    split = written_table(audit.split_by_cache(audit.with_hash(requests), cache).observe(
        states, F.count(F.lit(1)).alias("requests"), *[F.count_if(F.col("state") == s).alias(s) for s in audit.STATES]), "split")
    misses = split.where(F.col("state") != audit.STATES[0]).drop("state", "cached_response")
    failed, cut = F.col("choices").isNull(), F.get(F.col("choices"), F.lit(0))["finish_reason"] == "length"
    answers = Observation()
    answered = written_table(scorer(misses).select("pair_id", "model", "choices", "usage").observe(
        answers, F.count_if(failed).alias("failed"), F.count_if(cut).alias("cut_off")), "answers")
    body = RESPONSES.replace("pair_id bigint, model string, ", "")
    hits = split.where(F.col("state") == audit.STATES[0]).withColumn("_r", F.from_json("cached_response", body)).select("pair_id", "model", "_r.choices", "_r.usage")
    responses = hits.withColumn("cached", F.lit(True)).union(answered.withColumn("cached", F.lit(False)))
    return Execution(split, responses, tables.new_cache_rows(misses, answered), {**states.get, **answers.get})
