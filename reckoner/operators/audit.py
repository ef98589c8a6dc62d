"""Checks before and after a run: cache, model limits, token bounds, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reckoner.functions import text
from reckoner.functions.money import cost
from reckoner.schema import RESPONSES

# Fixed values: (model, kind, dollars per 1,000 input and output tokens, context size, output limit).
MODEL_CATALOGUE = (
    ("gpt-3.5-turbo-1106", "chat", 0.0010, 0.0020, 16385, 4096),
    ("gpt-4o-2024-08-06", "chat", 0.00250, 0.01000, 128000, 16384),
    ("gpt-4o-mini-2024-07-18", "chat", 0.000150, 0.000600, 128000, 16384),
)
MODEL_COLUMNS = ("model string, chat_or_completion string, cost_per_1k_input_tokens double, "
                 "cost_per_1k_output_tokens double, max_context int, max_output_tokens int")


def model_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODEL_CATALOGUE), MODEL_COLUMNS)


def with_model(df: DataFrame, models: DataFrame) -> DataFrame:
    """Attach prices and limits of each row's model; an unknown model raises. The catalogue has one row per model."""
    joined = df.join(models, "model", "left")
    unknown = F.raise_error(F.concat(F.lit("unknown model "), F.col("model")))
    needed = ("cost_per_1k_input_tokens", "cost_per_1k_output_tokens", "max_context")
    return joined.withColumns({c: F.coalesce(c, unknown.cast(models.schema[c].dataType)) for c in needed})


def with_hash(requests: DataFrame) -> DataFrame:
    json = text.request_json(requests.columns)
    return requests.withColumns({"request_json": json, "hash": text.request_hash(json)})


def lookup_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Attach the cached response (NULL if none). A hash hit counts only if the request text is equal; a request that is cached
    twice meets one answer, the least in text order."""
    hits = cache.groupBy("hash", F.col("request").alias("_cached")).agg(F.min("response").alias("cached_response"))
    same = (requests["hash"] == hits["hash"]) & (requests["request_json"] == hits["_cached"])
    return requests.join(hits, same, "left").drop(hits["hash"]).drop("_cached")


STATES = ("hit", "stale", "miss")


def split_by_cache(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` (with hash and text) and what the cache knows of them, from one join that reads the cache once: ``state`` is ``hit`` with the ``cached_response``,
    ``stale`` if the hash is held under another text only, else ``miss``.

    The cache's rows of one hash become one row first, a map of its texts (one, unless texts collide or are stale) to their least responses. A cache
    written by ``tables.cache_table`` is bucketed by hash: neither step shuffles it."""
    texts = cache.groupBy("hash", "request").agg(F.min("response").alias("response"))
    per_hash = texts.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("request", "response"))).alias("_known"))
    held = F.col("_known").isNotNull()
    known = F.when(held, F.map_contains_key(F.col("_known"), F.col("request_json"))).otherwise(F.lit(False))
    return (requests.join(per_hash, "hash", "left")
            .withColumns({"cached_response": F.when(known, F.element_at("_known", F.col("request_json"))),
                          "state": F.when(known, STATES[0]).when(held, STATES[1]).otherwise(STATES[2])})
            .select(*requests.columns, "state", "cached_response"))


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that have to be run."""
    same = (requests["hash"] == cache["hash"]) & (requests["request_json"] == cache["request"])
    return requests.join(cache, same, "left_anti")


def _field(df: DataFrame, name: str, type_: str) -> Column:
    return F.col(name).cast(type_) if name in df.columns else F.lit(None).cast(type_)


def usage_bounds(requests: DataFrame) -> DataFrame:
    """Upper bounds of tokens used by requests that carry their model's limits.

    Output is bounded by the request's own limit or, without one, by what is left of the context;
    both sides count once per requested answer (``best_of``, else ``n``)."""
    tokens = text.message_tokens(F.col("messages"))
    limit = F.coalesce(_field(requests, "max_completion_tokens", "bigint"), _field(requests, "max_tokens", "bigint"))
    answers = F.coalesce(_field(requests, "best_of", "bigint"), _field(requests, "n", "bigint"), F.lit(1))
    left = F.greatest(F.lit(0).cast("bigint"), F.col("max_context") - F.col("input_tokens"))
    return (requests.withColumn("input_tokens", tokens)
            .withColumn("output_tokens", F.coalesce(limit, F.least(F.col("max_output_tokens").cast("bigint"), left)))
            .withColumns({"max_input_usage": answers * F.col("input_tokens"),
                          "max_output_usage": answers * F.col("output_tokens")}))


def max_cost(bounded: DataFrame) -> Column:
    """Upper bound of the cost of a request that carries usage bounds and prices."""
    return (cost(F.col("max_input_usage"), F.col("cost_per_1k_input_tokens"))
            + cost(F.col("max_output_usage"), F.col("cost_per_1k_output_tokens")))


def validate_requests(bounded: DataFrame) -> DataFrame:
    """Add ``issues``, codes of what is wrong or unusual in a request with usage bounds."""
    both = _field(bounded, "max_tokens", "bigint").isNotNull() & \
        _field(bounded, "max_completion_tokens", "bigint").isNotNull()
    limit = F.coalesce(_field(bounded, "max_completion_tokens", "bigint"), _field(bounded, "max_tokens", "bigint"))
    temperature = _field(bounded, "temperature", "double")
    checks = {
        "input_exceeds_context": F.col("input_tokens") > F.col("max_context"),
        "two_output_limits": both,
        "limit_exceeds_model": limit > F.col("max_output_tokens"),
        "total_exceeds_context": F.col("input_tokens") + limit > F.col("max_context"),
        "no_seed": _field(bounded, "seed", "bigint").isNull(),
        "temperature_not_zero": temperature.isNull() | (temperature != 0),
    }
    codes = F.array(*[F.when(bad, F.lit(code)) for code, bad in checks.items()])
    return bounded.withColumn("issues", F.filter(codes, lambda c: c.isNotNull()))


def audit_requests(requests: DataFrame, cache: DataFrame, models: DataFrame) -> DataFrame:
    """Hash, cache state, token bounds, cost bound and issues of each request."""
    known = split_by_cache(with_hash(requests), cache)
    checked = validate_requests(usage_bounds(with_model(known, models)))
    return checked.withColumns({"cached": F.col("state") == STATES[0], "max_cost": max_cost(checked)}).drop("state")


def total_max_cost(audited: DataFrame) -> DataFrame:
    """Bound of what running the uncached requests may cost."""
    return audited.where(~F.col("cached")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("max_cost").alias("max_cost"))


def response_cost(responses: DataFrame, models: DataFrame) -> DataFrame:
    """Cost of each response; failed ones and missing token counts cost nothing."""
    priced = with_model(responses, models)

    def side(tokens: str, price: str) -> Column:
        return cost(F.coalesce(F.col(f"usage.{tokens}"), F.lit(0)), F.col(price))

    spent = side("prompt_tokens", "cost_per_1k_input_tokens") + side("completion_tokens", "cost_per_1k_output_tokens")
    return priced.withColumn("cost", F.when(F.col("choices").isNotNull(), spent).otherwise(F.lit(0.0)))


def actual_cost(responses: DataFrame, models: DataFrame) -> DataFrame:
    """Tokens and dollars per model over responses, or over a whole cache (see ``cached_responses``)."""
    used = F.when(F.col("choices").isNotNull(), F.coalesce(F.col("usage.total_tokens"), F.lit(0))).otherwise(F.lit(0))
    return response_cost(responses, models).groupBy("model").agg(
        F.count(F.lit(1)).alias("responses"), F.sum(used).alias("total_tokens"), F.sum("cost").alias("cost"))


def cached_responses(cache: DataFrame) -> DataFrame:
    """Responses of a cache table as structs."""
    body = RESPONSES.replace("pair_id bigint, ", "")
    return cache.select("hash", F.from_json("response", body).alias("_r")).select("hash", "_r.*")
