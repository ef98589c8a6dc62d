"""Group totals and attributes that belong to a group, without holding a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from reckoner.functions.money import MONEY
from reckoner.operators.keyed import with_key_values


def split_group_total(df: DataFrame, group: str, total: str, weight: str, member: str, name: str) -> DataFrame:
    """Split each group's ``total`` over its rows by ``weight``: whole cents that add up exactly.

    Weights that sum to zero count as equal. Every row is rounded down, and the row with the highest ``member`` takes what is left. Only sums
    and maxima per group are shuffled, a group of any size is never put together. Give ``weight`` as
    DECIMAL: its sum is then the same in any order of rows."""
    sums = df.groupBy(group).agg(F.sum(weight).cast("double").alias("_weights"), F.max(member).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    cents = (F.col(total) * F.lit(100)).cast("bigint")
    equal = cents.cast("double") / F.col("_rows")
    share = F.coalesce(F.try_divide(cents.cast("double") * F.col(weight).cast("double"), F.col("_weights")), equal)
    floored = with_key_values(df, sums, [group]).withColumn("_cents", F.floor(share))
    is_last = F.col(member) == F.col("_last")
    used = floored.groupBy(group).agg(F.sum(F.when(~is_last, F.col("_cents"))).alias("_used"))
    left = cents - F.coalesce(F.col("_used"), F.lit(0))
    part = F.when(is_last, left).otherwise(F.col("_cents"))
    return (with_key_values(floored, used, [group])
            .withColumn(name, (part.cast("decimal(18,0)") / F.lit(100).cast("decimal(3,0)")).cast(MONEY))
            .drop("_weights", "_rows", "_last", "_cents", "_used"))


def group_totals(df: DataFrame, group: str, amount: str, day: str) -> DataFrame:
    """Number of rows, total amount and latest date per group."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(amount).cast(MONEY).alias("total_amount"), F.max(day).alias("last_date"))


def first_hit(df: DataFrame, dimension: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """Look up ``value`` by ``key`` in a dimension with repeated keys: the lowest position wins, rows
    are never multiplied, and a key that is not listed raises."""
    hits = dimension.groupBy(key).agg(F.min_by(value, position).alias("_hit"))
    joined = df.join(hits, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string")))
    return joined.withColumn(value, F.coalesce(F.col("_hit"), missing.cast(dimension.schema[value].dataType))
                             ).drop("_hit")


def with_sorted_members(df: DataFrame, keys: Sequence[str], order: str, struct: Sequence[str], name: str) -> DataFrame:
    """Ordered struct list of groups that are small by construction (examples of a request, turns)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *struct))).alias(name))
