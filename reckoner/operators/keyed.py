"""Joins of a table with values per key, where NULL is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def with_key_values(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the other columns of ``per_key``; a NULL key meets a NULL key. Without keys ``per_key`` has one row."""
    renamed = per_key.select(*[F.col(f"`{k}`").alias(f"_key_{i}") for i, k in enumerate(keys)],
                             *[F.col(f"`{c}`") for c in per_key.columns if c not in keys])
    same = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)), F.lit(True))
    return df.join(renamed, same, how).drop(*[f"_key_{i}" for i in range(len(keys))])
