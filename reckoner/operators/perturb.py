"""Dirty any table: planted errors per row, chosen by keyed draws, recorded in the row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reckoner.functions import draws
from reckoner.functions.draws import u01
from reckoner.schema import PERTURBATION_MODES, check_mode


@dataclass(frozen=True)
class Perturbation:
    """``apply`` maps (column, seed, tag, key column name) to the dirty column."""
    category: str
    column: str
    apply: Callable[[Column, int, str, str], Column]
    weight: float = 1.0


def perturb(df: DataFrame, spec: Sequence[Perturbation], key: str, mode: str = "single",
            probability: float = 0.75, seed: int = 0) -> DataFrame:
    """Dirty each row with the given probability: by one error (``single``) or by a weighted set of
    different ones (``multi``). Adds ``perturbation_categories``, empty for a clean row."""
    check_mode(mode, PERTURBATION_MODES, "perturbation mode")
    names, weights = [p.category for p in spec], [p.weight for p in spec]
    if mode == "single":
        chosen = F.array(draws.weighted(names, weights, u01(seed, "error", key)))
    else:
        size = draws.uint(1, len(names), u01(seed, "n_errors", key))
        chosen = draws.weighted_subset(names, weights, size, seed, "errors", key)
    dirty = u01(seed, "dirty", key) < F.lit(probability)
    out = df.withColumn("perturbation_categories",
                        F.when(dirty, chosen).otherwise(F.array().cast("array<string>")))
    for p in spec:
        hit = F.array_contains("perturbation_categories", p.category)
        before = F.col(p.column)
        out = out.withColumn(p.column, F.when(hit, p.apply(before, seed, p.category, key)).otherwise(before))
    return out
