"""Dense ids and running totals over a whole table, without a one-partition sort.

The rows are range-partitioned by their order, each range numbers its own rows, and a small table
with one row per range carries the totals of the ranges before it. The ranges come from a sample,
so the partitioned rows are written once before they are numbered: every later step, and every
retry of a lost task, sees the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reckoner.operators.keyed import with_key_values
from reckoner.session import STORED, written_table

SLICE_SHIFT = 33  # monotonically_increasing_id: partition number above, row number below


def _slices(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` in ranges of ``order``, with ``_slice`` and the row number ``_row`` (from 0) in it."""
    ranged = (df.repartitionByRange(_slices(df), *order).sortWithinPartitions(*order)
              .withColumn("_at", F.monotonically_increasing_id()))
    return (written_table(ranged, "ranges", STORED)
            .withColumn("_slice", F.shiftright("_at", SLICE_SHIFT))
            .withColumn("_row", F.col("_at").bitwiseAND(F.lit(2**SLICE_SHIFT - 1)))
            .drop("_at"))


def _with_offsets(df: DataFrame, slice_col: str, per_slice: Column) -> DataFrame:
    """Add ``_before``, the sum of ``per_slice`` over earlier slices. The window has one row per
    slice, and so has the broadcast table: both are bounded by the number of partitions."""
    earlier = Window.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    totals = (df.groupBy(slice_col).agg(per_slice.alias("_total"))
              .select(slice_col, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before")))
    return df.join(F.broadcast(totals), slice_col)


def dense_id(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Add the position (from 0) of each row in the order of unique key columns ``order``."""
    numbered = _with_offsets(_numbered(df, order), "_slice", F.count(F.lit(1)))
    return (numbered.withColumn(name, (F.col("_before") + F.col("_row")).cast("bigint"))
            .drop("_slice", "_row", "_before"))


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str = "before") -> DataFrame:
    """Add the total of ``value`` over all rows before this one in the order of ``order``."""
    within = (Window.partitionBy("_slice").orderBy("_row")
              .rowsBetween(Window.unboundedPreceding, -1))
    summed = _with_offsets(_numbered(df, order), "_slice", F.sum(value))
    return (summed.withColumn(name, (F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0)))
                              .cast("bigint"))
            .drop("_slice", "_row", "_before"))


SLICE_ROWS, GROUP_SLICES = 10_000, 10_000  # numbers in a slice, and slices in a group


def running_totals_dense(df: DataFrame, id_col: str, values: Sequence[str]) -> DataFrame:
    """Running totals ``<value>_before`` in the order of unique numbers ``id_col`` that fill 0..n-1, or that start ranges filling it: slices
    are ranges of SLICE_ROWS numbers, so nothing is sampled or written. Slices add up in groups, and groups in one window with a
    row per hundred million numbers. Keeps ``_slice`` for later grouping on it."""
    sliced = df.withColumn("_slice", F.floor(F.col(id_col) / F.lit(SLICE_ROWS)))
    totals = sliced.groupBy("_slice").agg(*[F.sum(v).alias(f"_t_{v}") for v in values]).withColumn(
        "_group", F.floor(F.col("_slice") / F.lit(GROUP_SLICES)))

    def before(order: str, total: str, *within: str) -> Column:
        window = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(total).over(window), F.lit(0))

    groups = totals.groupBy("_group").agg(*[F.sum(f"_t_{v}").alias(f"_t_{v}") for v in values]).select(
        "_group", *[before("_group", f"_t_{v}").alias(f"_g_{v}") for v in values])
    totals = totals.select("_slice", "_group", *[before("_slice", f"_t_{v}", "_group").alias(f"_s_{v}") for v in values]).join(
        groups, "_group").select("_slice", *[(F.col(f"_s_{v}") + F.col(f"_g_{v}")).alias(f"_b_{v}") for v in values])
    out = sliced.join(totals, "_slice")
    for v in values:
        out = out.withColumn(f"{v}_before", (F.col(f"_b_{v}") + before(id_col, v, "_slice")).cast("bigint"))
    return out.drop(*[f"_b_{v}" for v in values])


def limit_at_group(df: DataFrame, order: Sequence[str], size: str, n: int) -> DataFrame:
    """Keep whole groups (one row each) until ``n`` is reached: a group stays when fewer than ``n``
    rows come before it, so the last one may run over."""
    return running_total(df, order, size, "_rows_before").where(F.col("_rows_before") < n).drop("_rows_before")


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the lowest ``order`` of each key, by a partial aggregate that holds one row."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
    return first.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def position_in_group(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Position (from 0) of a row in its group. Group and order together are unique and cut the ranges,
    so that a group with a third of all rows is numbered by many tasks."""
    whole = dense_id(df, [*group, *order], "_index")
    starts = whole.groupBy(*group).agg(F.min("_index").alias("_start"))
    return (with_key_values(whole, starts, group).withColumn(name, F.col("_index") - F.col("_start"))
            .drop("_index", "_start"))
