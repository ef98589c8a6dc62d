"""Standard error of F1 by bootstrapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from reckoner.functions.draws import binomial, u01
from reckoner.operators.confusion import COUNTS, confusion_aggs, f1
from reckoner.operators.keyed import with_key_values


def bootstrap_f1(counts: DataFrame, keys: Sequence[str], rounds: int = 1000, seed: int = 0) -> DataFrame:
    """``counts`` with ``f1_se``: drawing n rows with replacement is one multinomial draw over the
    four counts, made of three binomial draws, so the cost is groups x rounds whatever the number of rows. Draws are keyed by the group's
    keys and the round; a group without rows has a NULL error."""
    total = sum((F.col(c) for c in COUNTS), F.lit(0))
    key = F.concat_ws("|", *[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")) for k in keys], F.lit(""))
    slim = counts.select(*keys, *COUNTS, total.alias("_n"), key.alias("_key")).where("_n > 0")
    # a few groups in one task become groups x rounds in all of them: the number of partitions is given, so that small ones are not put together again
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = slim.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).repartition(n, "_key", "_round")
    left, weight = F.col("_n"), F.col("_n")  # rows still to be drawn, and their outcomes' counts together
    for c in COUNTS[:3]:
        share = F.when(weight > 0, F.col(c) / weight).otherwise(F.lit(0.0))
        out = out.withColumn(f"_{c}", binomial(left, share, seed, f"boot.{c}", "_round", "_key"))
        left, weight = left - F.col(f"_{c}"), weight - F.col(c)
    scored = out.withColumn("_f1", f1(F.col(f"_{COUNTS[0]}"), F.col(f"_{COUNTS[1]}"), left))
    errors = scored.groupBy(*keys, *COUNTS).agg(F.stddev_samp("_f1").alias("f1_se"))
    return with_key_values(counts, errors, [*keys, *COUNTS], "left")


def delta_f1_se(tp: Column, fp: Column, fn: Column) -> Column:
    """What the bootstrap estimates, in closed form by the delta method: the multinomial counts enter F1 through
    tp and fp + fn only, and their weighted slopes add up to zero."""
    missed, under = (fp + fn).cast("double"), (F.lit(2) * tp + fp + fn).cast("double")
    root = F.sqrt(tp.cast("double") * missed * (tp.cast("double") + missed))
    return F.when(under > 0, F.lit(2.0) * root / (under * under)).otherwise(F.lit(0.0))


def bootstrap_f1_rows(df: DataFrame, key: str, rounds: int, seed: int, row_key: str,
                      prediction: str = "prediction", truth: str = "truth") -> DataFrame:
    """The same row by row, keyed so that another engine can repeat it: in each round each row draws
    an outcome of its group in proportion to the group's counts. Draws are counted per task."""
    counts = df.groupBy(key).agg(*confusion_aggs(prediction, truth))
    total = sum((F.col(c) for c in COUNTS), F.lit(0))
    drawn = (with_key_values(df.select(key, row_key), counts, [key])
             .withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
             .withColumn("_at", F.floor(u01(seed, "boot", "round", row_key) * total)))
    upto_tp, upto_fp = F.col("TP"), F.col("TP") + F.col("FP")
    upto_tn = upto_fp + F.col("TN")
    at = F.col("_at")
    per_round = drawn.groupBy(key, "round").agg(
        F.count_if(at < upto_tp).alias("tp"), F.count_if((at >= upto_tp) & (at < upto_fp)).alias("fp"),
        F.count_if(at >= upto_tn).alias("fn"))
    return (per_round.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
            .groupBy(key).agg(F.count(F.lit(1)).alias("rounds"), F.stddev_samp("f1").alias("f1_se")))
