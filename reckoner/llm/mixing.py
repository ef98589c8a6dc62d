"""Mixing sources to target weights by Pareto order sampling.

A source's target words follow its weight, stop at ``max_repeat`` times its size, and the excess is shared out
again. A document is due target / size copies: the whole copies are certain, the fraction is its
inclusion probability. For the fractions, documents are ranked by random odds divided by inclusion odds, and
the first of them are taken up to the words that are still due: a sample of fixed size (in words) with unequal
probabilities. The order is cut into buckets of equal expected size (about the square root of the source's
documents), so no task orders a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from reckoner.functions.draws import u01
from reckoner.llm.common import whole_row, words, written_table
from reckoner.operators.ranks import dense_id

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 20_240_607
KEY = ["_source", "_none"]  # the source as text, and whether it is NULL


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, _digest, _source, _none, size): the words of each document; NULL text has none."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_digest"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"),
                       F.size(words(F.col("text").cast("string"))).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(_source, _none, source_size, n, target). Sources by code point, NULL last, weigh ``weights`` in turn; together they
    get all words. Each round adds up the sources that are at their limit; only those sums reach the driver."""
    per_source = sizes.groupBy(*KEY).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    numbered = dense_id(per_source, ["_none", "_source"], "_at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    sources = written_table(numbered.select(*KEY, "source_size", "n", weight.alias("_weight"),
                                            (F.col("source_size") * F.lit(float(max_repeat))).alias("_most")), "mix-sources")
    share: Column | None = None  # of the sources below their limit
    while True:
        at_limit = F.lit(False) if share is None else share > F.col("_most")
        total, full, rest = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(at_limit, F.col("_most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_limit, F.col("_weight"))), F.lit(0.0))).first()
        if rest == 0:  # all at their limit, or no source at all
            target = F.col("_most")
            break
        grown = F.lit(total - full) * F.col("_weight") / F.lit(rest)
        if share is not None and not sources.where(~at_limit & (grown > F.col("_most"))).take(1):
            target = F.when(at_limit, F.col("_most")).otherwise(grown)
            break
        share = grown
    return sources.select(*KEY, "source_size", "n", target.alias("target"))


def decide(sizes: DataFrame, per_source: DataFrame, seed: int = SEED) -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to the rows of ``sized``. The draw of a document is keyed by ``seed`` and doc_id
    (repeated ids and NULLs share theirs), so reruns agree; ties go by doc_id, digest and size. A document without words gets
    its certain copies only, and those of a source without words none."""
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = (sizes.join(per_source, KEY)
            .withColumn("_whole", F.floor(due)).withColumn("_p", due - F.floor(due))
            .withColumn("_u", u01(seed, "mix", "doc_id")))
    # a source that is due whole copies only draws no sample: its documents are ranked by nobody
    certain = rows.where(F.col("_p") == 0).withColumn("copies", F.col("_whole").cast("long"))
    rows = rows.where(F.col("_p") > 0)
    odds = F.col("_p") / (1 - F.col("_p"))
    # scaled by the odds of its source, the rank of a document is uniform again: buckets have equal expected size
    even = F.col("_rank") * odds / (1 + F.col("_rank") * odds)
    buckets = F.ceil(F.sqrt(F.col("n").cast("double")))
    rows = rows.withColumn("_rank", F.col("_u") / (1 - F.col("_u")) / odds).withColumn("_bucket", F.least(F.floor(even * buckets), buckets - 1).cast("long"))
    earlier = Window.partitionBy(*KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(*KEY, "_bucket").agg(F.sum("size").alias("_words"))
              .select(*KEY, "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start")))
    inside = (Window.partitionBy(*KEY, "_bucket").orderBy("_rank", "doc_id", "_digest", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    taken = (F.col("size") > 0) & (before + F.col("size") / 2 <= F.col("target") - F.col("_whole") * F.col("source_size"))
    drawn = rows.join(starts, [*KEY, "_bucket"]).withColumn("copies", (F.col("_whole") + taken.cast("long")).cast("long"))
    columns = ["doc_id", "_digest", *KEY, "size", "source_size", "target", "copies"]
    return drawn.select(*columns).union(certain.select(*columns))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """A row per document (doc_id, _digest, _source, _none, size, source_size, target, copies): how often the mix takes it. Only doc_id, text and source are
    read; NULL sources are one source, empty tables give no rows."""
    sizes = written_table(sized(docs), "mix-sizes")
    return decide(sizes, targets(sizes, weights, max_repeat), seed)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` with all its columns, each row as often as the mix takes it. Rows with the same doc_id and text are
    told apart by their number only."""
    per_row = (mix(docs, **options).groupBy(F.col("doc_id").alias("_doc"), "_digest")
               .agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")))
    left = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"))
    found = left.join(per_row, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_digest")))
    even = F.floor(F.col("_copies") / F.col("_rows"))
    number = F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.lit(0)))  # of repeated rows whose copies cannot be shared out evenly
    odd = found.where(F.col("_copies") % F.col("_rows") != 0).withColumn("_times", even + (number <= F.col("_copies") % F.col("_rows")).cast("long"))
    both = found.where(F.col("_copies") % F.col("_rows") == 0).withColumn("_times", even).union(odd)
    return (both.withColumn("_times", F.col("_times").cast("int")).where(F.col("_times") > 0)
            .select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*"))
