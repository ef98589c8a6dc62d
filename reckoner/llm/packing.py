"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing looks at nothing but lengths, and pieces of one length are interchangeable. So
the packing of any number of documents is decided on the histogram of lengths (at most ``capacity``
rows): a segment tree over the remaining capacities finds the tightest open bin for each run of equal
pieces in logarithmic time, and the plan says which ranks of a length go to which bins. Ranks come
from (length, bucket) counts, so a length that a third of all pieces share is numbered by many tasks.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from reckoner.llm import tokens
from reckoner.llm.common import partitions, written_table

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity. ``tree`` is a segment tree: a node is true if a leaf below it,
    a remaining capacity, has open bins."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = np.zeros(2 * self.leaves, dtype=bool)
        self.runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # remaining: (first bin, bins)

    def push(self, remaining: int, first: int, n: int) -> None:
        if n and remaining:
            self.runs[remaining].append((first, n))
            self._mark(remaining, True)

    def pop(self, remaining: int) -> tuple[int, int]:
        run = self.runs[remaining].pop()
        if not self.runs[remaining]:
            self._mark(remaining, False)
        return run

    def _mark(self, leaf: int, value: bool) -> None:
        node = leaf + self.leaves
        self.tree[node] = value
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] or self.tree[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of ``length`` or more with an open bin."""
        node = length + self.leaves
        if self.tree[node]:
            return length
        while node > 1:  # up to the first ancestor with an open bin to the right, then down to its leftmost leaf
            if node % 2 == 0 and self.tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Best-fit decreasing for ``histogram`` (length: pieces): rows (length, low, high, first, offset): the
    pieces of that length with ranks low to high - 1 go to the bins from ``first`` on, each at ``offset``."""
    bins, used, rows = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = bins.tightest(length)
            first, n = (used, left) if remaining is None else bins.pop(remaining)
            space = capacity if remaining is None else remaining
            each = space // length  # equal pieces fill the tightest bin before they go to the next
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            for slot in range(each if full else 0):
                rows.append((length, rank, rank + full, first, capacity - space + slot * length))
                rank += full
            for slot in range(rest):
                rows.append((length, rank, rank + 1, first + full, capacity - space + slot * length))
                rank += 1
            taken = full + (rest > 0)
            bins.push(space - each * length, first, full)
            bins.push(space - rest * length, first + full, int(rest > 0))
            if remaining is None:
                used += taken
            else:
                bins.push(space, first + taken, n - taken)
            left -= full * each + rest
    return pd.DataFrame(rows, columns=["length", "low", "high", "first", "offset"], dtype="int64")


def pieces(docs: DataFrame, path: str, units: str, capacity: int = CAPACITY, with_ids: bool = False, kept_bytes: int = tokens.KEPT_BYTES) -> DataFrame:
    """Token pieces of every document: its ids and an end id, cut every ``capacity`` ids. ``path`` is the tokenizer file,
    ``units`` its cut (see tokens). NULL text is empty, so a document always has a piece; equal ``doc_id``s
    (or NULL ones) are documents of their own; other columns are not read. ``with_ids`` adds the ids. A worker keeps
    ``kept_bytes`` of encoded units."""
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokens.encoder(path, units, kept_bytes).encode
        for frame in frames:
            doc_ids, texts = frame["doc_id"].tolist(), frame["text"].tolist()
            for low, high in tokens.batches(texts):
                rows = []
                for doc, ids in zip(doc_ids[low:high], encode(texts[low:high])):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
                yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInPandas(cut, PIECES + ", ids binary" * with_ids))


def ranked(sized: DataFrame) -> DataFrame:
    """Add ``_rank``, the number (from 0) of a piece among those of its length. Buckets of a digest split each
    length; a bucket starts where the counts of those before it end."""
    n = partitions(sized.sparkSession)
    key = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in sized.columns]
    split = sized.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))
    order = Window.partitionBy("length", "_bucket").orderBy(*key)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (split.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
              .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return (split.withColumn("_row", F.row_number().over(order))
            .join(starts, ["length", "_bucket"])
            .withColumn("_rank", F.col("_start") + F.col("_row") - 1).drop("_bucket", "_row", "_start"))


def assign(sized: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``: the packing of best-fit decreasing.
    ``sized`` has the columns of PIECES and must give the same rows each time it is read. Repeated rows are pieces of their own; an empty table gives an
    empty table."""
    histogram = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    packing = plan(histogram, capacity)  # a row per length and run of bins, whatever the number of pieces
    runs = {length: (g["low"].to_numpy(), g["first"].to_numpy(), g["offset"].to_numpy()) for length, g in packing.groupby("length")}
    shared = sized.sparkSession.sparkContext.broadcast(runs)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), dtype="int64"), np.zeros(len(frame), dtype="int64")
            ranks = frame.pop("_rank").to_numpy()
            for length, at in frame.groupby("length").indices.items():
                low, first, start = shared.value[length]
                run = np.searchsorted(low, ranks[at], side="right") - 1
                sequence[at], offset[at] = first[run] + ranks[at] - low[run], start[run]
            yield frame.assign(sequence_id=sequence, offset=offset)

    return ranked(sized).mapInPandas(place, f"{_schema(sized)}, sequence_id long, offset long")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def pack(docs: DataFrame, path: str, units: str, capacity: int = CAPACITY, kept_bytes: int = tokens.KEPT_BYTES) -> DataFrame:
    """All documents packed: a row per piece with its place. Texts are encoded once; only sizes and digests are kept."""
    return assign(written_table(pieces(docs, path, units, capacity, kept_bytes=kept_bytes), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces with ``ids``: a group holds ``capacity`` ids at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("_parts")).select(
        "sequence_id", F.array_join(F.transform("_parts", lambda p: F.hex(p["ids"])), "").alias("_hex"),
        F.col("_parts.doc_id").alias("doc_ids")).select("sequence_id", F.unhex("_hex").alias("ids"), "doc_ids")
