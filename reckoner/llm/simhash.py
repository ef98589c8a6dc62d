"""Near-duplicates by SimHash fingerprints, compared in bit-sliced form.

Fingerprints within the radius agree in two of four 16-bit blocks (or more blocks for another radius), so they meet in one of the
buckets keyed by pairs of blocks. A bucket is stored vertically: a bit plane is one integer with a lane per
fingerprint. A query is compared with all lanes at once: the XOR of each plane is added to carry-save counters (one integer
per counter bit), lanes above the radius drop out, and a bucket is abandoned when none is left. A bucket sends
the edges of a spanning forest, never all its pairs.

A bucket with more than BUCKET fingerprints is not compared in one task. There the exact way for a radius of 2 is taken: both of
two such fingerprints are within one bit of a common value, so each is filed under itself and its 64 one-bit
changes. At most 65 fingerprints can meet under a value, whatever the size of the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from reckoner.llm.common import least_rows, partitions, whole_row, written_table
from reckoner.llm.components import components
from reckoner.llm.lines import split_words

BITS, RADIUS = 64, 2
SEED = 42  # of the hash of shingles (fixed value of the data contract)
SHINGLE = 3
BUCKET = 128
CHUNK = 100_000  # shingles that are hashed before their bits are added up
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the whole text: word shingles with repeats; fewer words make one shingle, none makes 0."""
    words = split_words((text or "").translate(LOWER))
    n = max(1, len(words) - shingle + 1) if words else 0
    total = np.zeros(BITS, dtype="int64")
    for at in range(0, n, CHUNK):
        hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i:i + shingle]), SEED) for i in range(at, min(n, at + CHUNK))), dtype="<u8")
        total += np.unpackbits(hashes.view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) per document, fp as a signed long."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fps = np.array([fingerprint(t, shingle) for t in frame["text"]], dtype="uint64").view("int64")
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "fp": fps})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, fp long")


def keys(fp: Column, radius: int = RADIUS) -> Column:
    """The buckets of a fingerprint: pairs of blocks. Of ``radius`` + 2 blocks, two at least are equal within the radius."""
    edges = [round(i * BITS / (radius + 2)) for i in range(radius + 3)]
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(i), block[x], block[y]) for i, (x, y) in enumerate(combinations(range(radius + 2), 2))])


def planes(fps: np.ndarray) -> list[int]:
    """Bit planes: bit j of plane k is bit k of fingerprint j."""
    bits = np.unpackbits(fps.astype("<u8").view("uint8").reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def above(counters: list[int], over: int, radius: int, lanes: int) -> int:
    """Lanes whose count is above ``radius``."""
    more, equal = over, lanes
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            more |= equal & counters[i]
            equal &= ~counters[i]
    return more


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the links among ``fps``, each fingerprint against the lanes after it."""
    m = len(fps)
    lanes = (1 << m) - 1
    sliced = [(k, p) for k, p in enumerate(planes(fps)) if p and p != lanes]  # equal bits add nothing
    parent, out, values = list(range(m)), [], [int(x) for x in fps.view("uint64")]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        alive = lanes & ~((2 << i) - 1)
        counters, over = [0] * radius.bit_length(), 0
        for k, plane in sliced:
            if not alive:
                break
            carry = (plane ^ lanes if value >> k & 1 else plane) & alive
            for c in range(len(counters)):
                counters[c], carry = counters[c] ^ carry, counters[c] & carry
            over |= carry
            alive &= ~above(counters, over, radius, alive)
        while alive:
            low = alive & -alive
            j = low.bit_length() - 1
            alive ^= low
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def bucket_edges(frames: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    """Edges (a, b) from rows (key, fp) in the order of key; a bucket may go over several frames."""
    held = pd.DataFrame({"key": pd.Series(dtype="int64"), "fp": pd.Series(dtype="int64")})

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        key, fp, out = frame["key"].to_numpy(), frame["fp"].to_numpy(), []
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else []
        for low, high in zip(starts, [*starts[1:], len(key)]):
            out += [(fp[low + i], fp[low + j]) for i, j in forest(fp[low:high], radius)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    for frame in frames:
        frame = pd.concat([held, frame], ignore_index=True)
        cut = int(np.searchsorted(frame["key"].to_numpy(), frame["key"].iloc[-1])) if len(frame) else 0
        yield edges(frame.iloc[:cut])
        held = frame.iloc[cut:]
    yield edges(held)


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp, without repeats) that span all links within ``radius``."""
    filed = distinct.select("fp", F.explode(keys(F.col("fp"), radius)).alias("key"))
    sizes = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written_table(filed.join(sizes, "key"), "buckets")
    n = partitions(distinct.sparkSession)
    small = (shared.where(F.col("n") <= bucket).select("key", "fp").repartition(n, "key").sortWithinPartitions("key", "fp")
             .mapInPandas(lambda frames: bucket_edges(frames, radius), "a long, b long"))
    large = shared.where(F.col("n") > bucket).select("fp").distinct()
    if radius != 2:
        if large.take(1):
            raise ValueError("buckets above the limit are exact for a radius of 2 only")
        return small
    changes = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(BITS)])
    met = large.select("fp", F.explode(changes).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a != b")
    return small.union(stars)


def rooted(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, root) for every different ``fp`` of the written table ``fps``: root is the least fingerprint that links reach from it."""
    distinct = written_table(fps.select("fp").distinct(), "distinct-fingerprints")
    roots = components(links(distinct, radius, bucket))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def grouped(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id, root) per document: component_id is the least doc_id among all documents reachable by links, root their least
    fingerprint. Equal fingerprints, those of empty texts (0) too, are linked. Repeated rows stay; a NULL doc_id never is a component_id unless nothing else
    is reachable."""
    fps = written_table(fingerprints(docs), "fingerprints")
    tied = rooted(fps, radius, bucket).join(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = tied.join(least, "root").select("fp", "component_id", "root")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id", "root")


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with one row per group of documents linked within ``radius``: that of its least doc_id (NULL last), ties by a digest of the text. Groups are told apart by
    their root fingerprint, as ids may be NULL or repeated; of repeated rows one stays. All columns stay. Texts without a word are one group. No rows give no rows.

    Groups and the rows to keep are found on (doc_id, digest, fingerprint); whole rows are shuffled once, to meet what is kept."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in series], dtype="uint64").view("int64"))

    fp, text = F.pandas_udf(run, "long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_digest")]
    slim = written_table(docs.select(*own, fp(text).alias("fp")), "fingerprints")
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_digest")
    rows = slim.groupBy("fp", "_id", "_digest").agg(F.count(F.lit(1)).alias("n"))
    per_fp = rows.groupBy("fp").agg(F.min(F.struct(order.alias("o"), "n")).alias("first"))  # many copies of a text are one row from here on
    first = per_fp.join(rooted(slim, radius, bucket), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = written_table(first.select(F.col("first.o._id").alias("_kept"), F.col("first.o._digest").alias("_of"), "first.n"), "kept-documents")
    whole = docs.select(whole_row(docs), *own)
    found = whole.join(kept, whole["_id"].eqNullSafe(kept["_kept"]) & (whole["_digest"] == kept["_of"]))
    if kept.where("n > 1").take(1):  # equal rows, of which one stays
        found = least_rows(found.select(F.struct("_id", "_digest").alias("key"), "row"), "key")
    return found.select("row.*")
