"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks.

Vectors are normalised, so a cosine bound is a bound on the Euclidean distance. In each of several tables a vector is filed under
HASHES quantised random projections. Vectors that meet in a bucket are candidates if short sign sketches do not
rule them out; each bucket sends a spanning forest of its candidates. The candidates' connected components are small sets in which
every true link lies, and in them all cosines are decided exactly: members within half the angle of the component's centre are linked with each other
for certain (the triangle inequality on the sphere), and only the other members are compared, in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from reckoner.llm.common import partitions, written_table
from reckoner.llm.components import components

COSINE = 0.95
TABLES, HASHES, WIDTH = 24, 8, 1.0  # recall of a pair at cosine 0.95: 1 - (1 - p^HASHES)^TABLES, see recall()
SKETCH_BITS = 128
SKETCH_SLACK = 5.0  # standard deviations of the sketch distance at the bound that still pass: 3e-7 of the pairs at the bound are lost
TILE = 32
SEED = 20_240_611


def recall(cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> float:
    """Chance that a pair with that cosine meets in a table (Datar et al., p-stable hashing for the normal distribution)."""
    r = math.sqrt(2 - 2 * cosine)
    if r == 0:
        return 1.0
    t = width / r
    p = math.erf(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))
    return 1 - (1 - p**hashes) ** tables


def unit(frame: pd.DataFrame) -> np.ndarray:
    """Normalised vectors in double precision."""
    v = np.array(frame["v"].tolist(), dtype="float64").reshape(len(frame), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _good(name: str) -> Column:
    finite = F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(name).isNotNull() & finite & F.exists(name, lambda x: x != 0)


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2): vectors that are not NULL, empty or zero and hold only finite numbers, and two digests."""
    return rows.where(_good("embedding")).select(F.col("vec_id").cast("long"), F.col("embedding").alias("v")).select(
        "*", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"))


def filed(classes: DataFrame, tables: int, hashes: int, width: float) -> DataFrame:
    """(key, id, s0, s1) per table: the bucket and the sketch. Vectors of different dimensions never share a bucket."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {}
        for frame in frames:
            for dim, part in frame.groupby(frame["v"].map(len)):
                if dim not in made:
                    rng = np.random.default_rng([SEED, int(dim)])
                    made[dim] = (rng.standard_normal((dim, tables * hashes)), rng.uniform(0, width, tables * hashes),
                                 rng.integers(1, 2**63, tables * hashes, dtype="uint64") | np.uint64(1), rng.standard_normal((dim, SKETCH_BITS)))
                directions, shift, odd, signs = made[dim]
                for at in range(0, len(part), 2_000):
                    some = part.iloc[at:at + 2_000]
                    x = unit(some)
                    cells = np.floor((x @ directions + shift) / width).astype("int64").view("uint64") * odd
                    key = cells.reshape(len(x), tables, hashes).sum(axis=2, dtype="uint64")
                    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.arange(tables, dtype="uint64")
                    sketch = np.packbits(x @ signs > 0, axis=1).view("int64")
                    yield pd.DataFrame({"key": key.view("int64").ravel(), "id": np.repeat(some["id"].to_numpy(), tables),
                                        "s0": np.repeat(sketch[:, 0], tables), "s1": np.repeat(sketch[:, 1], tables)})

    return classes.select("id", "v").mapInPandas(run, "key long, id long, s0 long, s1 long")


def sketch_limit(cosine: float) -> int:
    """Sketch bits in which a pair at the bound may differ."""
    p = math.acos(cosine) / math.pi
    return math.ceil(SKETCH_BITS * p + SKETCH_SLACK * math.sqrt(SKETCH_BITS * p * (1 - p)))


def bucket_forest(frames: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """Edges (a, b) from rows sorted by key. The rows of a bucket are taken one by one against the roots so far: a member that passes with a root
    joins it, so tight groups cost a comparison per member; what is left apart is compared with all."""
    held = None

    def edges(frame: pd.DataFrame) -> pd.DataFrame:
        key, out = frame["key"].to_numpy(), []
        ids, s0, s1 = frame["id"].to_numpy(), frame["s0"].to_numpy(dtype="int64").view("uint64"), frame["s1"].to_numpy(dtype="int64").view("uint64")
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1])) if len(key) else np.zeros(0, dtype="int64")
        ends = np.append(starts[1:], len(key)) if len(key) else starts
        for low, high in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
            left = np.arange(low, high)
            while len(left) > 1:  # all that are near to the first, and to what came near it, make one group
                group, left, at = [left[0]], left[1:], 0
                while at < len(group) and len(left):
                    near = np.bitwise_count(s0[left] ^ s0[group[at]]) + np.bitwise_count(s1[left] ^ s1[group[at]]) <= limit
                    out += [(ids[group[at]], ids[j]) for j in left[near]]
                    group += left[near].tolist()
                    left, at = left[~near], at + 1
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        cut = int(np.searchsorted(frame["key"].to_numpy(), frame["key"].iloc[-1])) if len(frame) else 0
        yield edges(frame.iloc[:cut])
        held = frame.iloc[cut:]
    if held is not None:
        yield edges(held)


def _forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the links of one tile."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for x, y in links:
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def centres(members: DataFrame) -> DataFrame:
    """(root, _pivot): the sum of the normalised vectors of each component. A task sends one sum per component."""
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(root, unit(part).sum(axis=0)) for root, part in frame.groupby("root")]
            yield pd.DataFrame(rows, columns=["root", "v"])

    sums = members.select("root", "v").mapInPandas(add, "root long, v array<double>").select("root", F.posexplode("v").alias("at", "x"))
    per_axis = sums.groupBy("root", "at").agg(F.sum("x").alias("x"))
    return per_axis.groupBy("root").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("p")).select("root", F.col("p.x").alias("_pivot"))


def exact(members: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Links within components. ``members``: (root, id, n, v), n the number of vectors that class stands for. Returns (id, linked), the vectors of other classes
    it is linked with, summed, and edges (a, b) that span the links."""
    spark = members.sparkSession
    half = math.cos(math.acos(cosine) / 2) + 1e-12
    pivots = centres(members)
    dot = F.aggregate(F.zip_with("v", "_pivot", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    placed = members.join(pivots, "root").withColumn("core", dot / (norm("v") * norm("_pivot")) >= F.lit(half)).drop("_pivot")
    placed = written_table(placed, "component-members")
    core = placed.where("core").groupBy("root").agg(F.sum("n").alias("core_n"), F.min("id").alias("lead"))
    # members outside of the core against all: rim rows in blocks of a tile, every row once per block
    rim = placed.where("not core").groupBy("root").agg(F.count(F.lit(1)).alias("rim_n"))
    blocks = F.ceil(F.col("rim_n") / TILE).cast("int")
    width = F.ceil(F.col("all_n") / TILE).cast("int")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("all_n")).join(rim, "root")
    spread = placed.join(sizes, "root")
    mine = F.pmod(F.xxhash64("id", F.lit(1)), blocks).cast("int")  # the block of a rim row
    other = F.pmod(F.xxhash64("id", F.lit(2)), width).cast("int")  # the column of any row
    left = spread.where("not core").select("root", "id", "n", "v", mine.alias("i"), F.explode(F.sequence(F.lit(0), width - 1)).alias("j"), F.lit(True).alias("rim"), F.lit(False).alias("core"))
    right = spread.select("root", "id", "n", "v", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"), other.alias("j"), F.lit(False).alias("rim"), "core")
    columns = ["root", "i", "j", "id", "n", "v", "rim", "core"]
    tiles = left.select(*columns).union(right.select(*columns)).repartition(partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "id")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def tile(t: pd.DataFrame) -> pd.DataFrame:
            out = []
            rim, every = t[t["rim"]], t[~t["rim"]]
            if len(rim) and len(every):
                hit = np.einsum("id,jd->ij", unit(rim), unit(every)) >= cosine
                left, right = rim["id"].to_numpy(), every["id"].to_numpy()
                hit &= left[:, None] != right[None, :]
                # a row outside of the core counts all its links; a row of the core those outside of it
                out += [(i, int(k), None, None) for i, k in zip(left, hit @ every["n"].to_numpy()) if k]
                out += [(i, int(k), None, None) for i, k, c in zip(right, rim["n"].to_numpy() @ hit, every["core"]) if k and c]
                out += [(None, None, x, y) for x, y in _forest([(left[x], right[y]) for x, y in np.argwhere(hit)])]
            return pd.DataFrame(out, columns=["id", "linked", "a", "b"], dtype="Int64")

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = frame.iloc[-1] if len(frame) else None
            done = ~((frame["root"] == last["root"]) & (frame["i"] == last["i"]) & (frame["j"] == last["j"])) if last is not None else []
            held = frame[~done] if last is not None else frame
            for _, t in frame[done].groupby(["root", "i", "j"]) if last is not None else ():
                yield tile(t)
        if held is not None and len(held):
            yield tile(held)

    met = written_table(tiles.mapInPandas(compare, "id long, linked long, a long, b long"), "tiles")
    inside = placed.where("core").join(core, "root").select("id", (F.col("core_n") - F.col("n")).alias("linked"))
    linked = inside.union(met.where("id is not null").select("id", "linked")).groupBy("id").agg(F.sum("linked").alias("linked"))
    edges = met.where("a is not null").select("a", "b").union(placed.where("core").join(core, "root").where("id != lead").select(F.col("lead").alias("a"), F.col("id").alias("b")))
    return linked, edges


def linked(rows: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``rows`` (vec_id, embedding). Invalid vectors (NULL, empty, zero, with NULL or non-finite numbers) link with nothing. Equal vectors are one
    class throughout and linked with each other; repeated rows are vectors of their own. A vector with vec_id NULL counts as a link, and has a NULL component_id only if
    nothing with an id is reachable."""
    good = valid(rows)
    classes = good.groupBy("v", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = written_table(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")  # ids are fixed once written
    buckets = filed(classes, tables, hashes, width).repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "id")
    limit = sketch_limit(cosine)
    candidates = components(buckets.mapInPandas(lambda frames: bucket_forest(frames, limit), "a long, b long"))
    members = candidates.join(classes, candidates["node"] == classes["id"]).select("root", "id", "n", "v")
    links, edges = exact(members, cosine)
    roots = components(edges)
    tied = (classes.select("id", "h1", "h2", "n", "first").join(roots, F.col("id") == roots["node"], "left")
            .join(links.withColumnRenamed("id", "_linked"), F.col("id") == F.col("_linked"), "left")
            .select("h1", "h2", "n", "first", F.coalesce("root", "id").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked")))
    least = tied.groupBy("root").agg(F.min("first").alias("component"))
    by_class = tied.join(least, "root").select("h1", "h2", (F.col("n") - 1 + F.col("linked")).alias("links"), "component")
    keyed = good.select("vec_id", "h1", "h2").join(by_class, ["h1", "h2"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    bad = rows.where(~F.coalesce(_good("embedding"), F.lit(False))).select(F.col("vec_id").cast("long"))
    return keyed.union(bad.select("vec_id", F.lit(0).cast("long"), F.col("vec_id").alias("_own"))).select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
