"""Hard-negative mining by cover trees over norm-augmented candidates.

Scores are inner products of integer vectors. A candidate x gets one further coordinate, sqrt(M^2 - |x|^2), so that all lie on a sphere of radius M and a query
(with 0 there) sees the largest product nearest. Candidates go to the nearest of a bounded number of pivots, a pivot's candidates to blocks of about BLOCK rows, and
every block grows a cover tree: level i holds points more than 2^i apart that cover all others within 2^i, each point hangs below one of the level above. A cell is
a node together with what hangs below it at a level and under it; its covering radius, an angle on the sphere, bounds the products of all of it from both
sides. A search descends best-first: the cell with the highest upper bound is opened next, cells that lie outside of every window asked for, or below
the k-th best found so far, are skipped, and every point met is scored exactly. Queries first search the block they lie in; what they find there is the
bound under which whole pivots and blocks of the others are skipped.

Defined results: rows with a NULL label, a NULL vector or a component that is NULL or not finite take no part. Components count as at most 2^24 in size, so that every
score is an exact long. Vectors of different lengths never meet; empty vectors score 0 with each other. Repeated rows, also those with equal ids, are rows of
their own; a row without an id is no anchor and comes last among equal scores. No rows give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from reckoner.llm.common import digest_sample, partitions, written_table

PIVOTS = 16  # about so many rows are drawn as pivots, whatever the number of rows
BLOCK = 2048  # rows of a block, about
ANCHORS = 1024  # queries that search a block in one group, about
LARGEST = 2**24
NOWHERE = -(2**62)
EXACT = 2**53  # products below are exact in double precision
KEYS = ["dim", "pivot", "sub"]
HIT = "uid long, window int, cand long, cand_id long, score long"


def _matrix(vectors: Sequence, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, dtype="int64") for v in vectors], dtype="int64").reshape(len(vectors), dim)


class Products:
    """Exact integer inner products with the rows of ``x``: in double precision where no sum can leave its whole numbers."""

    def __init__(self, x: np.ndarray):
        self.x, self.fast, self.most = x, x.astype("float64"), float(np.abs(x).max(initial=0)) * max(1, x.shape[1])

    def of(self, q: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        """The products of ``q`` with the rows asked for."""
        if self.most * float(np.abs(q).max(initial=0)) < EXACT:
            quick = q.astype("float64")
            return lambda rows: (self.fast[rows] @ quick).astype("int64")
        return lambda rows: self.x[rows] @ q


def angles(score: np.ndarray, size: float, top: float) -> np.ndarray:
    """Angles between a query of that norm and points of the sphere with that inner product."""
    return np.arccos(np.clip(score / (size * top), -1, 1)) if size * top > 0 else np.zeros(np.shape(score))


def bounds(score: np.ndarray, radius: np.ndarray, size: float, top: float) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the products of all points within the angle ``radius`` of points with that ``score``."""
    at, slack = angles(score, size, top), 1e-9 * size * top + 1e-6
    low = size * top * np.cos(np.minimum(np.pi, at + radius)) - slack
    return low, size * top * np.cos(np.maximum(0, at - radius)) + slack


def turn(distance: np.ndarray, top: float) -> np.ndarray:
    """The angle of a chord of that length on a sphere of radius ``top``, rounded up."""
    return 2 * np.arcsin(np.minimum(1, distance / (2 * top))) * (1 + 1e-9) + 1e-7 if top > 0 else np.full(np.shape(distance), np.pi)


def lifted(x: np.ndarray, top2: int) -> np.ndarray:
    """The rows with their further coordinate."""
    x = x.astype("float64")
    return np.column_stack([x, np.sqrt(np.maximum(0, top2 - (x * x).sum(axis=1)))])


def grow(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A cover tree by farthest-first traversal: (order, parent, level). ``order`` lists the points from the root on, ``parent`` and ``level`` belong to the points; the root's
    parent is -1. A point of level i is more than 2^i from all points of its level and above, and within 2^(i+1) of its parent, which has a higher level. Copies of a point hang below it at
    level -2."""
    n = len(points)
    order, parent, level = np.zeros(n, dtype="int64"), np.full(n, -1), np.full(n, -2)
    near, owner = np.full(n, np.inf), np.zeros(n, dtype="int64")
    snapshot, now, far, placed = owner.copy(), None, 0, np.zeros(n, dtype=bool)
    for step in range(n):
        if step:
            far = int(np.argmax(near))
            if near[far] < 0.25:  # vectors of integers are at least 1 apart: what is left are copies
                rest = np.flatnonzero(~placed)
                order[step:], parent[rest] = rest, owner[rest]
                break
            i = math.ceil(math.log2(math.sqrt(near[far]))) - 1
            if i != now:  # the points placed so far cover all others within 2^(i+1)
                snapshot, now = owner.copy(), i
            parent[far], level[far] = snapshot[far], i
        order[step], placed[far] = far, True
        apart = points - points[far]
        d = np.einsum("ij,ij->i", apart, apart)
        closer = d < near
        near[closer], owner[closer] = d[closer], far
        near[far] = -1
    if n:
        level[order[0]] = (level.max() if n > 1 else 0) + 1
    return order, parent, level


@dataclass
class Goal:
    """What a query looks for: the ``k`` best candidates of scores low..high, equal scores by id. ``floor`` is known to be reached by k of them."""
    low: int
    high: int
    k: int
    floor: int = NOWHERE
    scores: list[int] = field(default_factory=list)
    found: list[tuple] = field(default_factory=list)  # (-score, id is NULL, id, uid)

    @property
    def least(self) -> int:
        return max(self.low, self.floor)

    def add(self, some: list[tuple]) -> None:
        self.found = sorted([*self.found, *some])[:self.k]
        if len(self.found) == self.k:
            self.floor = max(self.floor, -self.found[-1][0])


class Tree:
    """A block's points with its cover tree, ready for searches."""

    def __init__(self, uid: np.ndarray, ids: list, label: np.ndarray, x: np.ndarray, parent: np.ndarray, level: np.ndarray, top2: int):
        self.uid, self.ids, self.label, self.products, self.top = uid, ids, label, Products(x), math.sqrt(top2)
        n, points = len(x), lifted(x, top2)
        inner = np.flatnonzero(parent >= 0)
        ranked = inner[np.lexsort((-level[inner], parent[inner]))]  # children by parent, higher levels first
        first = np.flatnonzero(np.diff(parent[ranked], prepend=-1) | np.diff(level[ranked], prepend=99)) if len(ranked) else ranked
        self.children = np.split(ranked, first[1:]) if len(ranked) else []
        self.center, self.level = parent[ranked[first]], level[ranked[first]]
        self.first_cell = np.full(n, -1)  # a node's cell of the highest level; its others follow
        for c in range(len(self.center) - 1, -1, -1):
            self.first_cell[self.center[c]] = c
        at = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(self.center, self.level))}
        reach, child = np.zeros(len(self.center)), inner
        while len(child):  # one step up the tree for all points at once
            owner = parent[child]
            cell = np.array([at[a, b] for a, b in zip(owner.tolist(), level[child].tolist())])
            apart = points[inner] - points[owner]
            np.maximum.at(reach, cell, np.sqrt(np.einsum("ij,ij->i", apart, apart)))
            more = parent[owner] >= 0
            inner, child = inner[more], owner[more]
        for c in range(len(reach) - 2, -1, -1):  # a cell contains the lower cells of its node
            if self.center[c] == self.center[c + 1]:
                reach[c] = max(reach[c], reach[c + 1])
        self.radius = turn(reach, self.top)
        self.root = int(np.flatnonzero(parent < 0)[0]) if n else -1
        self.opened = 0

    def search(self, q: np.ndarray, uid: int, label: int, same: bool, windows: list[Goal]) -> None:
        """Fill ``windows`` from the rows of the same label (but ``uid`` itself) or of other labels."""
        size = math.sqrt(float((q.astype("float64") ** 2).sum()))
        product, heap = self.products.of(q), []

        def meet(nodes: np.ndarray) -> np.ndarray:
            score = product(nodes)
            some = np.flatnonzero((score >= min(w.least for w in windows)) & (score <= max(w.high for w in windows)))
            if len(some):
                fits = (self.label[nodes[some]] == label) & (self.uid[nodes[some]] != uid) if same else self.label[nodes[some]] != label
                some = some[fits]
            if len(some):
                value = score[some]
                for w in windows:
                    good = np.flatnonzero((value >= w.least) & (value <= w.high))
                    if len(good) > 4 * w.k:  # the k-th best score of these is a bound as well
                        kth = np.partition(value[good], len(good) - w.k)[len(good) - w.k]
                        good = good[value[good] >= kth]
                    if len(good):
                        w.add([(-s, self.ids[i] is None, self.ids[i] or 0, int(self.uid[i])) for s, i in zip(value[good].tolist(), nodes[some[good]].tolist())])
            return score

        def push(cells: np.ndarray, score: np.ndarray) -> None:
            low, high = bounds(score.astype("float64"), self.radius[cells], size, self.top)
            reached = np.zeros(len(cells), dtype=bool)
            for w in windows:
                reached |= (high >= w.least) & (low <= w.high)
            for c, b, s in zip(cells[reached].tolist(), high[reached].tolist(), score[reached].tolist()):
                heapq.heappush(heap, (-b, c, s))

        root = np.array([self.root])
        score = meet(root)
        if self.first_cell[self.root] >= 0:
            push(self.first_cell[root], score)
        while heap:
            b, cell, at = heapq.heappop(heap)
            if -b < min(w.least for w in windows):
                break
            self.opened += 1
            nodes = self.children[cell]
            score = meet(nodes)
            below = self.first_cell[nodes]
            if (below >= 0).any():
                push(below[below >= 0], score[below >= 0])
            if cell + 1 < len(self.center) and self.center[cell + 1] == self.center[cell]:
                push(np.array([cell + 1]), np.array([at]))


def integer_rows(rows: DataFrame) -> DataFrame:
    """(uid, vec_id, label, v, dim): the rows that take part, with components floor(256 * x); ``uid`` tells repeated rows apart. Written once."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x.cast("double"), F.lit(-1e9)), F.lit(1e9)) * F.lit(256.0)), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    kept = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & good)
    return written_table(kept.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.transform("embedding", scaled).alias("v"),
                                     F.size("embedding").alias("dim")), "mined-rows")


@dataclass(frozen=True)
class Forest:
    """Cover trees of all rows. ``nodes``: a row per candidate with its block (dim, pivot, sub), parent and level; ``cells``: a row per pivot
    that has candidates, with its distance to the farthest one, for at most about PIVOTS pivots per vector length."""
    nodes: DataFrame
    cells: pd.DataFrame
    pivots: dict[int, np.ndarray]
    top2: int


def plant(rows: DataFrame, pivots: int = PIVOTS, block: int = BLOCK) -> Forest:
    """Cover trees over ``rows`` (uid, vec_id, label, v, dim). Pivots are a bounded sample; a vector of a length without a pivot belongs to pivot -1, which is
    never skipped. A pivot with many candidates has as many blocks as it takes, by digest of the row."""
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    top2 = rows.agg(F.max(square)).first()[0] or 0
    drawn = digest_sample(rows, F.col("v"), pivots).select("dim", "v").distinct().collect()  # about ``pivots`` rows
    by_dim: dict[int, np.ndarray] = {}
    for dim in sorted({r.dim for r in drawn}):
        by_dim[dim] = _matrix(sorted(list(r.v) for r in drawn if r.dim == dim), dim)
    up = {dim: lifted(p, top2) for dim, p in by_dim.items()}

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                at, apart = np.full(len(part), -1), np.zeros(len(part))
                if dim in up:
                    x = lifted(_matrix(part["v"].tolist(), dim), top2)
                    d = np.maximum(0, (x * x).sum(axis=1)[:, None] + (up[dim] ** 2).sum(axis=1)[None, :] - 2 * x @ up[dim].T)
                    at, apart = d.argmin(axis=1), np.sqrt(d.min(axis=1))
                yield part.assign(pivot=at.astype("int32"), apart=apart)

    schema = "uid long, vec_id long, label long, v array<int>, dim int"
    placed = written_table(rows.mapInPandas(nearest, schema + ", pivot int, apart double"), "mined-placed")
    cells = placed.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius"),
                                               F.ceil(F.count(F.lit(1)) / F.lit(float(block))).cast("int").alias("subs"))
    sub = F.pmod(F.xxhash64("uid"), F.col("subs")).cast("int")
    blocks = placed.join(cells.select("dim", "pivot", "subs"), ["dim", "pivot"]).select("uid", "vec_id", "label", "v", "dim", "pivot", sub.alias("sub"))

    def tree(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("uid", ignore_index=True)
        x = _matrix(part["v"].tolist(), int(part["dim"].iloc[0]))
        _, parent, level = grow(lifted(x, top2))
        uid = part["uid"].to_numpy()
        return part.assign(parent=np.where(parent < 0, -1, uid[parent]), level=level.astype("int32"))

    grown = blocks.groupBy(*KEYS).applyInPandas(tree, schema + ", pivot int, sub int, parent long, level int")
    return Forest(written_table(grown, "mined-trees"), cells.toPandas(), by_dim, top2)


def search(forest: Forest, queries: DataFrame, n: int, same: bool, k: int, home: bool, anchors: int = ANCHORS) -> DataFrame:
    """The best ``k`` per block for queries (uid, label, v, dim, pivot, sub, low, high, floor; arrays of one entry per window): (uid, window, cand, cand_id, score).
    ``home``: in the query's own block, else in all others that may hold something within a window and its floor. ``n``: number of queries. Written once."""
    top, columns = math.sqrt(forest.top2), ["uid", "label", "v", "low", "high", "floor"]
    if home:
        sent = queries.select(*KEYS, *columns)
    else:
        cells = {dim: part.sort_values("pivot") for dim, part in forest.cells.groupby("dim")}
        pivots = {dim: Products(p) for dim, p in forest.pivots.items()}

        def reached(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out = []
                for r in frame.itertuples():
                    part, q = cells[r.dim], np.asarray(r.v, dtype="int64")
                    at = part["pivot"].to_numpy()
                    low, high = np.full(len(at), -np.inf), np.full(len(at), np.inf)
                    if at[0] >= 0:
                        size = math.sqrt(float((q.astype("float64") ** 2).sum()))
                        low, high = bounds(pivots[r.dim].of(q)(at).astype("float64"), turn(part["radius"].to_numpy(), top), size, top)
                    meets = np.zeros(len(at), dtype=bool)
                    for a, b, f in zip(r.low, r.high, r.floor):
                        meets |= (high >= max(a, f)) & (low <= b)
                    for p, subs in zip(at[meets].tolist(), part["subs"].to_numpy()[meets].tolist()):
                        out += [(r.dim, p, s, r.uid, r.label, r.v, r.low, r.high, r.floor) for s in range(subs) if (p, s) != (r.pivot, r.sub)]
                yield pd.DataFrame(out, columns=[*KEYS, *columns])

        sent = queries.mapInPandas(reached, "dim int, pivot int, sub int, uid long, label long, v array<int>, low array<long>, high array<long>, floor array<long>")
    slices = max(1, -(-n // anchors))
    left = forest.nodes.select(*[F.col(c).alias(c) for c in forest.nodes.columns]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = sent.withColumn("slice", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(slices)).cast("int"))
    top2 = forest.top2

    def descend(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            uid = block["uid"].to_numpy()
            order = np.argsort(uid)
            block, uid = block.iloc[order], uid[order]
            above = block["parent"].to_numpy()
            parent = np.where(above < 0, -1, np.searchsorted(uid, above))
            ids = [None if pd.isna(i) else int(i) for i in block["vec_id"]]
            tree = Tree(uid, ids, block["label"].to_numpy(), _matrix(block["v"].tolist(), int(block["dim"].iloc[0])), parent, block["level"].to_numpy(), top2)
            for r in asked.itertuples():
                windows = [Goal(int(a), int(b), k, int(f)) for a, b, f in zip(r.low, r.high, r.floor)]
                tree.search(np.asarray(r.v, dtype="int64"), r.uid, r.label, same, windows)
                out += [(r.uid, i, cand, None if none else at, -s) for i, w in enumerate(windows) for s, none, at, cand in w.found]
        found = pd.DataFrame(out, columns=["uid", "window", "cand", "cand_id", "score"])
        return found.astype({"uid": "int64", "window": "int32", "cand": "int64", "cand_id": "Int64", "score": "int64"})

    keys = [*KEYS, "slice"]
    return written_table(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(descend, HIT), "mined-hits")


def best(hits: DataFrame, k: int, name: str) -> DataFrame:
    """The ``k`` best hits per query and window, numbered from 1 on as ``name``."""
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), F.col("cand_id").asc_nulls_last(), "cand")
    return hits.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def two_rounds(forest: Forest, queries: DataFrame, n: int, same: bool, k: int) -> DataFrame:
    """The best ``k`` of all blocks per query and window: first the query's own block, then the others with the floors it gives."""
    first = search(forest, queries, n, same, k, True)
    floors = (first.groupBy("uid", "window").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
              .groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("_floors")))  # an entry per window at most
    raised = F.transform("floor", lambda f, i: F.coalesce(F.col("_floors")[i], f))
    again = queries.join(floors, "uid", "left").withColumn("floor", raised).drop("_floors")
    return first.union(search(forest, again, n, same, k, False))


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """Hard negatives for ``anchors``, some of ``rows`` (uid, vec_id, label, v, dim): (anchor_id, positive_id, rank, negative_id, positive_score, negative_score). An anchor's
    positives are its ``positives`` best rows of the same label; per positive, the ``negatives`` best rows of other labels with ``least`` to ``most`` percent of its score are ranked."""
    forest = plant(rows)
    lows = lambda n, value: F.array(*[F.lit(value).cast("long")] * n)
    placed = forest.nodes.drop("parent", "level").join(anchors.select("uid"), "uid", "left_semi")
    n = placed.count()
    queries = placed.select("*", lows(1, NOWHERE).alias("low"), lows(1, -NOWHERE).alias("high"), lows(1, NOWHERE).alias("floor"))
    pairs = best(two_rounds(forest, queries, n, True, positives), positives, "slot").select(
        "uid", "slot", F.col("cand").alias("_positive"), F.col("cand_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = written_table(pairs, "mined-positives")
    share = lambda percent: F.col("positive_score").cast("decimal(25,0)") * F.lit(percent) / F.lit(100)
    low, high = F.ceil(share(least)), F.floor(share(most))  # least * p <= 100 * s <= most * p in whole numbers
    windows = pairs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("slot", low.cast("long").alias("low"), high.cast("long").alias("high")))).alias("w"))  # ``positives`` at most
    queries = placed.join(windows, "uid").select(*placed.columns, F.col("w.low").alias("low"), F.col("w.high").alias("high"),
                                                 F.transform("w", lambda _: F.lit(NOWHERE).cast("long")).alias("floor"))
    ranked = best(two_rounds(forest, queries, n, False, negatives), negatives, "rank")
    return (ranked.withColumn("slot", F.col("window") + F.lit(1)).join(pairs, ["uid", "slot"]).join(placed.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
            .select("anchor_id", "positive_id", "rank", F.col("cand_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """``mine`` for the rows of ``embeddings`` whose vec_id is divisible by 100; where it is divisible by 7, the label is the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = integer_rows(embeddings.select("vec_id", moved.alias("label"), "embedding"))
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))
