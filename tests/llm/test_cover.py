"""Cover trees and hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reckoner.llm import cover

SCHEMA = "vec_id long, label int, embedding array<float>"


def points(kind, n=300, dim=5):
    rng = np.random.default_rng(3)
    if kind == "clusters":
        x = rng.integers(-60, 60, (8, dim))[rng.integers(0, 8, n)] * 20 + rng.integers(-4, 5, (n, dim))
    elif kind == "copies":
        x = rng.integers(-2, 3, (n, 2)) * 50
    elif kind == "norms":
        x = rng.integers(-9, 10, (n, dim)) * (1 + 40 * (rng.random((n, 1)) < 0.1)).astype("int64")
    else:
        x = np.zeros((n, dim), dtype="int64")
    return x.astype("int64")


@pytest.mark.parametrize("kind", ["clusters", "copies", "norms", "zero"])
def test_tree_covers_and_parts(kind):
    x = points(kind)
    up = cover.lifted(x, int((x * x).sum(axis=1).max()))
    order, parent, level = cover.grow(up)
    assert sorted(order) == list(range(len(x))) and (parent < 0).sum() == 1
    d = np.sqrt(np.maximum(0, ((up[:, None] - up[None]) ** 2).sum(axis=2)))
    for i in np.flatnonzero(parent >= 0):
        assert level[parent[i]] > level[i] or level[i] == -2
        assert d[i, parent[i]] <= 2.0 ** (level[i] + 1) + 1e-6  # covered
        if level[i] > -2:
            others = np.flatnonzero((level >= level[i]) & (np.arange(len(x)) != i))
            assert (d[i, others] > 2.0 ** level[i] - 1e-6).all()  # apart
        else:
            assert (x[i] == x[parent[i]]).all()


@pytest.mark.parametrize("kind", ["clusters", "copies", "norms", "zero"])
def test_search_is_exact_and_skips(kind):
    x = points(kind)
    top2 = int((x * x).sum(axis=1).max())
    rng = np.random.default_rng(5)
    label = rng.integers(0, 3, len(x))
    _, parent, level = cover.grow(cover.lifted(x, top2))
    ids = [None if i % 50 == 3 else 1000 - i for i in range(len(x))]
    tree = cover.Tree(np.arange(len(x)), ids, label, x, parent, level, top2)
    for a in range(0, len(x), 7):
        score = x @ x[a]
        for same, low, high in ((True, -10**9, 10**9), (False, int(0.3 * score[a]), int(0.6 * score[a])), (False, -500, 0)):
            fits = (label == label[a]) & (np.arange(len(x)) != a) if same else label != label[a]
            rows = np.flatnonzero(fits & (score >= low) & (score <= high))
            want = sorted((-int(score[i]), ids[i] is None, ids[i] or 0, int(i)) for i in rows)[:4]
            goals = [cover.Goal(low, high, 4), cover.Goal(low, high, 1)]
            tree.search(x[a], a, label[a], same, goals)
            assert goals[0].found == want and goals[1].found == want[:1]
    if kind == "clusters":
        tree.opened = 0
        tree.search(x[0], 0, label[0], True, [cover.Goal(-10**9, 10**9, 1)])
        assert tree.opened < len(tree.center) / 3


def test_bounds_hold_all_members():
    rng = np.random.default_rng(9)
    x = rng.integers(-50, 51, (200, 6))
    top2 = int((x * x).sum(axis=1).max())
    up = cover.lifted(x, top2)
    for _ in range(50):
        q, c = rng.integers(-50, 51, 6), int(rng.integers(0, 200))
        apart = np.sqrt(((up - up[c]) ** 2).sum(axis=1))
        members = apart <= np.quantile(apart, 0.3)
        radius = cover.turn(apart[members].max(), math.sqrt(top2))
        low, high = cover.bounds(float(x[c] @ q), radius, math.sqrt((q * q).sum()), math.sqrt(top2))
        assert (x[members] @ q >= low).all() and (x[members] @ q <= high).all()


def brute(rows):
    rows = [(i, v, lab if v is None or i is None or i % 7 or lab is None else (lab + 1) % 10) for i, lab, v in rows]
    good = [(r, i, lab, [max(-cover.LARGEST, min(cover.LARGEST, math.floor(256 * float(np.float32(c))))) for c in v]) for r, (i, v, lab) in enumerate(rows)
            if lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for r, i, lab, v in good:
        if i is None or i % 100:
            continue
        near = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, s, l2) for s, j, l2, w in good if s != r and len(w) == len(v)]
        for p in sorted(x for x in near if x[4] == lab)[:5]:
            ps = -p[0]
            fits = sorted(x for x in near if x[4] != lab and 30 * ps <= 100 * -x[0] <= 90 * ps)[:10]
            out += [(i, None if p[1] else p[2], k + 1, None if x[1] else x[2], ps, -x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=repr)


def of(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("uid", "dim", "pivot", "sub", "v", "score", "rank", "slot")])
    return sorted((tuple(r) for r in cover.hard_negatives(df).collect()), key=repr)


def test_equals_brute_force_with_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover.plant, "__defaults__", (6, 40))
    monkeypatch.setattr(cover.search, "__defaults__", (3,))
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 6))[rng.integers(0, 20, 900)] + 0.3 * rng.normal(size=(900, 6))
    x[100:400] = x[100] + 0.02 * rng.normal(size=(300, 6))  # a group of near copies
    x[500:600] = x[500]
    rows = [(int(i), int(rng.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(x)]
    assert of(spark, rows) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 3, [0.9, 1.0]), (3, 3, [0.9, 1.0]), (100, 3, [0.0, 0.0]), (200, 3, []), (201, 4, []), (4, 3, []),
            (5, 3, [nan, 1.0]), (6, 3, [inf, 1.0]), (8, 3, [None, 1.0]), (9, None, [1.0, 1.0]), (None, 3, [0.8, 1.0]), (None, 1, [1.0, 1.5]), (10, 2, None),
            (300, 2, [1.0]), (11, 2, [3.0e7]), (12, 3, [0.5]), (None, None, None), (400, 1, [-1.0, -2.0]), (13, 1, [0.1, 0.1])]
    assert of(spark, rows) == brute(rows)
    assert of(spark, rows[3:4]) == [] and of(spark, []) == []
