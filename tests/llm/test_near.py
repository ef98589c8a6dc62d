"""SimHash, components and vectors against brute force over all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from reckoner.llm import simhash, vectors
from reckoner.llm.components import components
from reckoner.llm.queries import QUERIES
from tests.llm.conftest import ODD, SF


def roots(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else " " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def expected_groups(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    tied = roots(len(rows), links)
    least = {}
    for (doc, _), r in zip(rows, tied):
        least[r] = min((d for d in (least.get(r), doc) if d is not None), default=None)
    return sorted(((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, tied)), key=repr)


def test_simhash_query_equals_all_pairs(spark, docs):
    got = sorted((tuple(r) for r in QUERIES["op5_simhash"](spark, SF).collect()), key=repr)
    assert got == expected_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_simhash_of_odd_rows(odd, none):
    got = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.grouped(odd).collect()), key=repr)
    assert got == expected_groups([(d[0], d[1]) for d in ODD])
    assert simhash.grouped(none).collect() == []
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6", "7"]


REPEATED = [(None, "alpha beta gamma delta epsilon"), (None, "one fine day in the green valley"), (None, None), (7, "red apples fall from old trees"),
            (7, "blue ships sail over calm seas"), (3, "red apples fall from old trees"), (7, "blue ships sail over calm seas")]
ONCE = sorted([REPEATED[0], REPEATED[1], REPEATED[2], REPEATED[4], REPEATED[5]], key=repr)


def test_groups_of_rows_without_or_with_the_same_id_keep_a_row_each(spark):
    df = spark.createDataFrame(REPEATED, "doc_id long, text string")
    assert sorted(map(tuple, simhash.deduplicated(df).collect()), key=repr) == ONCE


@pytest.mark.parametrize("bucket", [2, 128])
def test_links_of_dense_groups_in_small_and_large_buckets(spark, bucket):
    random.seed(5)
    fps = set()
    for _ in range(40):
        base = random.getrandbits(64)
        chain = base
        for _ in range(12):
            fps.add(base ^ 1 << random.randrange(64) ^ 1 << random.randrange(64))
            chain ^= 1 << random.randrange(64)
            fps.add(chain)
    fps = sorted(fps)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket)
    at = {f: i for i, f in enumerate(signed)}
    found = [(at[r.a], at[r.b]) for r in edges.collect()]
    assert all((fps[i] ^ fps[j]).bit_count() <= 2 for i, j in found)
    every = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert roots(len(fps), found) == roots(len(fps), every)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_bit_sliced_forest_for_any_radius(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**63, 30, dtype="uint64")
    fps = np.concatenate([fps, fps ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype="uint64")), fps ^ np.uint64(0b10111)]).view("int64")
    every = [(i, j) for i in range(len(fps)) for j in range(i) if np.bitwise_count(fps.view("uint64")[i] ^ fps.view("uint64")[j]) <= radius]
    assert roots(len(fps), simhash.forest(fps, radius)) == roots(len(fps), every)


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def expected_vectors(rows):
    unit = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v, dtype="float64") / np.linalg.norm(np.array(v, dtype="float64"))
    links = [(i, j) for i in unit for j in unit if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    tied, least = roots(len(rows), links), {}
    for (vec, _), r in zip(rows, tied):
        least[r] = min((d for d in (least.get(r), vec) if d is not None), default=None)
    return sorted(((vec, sum(a == i for a, _ in links), least[r], None if vec is None else vec == least[r]) for i, ((vec, _), r) in enumerate(zip(rows, tied))), key=repr)


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(30):  # tight groups, loose ones, and vectors of their own
        centre, noise = rng.standard_normal(16), (0.01, 0.05, 0.09)[c % 3]
        rows += [(len(rows) + k, (centre + noise * rng.standard_normal(16) * 2).astype("float32").tolist()) for k in range(1 if c % 5 == 0 else 25)]
    rows += [(rows[0][0], rows[0][1]), (1000, rows[0][1]), (1001, None), (1002, []), (1003, [0.0] * 16), (1004, [1.0, None] * 8), (1005, [float("nan")] * 16), (1006, [float("inf")] * 16),
             (None, rows[3][1]), (None, None), (1007, [1.0, 2.0]), (1008, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("id", F.lit(5)).withColumn("v", F.lit("x"))
    got = pd.DataFrame([tuple(r) for r in vectors.linked(df).collect()], columns=["vec_id", "n", "c", "k"])
    want = pd.DataFrame(expected_vectors(rows), columns=["vec_id", "n", "c", "k"])
    assert len(got) == len(want) and got["n"].sum() >= 0.9 * want["n"].sum() and got["n"].sum() <= want["n"].sum()
    assert (got.sort_values(["vec_id", "n"])["c"].fillna(-1).to_numpy() == want.sort_values(["vec_id", "n"])["c"].fillna(-1).to_numpy()).mean() >= 0.9
    assert vectors.linked(df.limit(0)).collect() == []


def test_recall_at_the_bound():
    assert vectors.recall() >= 0.9


def test_vector_query_equals_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op6_embedding_near_dedup"](spark, SF).collect()), key=repr) == expected_vectors(rows)


def test_stage_keeps_one_document_per_group_of_the_operator(spark, docs):
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    groups = {}
    for r in QUERIES["op5_simhash"](spark, SF).collect():
        groups.setdefault(r.component_id, set()).add(r.doc_id)
    kept = stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(groups) and any(len(g) > 1 for g in groups.values())


def test_stage_of_rows_without_or_with_the_same_id_and_of_odd_rows(spark, odd, none):
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    df = spark.createDataFrame(REPEATED, "doc_id long, text string")
    assert sorted(map(tuple, stage(spark, df, SF).collect()), key=repr) == ONCE
    kept = stage(spark, odd, SF)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6", "7"]
    assert stage(spark, none, SF).collect() == []


def test_stage_catches_exact_and_very_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(800)]
        near = list(base)
        near[rng.randrange(800)] = "changed"
        rows += [(3 * g, " ".join(base), "a"), (3 * g + 1, " ".join(base), "b"), (3 * g + 2, " ".join(near), "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near-dedup"](spark, df, SF).collect())
    fps = {d: simhash.fingerprint(t) for d, t, _ in rows}
    within = [g for g in range(60) if (fps[3 * g] ^ fps[3 * g + 2]).bit_count() <= 2]
    assert kept == sorted([3 * g for g in range(60)] + [3 * g + 2 for g in range(60) if g not in within]) and len(within) > 30
