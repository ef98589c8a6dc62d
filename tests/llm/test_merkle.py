"""Merkle manifest against a plain tree in memory and against SQL."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from reckoner.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """(root, per leaf the levels of (left, right))."""
    paths, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            run = at[i] // 16 * 16
            p.append(("".join(nodes[run:at[i]]), "".join(nodes[at[i] + 1:run + 16])))
            at[i] //= 16
        nodes = [h(nodes[i:i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    def leaf(doc, source, lang, n, text):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text))
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        mine = sorted(((r[0], leaf(*r), r) for r in rows if r[1] == s), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append((mine, *tree([x[1] for x in mine])))
    root, over = tree([t[1] for t in trees])
    out = []
    for (mine, sub, paths), up in zip(trees, over):
        for (doc, digest, r), path in zip(mine, paths):
            whole = path + up
            text = r[4] if doc is None or r[4] is None or zlib.crc32(str(doc).encode()) % 5 else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            d = leaf(*r[:4], text)
            for left, right in whole:
                d = h([left, d, right])
            out.append((doc, digest, sub, root, h(a + b for a, b in whole), d, d == root))
    return sorted(out, key=repr)


def of(spark, rows):
    return sorted((tuple(r) for r in merkle.audited(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [16], [17, 1], [256, 3, 257], [700, 16, 1] + [2] * 20], ids=str)
def test_equals_the_plain_tree(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(i * 1000 + k, f"s{i}" if i else None, "en", k, "Ab c" * (k % 3)) for i, n in enumerate(sizes) for k in range(n)]
    rng.shuffle(rows)
    assert of(spark, rows) == plain(rows)


def test_more_levels_than_one_stored_level(spark):
    rows = [(k, "a", None, None, f"T{k}") for k in range(5000)]
    assert of(spark, rows) == plain(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (5, "é", "", 0, ""), (5, "é", "", 0, ""), (5, "z", "x", 3, "A" * 100_000), (None, "z", "x", 1, "Ä a"),
            (-7, "", "x", 1, "ABC"), (10, "", "x", 1, "ABC")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(3).alias(c) for c in ("tree", "pos", "n", "digest", "path", "_index", "tampered", "root")])
    got = sorted((tuple(r) for r in merkle.audited(df).collect()), key=repr)
    assert got == plain(rows)
    assert {r[0]: r[6] for r in got if r[0] in (10, -7)} == {d: zlib.crc32(str(d).encode()) % 5 != 0 for d in (10, -7)}


def test_no_rows(none):
    assert merkle.audited(none).collect() == []


def test_only_every_second_level_is_stored(spark):
    leaves = spark.range(3000).select(F.lit("a").alias("source"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    m = merkle.build(leaves)
    assert [level.count() for level in m.leaves] == [3000, 12, 1] and [level.count() for level in m.top] == [1]
    root, paths = tree([hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)])
    got = {r.doc_id: r for r in merkle.proofs(m).collect()}
    assert all([tuple(s) for s in got[i].path] == paths[i] and got[i].root == root for i in (0, 255, 256, 2999))
