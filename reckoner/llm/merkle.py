"""Merkle manifest of a dataset: a tree of digests per source, and one over the sources' roots.

Every node digests up to ARITY consecutive nodes below it. Only every STRIDE-th level is stored ("checkpoint"): a stored node
stands for an aligned subtree of ARITY ** STRIDE stored nodes one stored level below. A proof is extracted from the top down: each aligned subtree is put
together from its stored nodes, its missing interior nodes are computed again ("recompute"), each stored node gets the siblings on its way up, and the interior
nodes are dropped. A subtree has at most ARITY ** STRIDE members, whatever the size of its source.

Defined results: a NULL value is digested as ``-``, an empty text as ``0:``. Leaves are ordered by doc_id, NULL first, ties by
digest; rows that are equal throughout are leaves of their own. A NULL source is a source, ordered first. A lone leaf is its source's root, the root of a lone
source is the root. No rows give no rows. Columns other than those digested or asked for play no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reckoner.llm.common import lower_ascii, written_table
from reckoner.operators.keyed import with_key_values
from reckoner.operators.ranks import dense_id

ARITY = 16
STRIDE = 2  # levels from one stored level to the next
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<left:string,right:string>"


def field(value: Column) -> Column:
    """One value as digested: ``-`` if NULL, else its UTF-8 byte count, a colon and the value."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v.cast("string")) for v in values]), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path: (left, right) siblings from the lowest level up."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """Digest of all siblings on a path, level by level from below, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _parents(digests: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(digests) - F.lit(1)) / F.lit(ARITY)).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(digests, i * F.lit(ARITY) + F.lit(1), F.lit(ARITY)), ""), 256))


def _subtrees(level: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """(tree, block, n, members, d0, d1, ...): the aligned subtrees over a stored level. ``dk`` holds the digests k levels above it; a level above the tree's
    last is NULL. ``members`` are the stored nodes in order."""
    span = ARITY**STRIDE
    out = (level.withColumn("block", F.floor(F.col("pos") / F.lit(span)).cast("long")).groupBy("tree", "block")
           .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "digest", *carried))).alias("members"))
           .withColumn("d0", F.col("members.digest")))
    for k in range(STRIDE):
        out = out.withColumn(f"d{k + 1}", F.when(F.col("n") > ARITY**k, _parents(F.col(f"d{k}"))))
    return out


def _above(level: DataFrame) -> DataFrame:
    """The next stored level: one node per aligned subtree. A tree that has come to one node keeps it."""
    top = F.coalesce(*[F.col(f"d{k}")[0] for k in range(STRIDE, -1, -1)])
    return _subtrees(level).select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(ARITY**STRIDE)).cast("long").alias("n"), top.alias("digest"))


def _stored(level: DataFrame, most: int, name: str) -> list[DataFrame]:
    """The stored levels over ``level`` (itself included) until each tree has one node; ``most``: nodes of the largest tree."""
    levels = [level]
    while most > 1:
        levels.append(written_table(_above(levels[-1]), name))
        most = -(-most // ARITY**STRIDE)
    return levels


@dataclass(frozen=True)
class Manifest:
    """Stored levels, each (tree, pos, n, digest): ``leaves`` from the leaves (with the columns carried along) to one node per source, ``top`` from there to
    the root. ``sources`` names the trees: (tree, source, n)."""
    sources: DataFrame
    leaves: list[DataFrame]
    top: list[DataFrame]
    carried: tuple[str, ...]


def build(leaves: DataFrame) -> Manifest:
    """Manifest of ``leaves``: (source, doc_id, digest) and any columns to carry along to the proofs. Leaves are numbered by ranges, so that a source
    with a third of all rows is spread over tasks; the largest source's size and the number of sources reach the driver."""
    carried = tuple(c for c in leaves.columns if c not in ("source", "digest"))
    at = dense_id(leaves, ["source", "doc_id", "digest"], "_index")
    sources = at.groupBy("source").agg(F.min("_index").alias("_start"), F.count(F.lit(1)).alias("n"))
    sources = written_table(dense_id(sources, ["_start"], "tree"), "merkle-sources")
    count, most = sources.agg(F.count(F.lit(1)), F.max("n")).first()
    nodes = with_key_values(at, sources, ["source"]).select("tree", (F.col("_index") - F.col("_start")).alias("pos"), "n", "digest", *carried)
    stored = _stored(written_table(nodes, "merkle-leaves"), most or 0, "merkle-level")
    roots = stored[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "digest")
    return Manifest(sources.select("tree", "source", "n"), stored, _stored(roots, count, "merkle-top"), carried)


def _descend(level: DataFrame, above: DataFrame, carried: Sequence[str], handed: Sequence[str]) -> DataFrame:
    """The nodes of a stored level with their ``path`` to the root. ``above``: (tree, pos, path, ``handed``) of the stored level above."""
    trees = _subtrees(level, carried).join(above.withColumnRenamed("pos", "block"), ["tree", "block"])
    nodes = trees.select("*", F.posexplode("members").alias("_at", "_m"))
    steps = []
    for k in range(STRIDE):
        at = F.floor(F.col("_at") / F.lit(ARITY**k)).cast("int")
        first = at - F.pmod(at, F.lit(ARITY))
        left = F.array_join(F.slice(f"d{k}", first + F.lit(1), at - first), "")
        right = F.array_join(F.slice(f"d{k}", at + F.lit(2), F.lit(ARITY - 1) - (at - first)), "")
        steps.append(F.when(F.col("n") > ARITY**k, F.array(F.struct(left.alias("left"), right.alias("right")))).otherwise(F.array().cast(f"array<{STEP}>")))
    return nodes.select("tree", F.col("_m.pos").alias("pos"), F.col("_m.digest").alias("digest"), *[F.col(f"_m.{c}").alias(c) for c in carried], *handed,
                        F.concat(*steps, F.col("path")).alias("path"))


def proofs(manifest: Manifest) -> DataFrame:
    """(tree, pos, digest, the columns carried along, subroot, root, path) per leaf."""
    none = F.array().cast(f"array<{STEP}>")
    above = manifest.top[-1].select("tree", "pos", F.col("digest").alias("root"), none.alias("path"))
    for level in reversed(manifest.top[:-1]):
        above = _descend(level, above, (), ("root",)).select("tree", "pos", "digest", "root", "path")
    if len(manifest.top) == 1:
        above = above.withColumn("digest", F.col("root"))
    # the nodes of the top tree are the roots of the sources, each the one node of its tree's last level
    above = above.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "root", "path")
    handed = ("subroot", "root")
    if len(manifest.leaves) == 1:  # every source has one leaf
        return manifest.leaves[0].join(above, ["tree", "pos"]).select("tree", "pos", "digest", *manifest.carried, *handed, "path")
    for level in reversed(manifest.leaves[1:-1]):
        above = _descend(level, above, (), handed).select("tree", "pos", *handed, "path")
    return _descend(manifest.leaves[0], above, manifest.carried, handed)


def audited(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``: proofs of the untampered rows, checked against
    texts of which those whose id has a CRC-32 divisible by 5 are in lower case."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    rows = docs.select(*[F.col(c).cast(kinds.get(c, "string")).alias(c) for c in FIELDS])
    values = {c: F.col(c) for c in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(5) == 0
    tampered = F.when(touched, leaf([*[values[c] for c in FIELDS[:-1]], lower_ascii(F.col("text"))]))
    p = proofs(build(rows.select("source", "doc_id", leaf(list(values.values())).alias("digest"), tampered.alias("tampered"))))
    p = p.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"),
                 fold(F.coalesce("tampered", "digest"), F.col("path")).alias("folded_root"))
    return p.withColumn("verified", F.col("folded_root") == F.col("root"))
