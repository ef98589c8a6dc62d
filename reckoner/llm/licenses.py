"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are runs of words that overlap by half, so that any passage as long as a template's span lies in one of them. The words of the
templates are ordered by their document frequency in the whole corpus, the rarest first. A block that holds a share of at least
``threshold`` of a template's words must hold one of the first |T| - needed + 1 of them (prefix filter), at least as many template words as are needed (length
filter), and enough of both orders must be left at the common word (positional filter). What passes is
compared exactly, by the best window of the template's span (its length over the threshold, so that a few words may be put in). Phrases are templates with threshold 1 whose
words must stand in a row. So must those of templates of fewer than LONG words: the word a share would let go is the one that tells licenses apart.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reckoner.llm.common import lower_ascii, words

STRIDE = 32  # words from one block to the next, at least: a longer template makes it its span
THRESHOLD = 0.8
LONG = 10  # words from which a share of a template is enough
#: Characters between words (fixed value of the data contract).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def ordered(self) -> bool:
        """Must its words stand in a row?"""
        return self.phrase or len(set(self.words)) < LONG

    def span(self, threshold: float) -> int:
        """Words of the window that is compared."""
        return len(self.words) if self.ordered else math.ceil(len(self.words) / threshold - 1e-9)


#: Phrases and labels of the data contract.
PHRASES = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True))
#: The usual notices of well-known licenses, as words.
NOTICES = (
    Template("apache-2.0", "apache license 2 0"),
    Template("apache-2.0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc"),
    Template("cc-by-nc", "cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa"),
    Template("cc-by-sa", "cc by sa 4 0"),
    Template("cc0", "the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "lesser general public license"),
    Template("mit", "under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
)


def needed(template: Template, threshold: float) -> int:
    """Words of the template that a block must hold."""
    n = len(set(template.words))
    return n if template.ordered else math.ceil(threshold * n - 1e-9)


def _array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def frequencies(texts: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Documents that hold each word of the (fixed) vocabulary, over all documents."""
    found = texts.select(F.explode(F.array_intersect("_words", _array(vocabulary))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in found.collect()}


def scan(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES), threshold: float = THRESHOLD) -> DataFrame:
    """A row per template and block that meets it: (doc_id, _digest, label, phrase, share, places). ``places`` are the starts (words from 0) of a phrase
    in its block, each in one block only. doc_id and text are read, other columns never; NULL text has no block; rows with the same doc_id and text
    give the same rows each."""
    stride = max([STRIDE, *[t.span(threshold) for t in templates]])
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("_digest"),
                        words(lower_ascii(F.col("text").cast("string")), SEPARATORS).alias("_words"))
    vocabulary = sorted({w for t in templates for w in t.words})
    count = frequencies(texts, vocabulary)
    order = sorted(vocabulary, key=lambda w: (count.get(w, 0), w))
    rank = {w: i + 1 for i, w in enumerate(order)}  # array_position counts from 1
    entries, rare = [], set()
    for number, t in enumerate(templates):
        ranks = sorted({rank[w] for w in t.words})
        need = needed(t, threshold)
        for i, r in enumerate(ranks[:len(ranks) - need + 1]):
            entries.append((number, t.label, t.phrase, t.ordered, t.span(threshold), t.words, ranks, need, i, r))
            rare.add(order[r - 1])
    index = docs.sparkSession.createDataFrame(entries, "template int, label string, phrase boolean, ordered boolean, span int, t_words array<string>, t_ranks array<long>, "
                                                       "need int, t_at int, rank long")
    starts = F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / stride).cast("int"))
    blocks = (texts.where(F.arrays_overlap("_words", _array(sorted(rare))))
              .select("doc_id", "_digest", F.posexplode(F.transform(starts, lambda k: F.slice("_words", k * stride + 1, 2 * stride))).alias("_k", "_block"))
              .where(F.arrays_overlap("_block", _array(sorted(rare)))))
    ranked = F.array_sort(F.transform(F.array_intersect("_block", _array(order)), lambda w: F.array_position(_array(order), w)))
    left = F.least(F.size("t_ranks") - 1 - F.col("t_at"), F.size("_ranks") - 1 - F.col("_at"))
    pairs = (blocks.withColumn("_ranks", ranked).select("*", F.posexplode("_ranks").alias("_at", "rank"))
             .join(F.broadcast(index), "rank")  # the prefixes of a fixed list of templates
             .where((F.size("_ranks") >= F.col("need")) & (1 + left + F.least("t_at", "_at") >= F.col("need"))))
    # windows that begin in the first half of their block; those that begin later belong to the next one
    begins = F.sequence(F.lit(0), F.least(F.lit(stride), F.size("_block")) - 1)
    at = F.filter(begins, lambda i: F.slice("_block", i + 1, F.size("t_words")) == F.col("t_words"))
    overlap = F.array_max(F.transform(begins, lambda i: F.size(F.array_intersect(F.slice("_block", i + 1, F.col("span")), F.col("t_words")))))
    held = pairs.where(F.size(F.array_intersect("_ranks", "t_ranks")) >= F.col("need"))
    met = held.withColumn("_at_words", F.when(F.col("ordered"), at)).withColumn("_overlap", F.when(F.col("ordered"), F.when(F.size("_at_words") > 0, F.col("need")).otherwise(0)).otherwise(overlap))
    return met.where(F.col("_overlap") >= F.col("need")).select(
        "doc_id", "_digest", "template", "label", "phrase", (F.col("_overlap") / F.size("t_ranks")).alias("share"),
        F.when(F.col("phrase"), F.transform("_at_words", lambda i: (i + F.col("_k") * stride).cast("long"))).alias("places"))


def labelled(docs: DataFrame, **options) -> DataFrame:
    """Per document: n_words, n_base (places of phrases), first_word, last_word, base_labels, labels, score (the largest share of a template
    that it meets, else 0). A document without words has 0, NULL and empty lists. One row per input row, repeated rows included."""
    hits = scan(docs, **options).select("*", F.explode_outer("places").alias("place"))
    base, texts = F.when(F.col("phrase"), F.col("label")), F.col("text").cast("string")
    found = hits.groupBy("doc_id", "_digest").agg(
        F.countDistinct(F.when(F.col("phrase"), F.struct("template", "place"))).alias("n_base"),
        F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("share").alias("score"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_text"),
                       F.size(words(lower_ascii(texts), SEPARATORS)).cast("long").alias("n_words"))
    return (rows.join(found, rows["_id"].eqNullSafe(found["doc_id"]) & (rows["_text"] == found["_digest"]), "left")
            .select(F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
                    F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")))
