"""Quality rules: per-document counts, and lines that too many documents of a host share.

A line is normalised (A-Z lowered, digits as 0, white space runs as one space) and hashed. A line that more than a
limit of a host's documents hold is removed; a document that loses most of its words that way is
rejected. Documents with the same text count once: copies are another operator's matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from reckoner.llm.common import written_table

MIN_WORDS = 50  # fixed values of the data contract, with the next
MAX_REPEATED = 50  # per cent of the words
LINE_DOCS, LINE_SHARE = 20, 0.05  # a line is removed above both: documents of the host, and their share
DEPLETED = 0.3  # least share of words that must be left
#: White space of Unicode beyond the separators of words (fixed value): only then split() would cut differently.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
WORD, SYMBOLS, RUN = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[#*$%&|<>]"), re.compile(r"[\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def split_words(text: str) -> list[str]:
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, upto = 0, 0  # words before ``upto`` are counted
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def counted(text: str) -> tuple:
    """The counts of one text, and the words of each distinct normalised line by its hash."""
    words = split_words(text)
    seen, again, lines = set(), 0, Counter()
    for line in text.split("\n"):
        n = len(split_words(line))
        if n:
            again += line in seen
            seen.add(line)
            lines[xxhash.xxh64_intdigest(RUN.sub(" ", line).strip(" ").translate(LOWER)) - 2**63] += n
    return (len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), again, repeated_words(words), list(lines.items()))


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, _host, _none, _digest, counts, lines) per document, written once; NULL text has no words, a NULL source is a host of its own."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COUNTS.split(", ")] + ["lines"]
        for frame in frames:
            rows = pd.DataFrame([counted(x) for x in frame.pop("text")], columns=names, index=frame.index)
            yield pd.concat([frame, rows], axis=1)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_host"),
                       F.col("source").isNull().alias("_none"), F.xxhash64("text").alias("_digest"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return written_table(rows.mapInPandas(
        _nullable(count), f"doc_id long, _host string, _none boolean, _digest long, {COUNTS}, lines array<struct<h: long, n: long>>"), "line-profile")


def _nullable(f):
    """Arrow hands a long column with NULLs over as floats; the ids must stay exact."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return f(frame.assign(doc_id=frame["doc_id"].astype("Int64")) for frame in frames)
    return run


def judge(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted: float = DEPLETED) -> DataFrame:
    """Per document the counts, ``base_failed``, ``removed_words`` (in lines above the limits) and ``kept``. One row per input row; repeated rows get the
    same verdict, empty texts fail. Only doc_id, text and source are read."""
    rows = profile(docs)
    lines = rows.select("_host", "_none", "_digest", F.explode("lines").alias("l")).select("_host", "_none", "_digest", "l.h", "l.n").distinct()
    hosts = rows.select("_host", "_none", "_digest").distinct().groupBy("_host", "_none").agg(F.count(F.lit(1)).alias("_docs"))
    common = (lines.groupBy("_host", "_none", "h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > line_docs)
              .join(hosts, ["_host", "_none"]).where(F.col("_n") > line_share * F.col("_docs")).select("_host", "_none", "h"))
    removed = (lines.join(common, ["_host", "_none", "h"]).groupBy("_host", "_none", "_digest").agg(F.sum("n").alias("_removed")))
    out = rows.drop("lines").join(removed, ["_host", "_none", "_digest"], "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    gone = F.coalesce("_removed", F.lit(0)).cast("long")
    return out.select("doc_id", *[c.split()[0] for c in COUNTS.split(", ")], failed.alias("base_failed"), gone.alias("removed_words"),
                      (~failed & (F.col("n_words") - gone >= depleted * F.col("n_words"))).alias("kept"))
