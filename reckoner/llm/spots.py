"""Document fingerprints by spot signatures (SpotSigs).

The most common words of each language are anchors. At each place of an anchor a chain starts: the anchor and the next CHAIN content words (words that are no
anchors) after it. The 32-bit digests of its chains are a text's signatures, and their set is its fingerprint. Two fingerprints are compared by the Jaccard similarity of their
sets; where only a decision is wanted, sets are partitioned by length (sets in partitions that are not neighbours cannot be similar enough), and a comparison is
given up as soon as what is left cannot reach the threshold.

Documents stand in descending order of doc_id (ties by a digest of the text, NULL last). To compare each with the next one, they are dealt into ranges of that order
by bounds taken from a slim table, and the first document of a range visits the range before it: whole texts are shuffled once, compressed, and written nowhere.

Defined results: a NULL text is an empty text; a text without a chain has one signature, the digest of the whole text, so that equal texts have
equal fingerprints and empty ones are alike. Rows with the same id and text are rows of their own, side by side. A lone document is its own next one. No rows give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from reckoner.llm.common import partitions
from reckoner.llm.tokens import batches
from reckoner.operators.keyed import with_key_values

ANCHORS = 24  # words of each language that are anchors
LANGUAGES = 1000  # languages with less than this part of all documents name no anchors, so there are at most ANCHORS * LANGUAGES
CHAIN = 2  # content words after the anchor
THRESHOLD = 0.8
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)  # multipliers of a chain's words, in order
WORDS_KEPT = 400_000  # distinct words whose digests a task keeps
COUNTED = 200_000  # words after which a task sends its counts

#: A-Z in lower case, everything but letters, digits and bytes of other alphabets to a blank (fixed value of the words).
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.md5(data, usedforsecurity=False).digest()[:4], "big")


def anchors(docs: DataFrame, per_language: int = ANCHORS, languages: int = LANGUAGES) -> list[str]:
    """The ``per_language`` words that most documents of a language hold (ties by word), for every language with a ``languages``-th of all
    documents or more. Counts cover all documents; a task sends a row per language and word."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str | None, Counter] = {}

        def rows() -> pd.DataFrame:
            out = [(lang, w.decode(), n) for lang, c in found.items() for w, n in c.items()]
            found.clear()
            return pd.DataFrame(out, columns=["lang", "word", "n"])

        size = 0
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                mine = found.setdefault(None if pd.isna(lang) else lang, Counter())
                size -= len(mine)
                mine.update(set(words(text)))
                size += len(mine)
                if size > COUNTED:
                    size = 0
                    yield rows()
        yield rows()

    slim = docs.select(F.col("lang").cast("string"), F.col("text").cast("string"))
    per_lang = slim.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    enough = per_lang.where(F.col("docs") * F.lit(languages) >= slim.agg(F.count(F.lit(1))).scalar()).select("lang")
    counts = slim.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    first = counts.withColumn("rank", rank).where(F.col("rank") <= per_language)  # each task sorts out its own first ones before the shuffle
    return sorted(r.word for r in with_key_values(first, enough, ["lang"]).select("word").distinct().collect())


class Signatures(dict):
    """Fingerprints of texts, given the anchors. As a dictionary: digest of a word, 2^32 higher if it is an anchor."""

    def __init__(self, anchor_words: Sequence[str]):
        self.anchors = frozenset(w.encode() for w in anchor_words)

    def __missing__(self, word: bytes) -> int:
        value = self[word] = digest(word) | (word in self.anchors) << 32
        return value

    def of(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Sorted distinct signatures per text."""
        if len(self) > WORDS_KEPT:
            self.clear()
        cut = [words(x) for x in texts]
        ends = np.cumsum([len(w) for w in cut], dtype="int64")
        codes = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), dtype="uint64", count=int(ends[-1]) if len(ends) else 0)
        is_anchor, code = codes >> np.uint64(32) > 0, codes & np.uint64(0xFFFFFFFF)
        content, at = np.flatnonzero(~is_anchor), np.flatnonzero(is_anchor)
        doc, following = np.searchsorted(ends, at, side="right"), np.searchsorted(content, at)
        whole = following + CHAIN <= len(content)
        at, doc, following = at[whole], doc[whole], following[whole]
        inside = content[following + CHAIN - 1] < ends[doc] if len(at) else np.zeros(0, dtype=bool)
        at, doc, following = at[inside], doc[inside], following[inside]
        mixed = code[at] * np.uint64(MIX[0])
        for k in range(CHAIN):
            mixed += code[content[following + k]] * np.uint64(MIX[k + 1])
        keys = np.unique(doc.astype("uint64") << np.uint64(32) | mixed >> np.uint64(32))
        cuts = np.searchsorted(keys, np.arange(1, len(cut), dtype="uint64") << np.uint64(32))
        found = np.split((keys & np.uint64(0xFFFFFFFF)).astype("uint32"), cuts) if len(cut) else []
        return [s if len(s) else np.array([digest(x.encode())], dtype="uint32") for s, x in zip(found, texts)]


def fingerprint(signatures: np.ndarray) -> str:
    """Signatures in ascending order, big-endian, in Base64."""
    return base64.b64encode(signatures.astype(">u4").tobytes()).decode()


def signatures_of(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype=">u4").astype("uint32")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def partition(size: int, threshold: float = THRESHOLD) -> int:
    """The length partition of a set. Sets that reach the threshold are in the same partition or in neighbouring ones."""
    return math.floor(math.log(size) / -math.log(threshold) + 1e-9)


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, step: int = 256) -> bool:
    """Is the Jaccard similarity of two sorted sets at least ``threshold``? Length partitions first; then runs of ``step`` signatures, until the misses so far
    decide."""
    if abs(partition(len(a), threshold) - partition(len(b), threshold)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) < threshold * len(b):
        return False
    needed = math.ceil(threshold / (1 + threshold) * (len(a) + len(b)) - 1e-9)  # common signatures of two similar sets
    common = 0
    for low in range(0, len(a), step):
        some = a[low:low + step]
        at = np.searchsorted(b, some)
        common += int((b[np.minimum(at, len(b) - 1)] == some).sum())
        if common >= needed:
            return True
        if common + len(a) - low - len(some) < needed:
            return False
    return False


def order_key(doc_id: Column, text: Column) -> list[Column]:
    """Ascending keys of the descending order of doc_id, NULL last, ties by a digest of the text."""
    return [doc_id.isNull().alias("k0"), F.coalesce(F.bitwise_not(doc_id), F.lit(0).cast("long")).alias("k1"), F.xxhash64(text).alias("k2")]


def beside_next(docs: DataFrame) -> DataFrame:
    """(slice, visitor, k0, k1, packed): ``docs`` in ranges of the order, one to a partition and sorted in it, texts compressed; ``visitor`` marks the first row of
    the next range (of the first range, for the last one), at the end of each. Bounds, one per range, reach the driver."""
    keys, n = ["k0", "k1", "k2"], partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(*order_key(F.col("doc_id"), F.col("text")), "text")
    ranged = rows.select(*keys).repartitionByRange(n, *keys).withColumn("slice", F.spark_partition_id())
    bounds = sorted({tuple(r.first) for r in ranged.groupBy("slice").agg(F.min(F.struct(*keys)).alias("first")).collect()})

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row to its range; the first row of a range visits the one before as well."""
        pack = zstandard.ZstdCompressor(level=1).compress
        for frame in frames:
            at = [max(0, bisect_right(bounds, key) - 1) for key in zip(*(frame[k].tolist() for k in keys))]
            out = frame[keys].assign(slice=np.array(at, dtype="int32"), visitor=False, packed=[pack(x.encode()) for x in frame["text"]])
            yield out
            first = [bounds[i] == key for i, key in zip(at, zip(*(frame[k].tolist() for k in keys)))]
            if any(first):
                yield out[first].assign(slice=(out["slice"][first] - 1) % len(bounds), visitor=True)

    dealt = rows.mapInPandas(deal, "k0 boolean, k1 long, k2 long, slice int, visitor boolean, packed binary")
    return dealt.repartitionById(max(n, len(bounds)), "slice").sortWithinPartitions("slice", "visitor", *keys).select("slice", "visitor", "k0", "k1", "packed")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the first as many characters of ``following``, or all."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
          "similar_edited boolean, similar_next boolean")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Fingerprints of all ``docs`` (doc_id, text, lang) and of their edited texts, compared with each other and with the next document's."""
    anchor_words = anchors(docs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signatures, held = Signatures(anchor_words), None  # the row before, which waits for its next one
        unpack = zstandard.ZstdDecompressor().decompress
        for frame in frames:
            texts = [unpack(x).decode() for x in frame["packed"]]
            ids = [None if none else ~key for none, key in zip(frame["k0"].tolist(), frame["k1"].tolist())]
            for low, high in batches(texts):
                rows = list(zip(frame["visitor"].tolist()[low:high], ids[low:high], texts[low:high], signatures.of(texts[low:high])))
                pairs = [(one, two) for one, two in zip([held, *rows], rows) if one is not None and not one[0]]
                held = rows[-1]
                changed = [edited(one[2], two[2]) for one, two in pairs]
                out = []
                for (one, two), text, e in zip(pairs, changed, signatures.of(changed)):
                    _, doc, own, s = one
                    out.append((doc, len(own), hashlib.sha256(text.encode()).hexdigest(), fingerprint(s), fingerprint(e),
                                likeness(s, e), likeness(s, two[3]), similar(s, e), similar(s, two[3])))
                names = [c.split()[0] for c in RESULT.split(", ")]
                yield pd.DataFrame(out, columns=names).assign(doc_id=pd.array([row[0] for row in out], dtype="Int64"))

    return beside_next(docs).mapInPandas(run, RESULT)
