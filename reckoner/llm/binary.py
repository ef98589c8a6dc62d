"""Token ids as a compressed binary table: canonical length-limited Huffman codes of ids, from global counts.

Format, two Parquet tables in one folder. ``codes``: (id, bits), the code length of every id that occurs;
the codes themselves are canonical (by length, then id). ``segments``: whole documents in ascending order, about
a million ids in a row: (part, segment, doc_ids, n_tokens, n, checkpoints, payload). ``payload`` is the bit stream, most
significant bit first; ``checkpoints`` has the bit offset of every block of BLOCK ids, so that blocks are
decoded independently of each other. ``(part, segment)`` orders the segments: ``segment`` is the row
of its first document in the part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reckoner.llm import tokens
from reckoner.llm.common import partitions, written_table

END_ID = 0
MAX_BITS = 18  # longest code; a decoder's table has 2^18 entries, small enough for a core's cache
SOME = 65_536  # ids that are encoded at once
KEPT_BYTES = 120_000_000  # of the units whose ids a worker keeps
CHARS = 8_000_000  # characters that are encoded at once, about
BLOCK = 512  # ids from one checkpoint to the next
SEGMENT = 1_000_000  # ids after which a segment is closed (at the end of a document)
SEGMENTS = ("part int, segment long, doc_ids array<long>, n_tokens array<long>, n long, "
            "checkpoints array<long>, payload binary")
DECODED = "part int, segment long, position int, doc_id long, before long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive ``counts``, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype="int64")
    if n > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype("float64")
    levels, packages = [], np.empty(0)
    for _ in range(max_bits):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < n)  # in order of weight: is it a leaf?
        merged = weights[rank]
        packages = merged[0:len(merged) // 2 * 2:2] + merged[1::2]
    lengths, take = np.zeros(n, dtype="int64"), 2 * n - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.empty(n, dtype="int64")
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, bits, codes) in canonical order: by length, then id."""
    order = np.lexsort((ids, bits))
    ids, bits = ids[order], bits[order]
    top = int(bits[-1]) if len(bits) else 1
    starts = np.concatenate([[0], np.cumsum(1 << (top - bits))[:-1]]) if len(bits) else np.zeros(0, dtype="int64")
    return ids, bits, starts.astype("int64") >> (top - bits)


class Code:
    """Encoder and decoder tables of a canonical code."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        ids, bits, codes = canonical(np.asarray(ids, dtype="int64"), np.asarray(bits, dtype="int64"))
        size = int(ids.max(initial=0)) + 1
        self.bits, self.codes = np.zeros(size, dtype="uint64"), np.zeros(size, dtype="uint64")
        self.bits[ids], self.codes[ids] = bits, codes
        self.top = int(bits[-1]) if len(bits) else 1
        repeat = 1 << (self.top - bits)
        self.symbol, self.used = np.repeat(ids, repeat).astype("uint32"), np.repeat(bits, repeat).astype("uint8")
        missing = (1 << self.top) - len(self.symbol)  # a code of a single id fills half the table
        self.symbol, self.used = np.pad(self.symbol, (0, missing)), np.pad(self.used, (0, missing), constant_values=1)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit stream, and the bit offset of every block."""
        sizes = self.bits[ids]
        ends = np.cumsum(sizes, dtype="uint64")
        if not len(ids):
            return b"", np.zeros(0, dtype="int64")
        stream = np.zeros(int(ends[-1] >> np.uint64(6)) + 2, dtype="uint64")
        for at in range(0, len(ids), SOME):  # in pieces that stay in the cache
            bits, codes = sizes[at:at + SOME], self.codes[ids[at:at + SOME]]
            starts = ends[at:at + SOME] - bits
            word, last = (starts >> np.uint64(6)).astype("int64"), (starts & np.uint64(63)) + bits
            fits = last <= 64
            part = np.where(fits, codes << (np.uint64(64) - np.minimum(last, 64)), codes >> (np.maximum(last, 64) - np.uint64(64)))
            first = np.flatnonzero(np.diff(word, prepend=-1))
            stream[word[first]] |= np.bitwise_or.reduceat(part, first)
            over = np.flatnonzero(~fits)
            stream[word[over] + 1] |= codes[over] << (np.uint64(128) - last[over])
        return stream.astype(">u8").tobytes()[:(int(ends[-1]) + 7) // 8], (ends - sizes)[::BLOCK].astype("int64")

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """``n`` ids: all blocks step through the table side by side."""
        raw = np.frombuffer(payload + bytes(16), dtype="uint8").astype("uint64")
        at = np.asarray(checkpoints, dtype="int64").copy()
        out = np.zeros((BLOCK, len(at)), dtype="uint32")
        full, tail = len(at) - (n % BLOCK > 0), n % BLOCK
        mask = np.uint64((1 << self.top) - 1)
        window = (raw[:-3] << np.uint64(24)) | (raw[1:-2] << np.uint64(16)) | (raw[2:-1] << np.uint64(8)) | raw[3:]
        for i in range(BLOCK):
            live = slice(None) if i < tail or not tail else slice(0, full)
            now = at[live]
            if not len(now):
                break
            shift = (32 - self.top - (now & 7)).astype("uint64")  # top <= 24, so 32 bits hold any code
            code = ((window[now >> 3] >> shift) & mask).astype("int64")
            out[i, live] = self.symbol[code]
            at[live] += self.used[code]
        return out.T.reshape(-1)[:n]


def token_table(docs: DataFrame, path: str, units: str) -> DataFrame:
    """Ids of all documents with the end id, written in ascending order of (doc_id, text): (part, row, doc_id, ids), NULL doc_id first, NULL text
    empty; rows with part -1 hold the counts of all ids that a task has met. Texts are range-partitioned by doc_id (and the first characters, so that rows of one id need not share a task) before they are encoded once; ids that fit take two bytes."""
    def ids_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, total = tokens.encoder(path, units, KEPT_BYTES).encode, np.zeros(0, dtype="int64")
        for frame in frames:
            texts = frame["text"].tolist()
            for low, high in tokens.batches(texts, CHARS):
                ids = [np.append(np.frombuffer(x, dtype="<u4"), np.uint32(END_ID)) for x in encode(texts[low:high])]
                some = np.bincount(np.concatenate(ids), minlength=len(total))
                some[:len(total)] += total
                total = some
                wide = [bool(x.max() > 0xFFFF) for x in ids]
                yield frame.iloc[low:high].drop(columns="text").assign(
                    wide=wide, ids=[x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide)], counts=None)
        if len(total):  # what the task has met, in a row of its own
            yield pd.DataFrame({"part": [-1], "row": [0], "doc_id": [None], "wide": [False], "ids": [None], "counts": [total.astype("<i8").tobytes()]})

    spark = docs.sparkSession
    ordered = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .withColumn("head", F.substring("text", 1, 16))
               .repartitionByRange(partitions(spark), "doc_id", "head").sortWithinPartitions("doc_id", "text")
               .withColumn("at", F.monotonically_increasing_id())
               .select(F.shiftright("at", 33).cast("int").alias("part"),
                       F.col("at").bitwiseAND(F.lit(2**33 - 1)).alias("row"), "doc_id", "text"))
    return written_table(ordered.mapInPandas(ids_of, "part int, row long, doc_id long, wide boolean, ids binary, counts binary"), "token-ids", "zstd")


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u4" if wide else "<u2")


def id_counts(token_ids: DataFrame) -> DataFrame:
    """(id, n) over all documents, from the counts that each task has written."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["counts"]:
                total = np.frombuffer(raw, dtype="<i8")
                found = np.flatnonzero(total)
                yield pd.DataFrame({"id": found, "n": total[found]})

    return token_ids.where("part < 0").select("counts").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, folder: str, path: str, units: str) -> None:
    """Write all ``docs`` to ``folder`` in the format above. An empty table gives tables without rows."""
    token_ids = token_table(docs, path, units)
    counts = id_counts(token_ids).toPandas().sort_values("id")  # at most a row per entry of the vocabulary
    bits = code_lengths(counts["n"].to_numpy())
    spark = docs.sparkSession
    spark.createDataFrame(pd.DataFrame({"id": counts["id"].astype("int64"), "bits": bits.astype("int64")}), "id long, bits long") \
        .coalesce(1).write.parquet(f"{folder}/codes")
    shared = spark.sparkContext.broadcast((counts["id"].to_numpy(), bits))

    def segments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code, held, size, last = Code(*shared.value), [], 0, (None, None)
        for frame in frames:
            for at, row, doc, raw, wide in zip(frame["part"], frame["row"], frame["doc_id"], frame["ids"], frame["wide"]):
                if held and (size >= SEGMENT or (at, row) != (last[0], last[1] + 1)):  # a task may read pieces of several parts
                    yield segment(code, *first, held)
                    held, size = [], 0
                if not held:
                    first = at, row
                last, ids = (at, row), _ids(raw, wide)
                held.append((None if pd.isna(doc) else int(doc), ids))
                size += len(ids)
        if held:
            yield segment(code, *first, held)

    token_ids.where("part >= 0").drop("counts").mapInPandas(segments, SEGMENTS).write.option("compression", "none").parquet(f"{folder}/segments")


def segment(code: Code, part: int, row: int, held: list[tuple[int | None, np.ndarray]]) -> pd.DataFrame:
    """A row of the file: the documents from ``row`` of ``part`` on."""
    ids = np.concatenate([x for _, x in held])
    payload, checkpoints = code.encode(ids)
    return pd.DataFrame({"part": [part], "segment": [row], "doc_ids": [[d for d, _ in held]], "n_tokens": [[len(x) for _, x in held]],
                         "n": [len(ids)], "checkpoints": [checkpoints], "payload": [payload]})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents decoded from the files: (doc_id, start, n_tokens, ids_crc32) in the order of the file; ``start`` is the number of ids
    before the document. Use ``decoded`` for the ids themselves."""
    segments = spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
    sizes = segments.select("part", "segment", "n")
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    starts = sizes.groupBy("part").agg(F.sum("n").alias("_all")).select("part", F.coalesce(F.sum("_all").over(parts), F.lit(0)).alias("_part"))
    offsets = sizes.join(starts, "part").select("part", "segment", (F.col("_part") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("_start"))
    return decoded(spark, folder).join(offsets, ["part", "segment"]).select(
        "doc_id", (F.col("_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def decoded(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of each segment with their digest, and with ``ids`` on demand."""
    codes = spark.read.parquet(f"{folder}/codes").toPandas()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast((codes["id"].to_numpy(), codes["bits"].to_numpy()))

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(*shared.value)
        for frame in frames:
            for r in frame.itertuples():
                ids = code.decode(r.payload, r.checkpoints, r.n).astype("<u4")
                ends = np.cumsum(np.asarray(r.n_tokens, dtype="int64"))
                rows = [ids[e - n:e].tobytes() for e, n in zip(ends, r.n_tokens)]
                out = pd.DataFrame({"part": r.part, "segment": r.segment, "position": range(len(rows)),
                                    "doc_id": pd.array([None if pd.isna(d) else int(d) for d in r.doc_ids], dtype="Int64"),
                                    "before": ends - np.asarray(r.n_tokens), "n_tokens": r.n_tokens,
                                    "ids_crc32": [zlib.crc32(x) for x in rows]})
                yield out.assign(ids=rows) if with_ids else out

    return spark.read.schema(SEGMENTS).parquet(f"{folder}/segments").mapInPandas(unpack, DECODED + ", ids binary" * with_ids)
