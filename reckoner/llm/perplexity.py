"""Quality by perplexity: an interpolated modified Kneser-Ney model of code points, trained on trusted text.

A symbol is a code point, so every letter of every script counts for itself, and the model grows with the text. Documents are dealt to
batches of about BATCH bytes by their ids. A batch counts its n-grams of order 4 in one pass, those of trusted documents by number and the others as
asked for; the counts are sharded by n-gram. Discounts, continuation counts and context totals are aggregates and joins of these tables. The probability of each n-gram goes back to the
batches that hold it, where it is summed over the characters of each document: no task and no driver sees the whole model. A document's perplexity is drawn to the mean
of its language by PRIOR characters, so that a few words are no evidence, and compared with a quantile of the trusted documents of its language.

``train`` makes the same model over 64 classes of characters as one dense table of at most 64^4 cells, for callers who want a small model in memory; ``judge`` and ``scored`` do not use it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from reckoner.llm.common import whole_row, written_table
from reckoner.operators.keyed import with_key_values

ORDER, CLASSES = 4, 64
PRIOR = 200  # characters of the language's mean that are added to a document
QUANTILE, SLACK = 0.99, 0.05  # of the trusted documents' log perplexity, and what is allowed above it
MIN_TRUSTED = 30  # trusted documents a language needs for a threshold of its own
MAX_LANGUAGES = 8_000  # languages with a threshold of their own; ISO 639 has fewer
BIN = 1_000  # log perplexities are compared in bins of 1 / BIN
CHUNK = 1_000_000  # characters that are scored at once
BITS, POINTS = 21, 0x110000  # a code point takes 21 bits, so the three before a character fit a BIGINT; there are POINTS of them
HELD = 8  # one trusted document in HELD is not counted but shows how much likelier the model finds the texts it has seen
BATCH = 32 * 2**20  # bytes of text in a batch, about


def _classes() -> np.ndarray:
    """Class of each code point below 0x250; those above are letters of other scripts."""
    out = np.full(0x251, 61, dtype="uint8")
    for c in range(0x250):
        ch = chr(c)
        if ch in " \t":
            out[c] = 1
        elif ch in "\r\n":
            out[c] = 2
        elif "a" <= ch <= "z":
            out[c] = 3 + c - ord("a")
        elif "A" <= ch <= "Z":
            out[c] = 29 + c - ord("A")
        elif ch.isdigit():
            out[c] = 55
        elif ch in ".,":
            out[c] = 56 + ".,".index(ch)
        elif ch in "!?":
            out[c] = 58
        elif ch in "-'\"():;":
            out[c] = 59
        elif c < 128:
            out[c] = 60
        elif ch.isupper():
            out[c] = 62
        elif not ch.isalpha():
            out[c] = 63 if unicodedata.category(ch) != "Zs" else 1
    return out


CLASS = _classes()


def symbols_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return CLASS[np.minimum(points, 0x250)].astype("int32")


def grams(text: str, before: str = "") -> np.ndarray:
    """The n-gram of order ORDER that ends at each character, as a number in base CLASSES; class 0 stands before a text. ``before``: up to ORDER - 1
    characters that come before ``text``."""
    lead = symbols_of(before)
    symbols = np.concatenate([np.zeros(ORDER - 1 - len(lead), dtype="int32"), lead, symbols_of(text)])
    out = symbols[ORDER - 1:].copy()
    for k in range(1, ORDER):
        out += symbols[ORDER - 1 - k:len(symbols) - k] * CLASSES**k
    return out


def pieces(text: str, chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """The n-grams of a text in pieces of ``chunk`` characters: memory stays bounded, and n-grams reach over the borders."""
    for at in range(0, len(text), chunk):
        yield grams(text[at:at + chunk], text[max(0, at - ORDER + 1):at])


def counts(trusted: DataFrame) -> DataFrame:
    """(gram, n) over the whole texts of all trusted documents. A task sends one row per n-gram that it has met."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, n = np.zeros(0, dtype="int32"), np.zeros(0, dtype="int64")  # what the task has met, sorted
        for frame in frames:
            held, size = [], 0
            for text in [*frame["text"], None]:
                for piece in pieces(text or ""):
                    held.append(piece)
                    size += len(piece)
                if size and (size >= CHUNK or text is None):
                    more, m = np.unique(np.concatenate(held), return_counts=True)
                    at = np.searchsorted(gram, more)
                    known = at < len(gram)
                    known[known] = gram[at[known]] == more[known]
                    n[at[known]] += m[known]
                    gram, n = np.insert(gram, at[~known], more[~known]), np.insert(n, at[~known], m[~known])
                    held, size = [], 0
        yield pd.DataFrame({"gram": gram.astype("int64"), "n": n})

    return trusted.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def discounted(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, share) and (context, back) of one order: the discounted share of each n-gram in its context, and the mass the context leaves to
    the order below. ``level`` has (gram, n)."""
    has = level.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(1, x or 0) for x in has)
    y = n1 / (n1 + 2 * n2)
    cut = [min(max(k - (k + 1) * y * after / now, 0.1), k - 0.05) for k, now, after in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    discount = F.when(F.col("n") == 1, cut[0]).when(F.col("n") == 2, cut[1]).otherwise(cut[2])
    split = level.select("gram", "n", F.floor(F.col("gram") / CLASSES).alias("context"), discount.alias("cut"))
    contexts = split.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cut_total"))
    shares = split.join(contexts.select("context", "total"), "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share"))
    return shares, contexts.select("context", (F.col("cut_total") / F.col("total")).alias("back"))


Levels = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def levels(trusted: DataFrame) -> Levels:
    """The model in short, from order 1 up: n-grams with their discounted shares, and contexts with the mass they leave to the order below. From the texts of ``trusted`` (not empty
    ones only); the driver receives the n-grams that occur, at most CLASSES^ORDER."""
    level = written_table(counts(trusted), "ngrams")
    out = []
    for k in range(ORDER, 0, -1):
        shares, contexts = (x.toPandas() for x in discounted(level))
        out.append((shares["gram"].to_numpy(dtype="int32"), shares["share"].to_numpy(dtype="float32"),
                    contexts["context"].to_numpy(dtype="int32"), contexts["back"].to_numpy(dtype="float32")))
        if k > 1:  # continuation counts: how many classes stand before the shorter n-gram
            level = level.groupBy((F.col("gram") % CLASSES**(k - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    return out[::-1]


def dense(model: Levels) -> np.ndarray:
    """Natural logarithms of the probabilities of all CLASSES^ORDER n-grams; without any text all classes are equally likely."""
    p = np.full(CLASSES, 1 / CLASSES, dtype="float32")
    for k, (gram, share, context, mass) in enumerate(model, start=1):
        back = np.ones(CLASSES**(k - 1), dtype="float32")
        back[context] = mass
        lower, p = p, np.repeat(back, CLASSES)
        p.reshape(-1, len(lower))[:] *= lower  # in place: an n-gram backs off to its end
        p[gram] += share
    return np.log(np.maximum(p, 1e-12, out=p), out=p)


def train(trusted: DataFrame) -> np.ndarray:
    """The whole model of ``trusted``, see ``dense``."""
    return dense(levels(trusted))


# ---------------------------------------------------------------- scores of code points

def points(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, context, symbol) of all characters in pieces of about CHUNK: the number of the text, the ORDER - 1 symbols before the character as one number, and its own. A symbol is
    a code point plus one; 0 stands before a text. N-grams reach over the borders of pieces."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            lead = min(at, ORDER - 1)
            code = np.frombuffer(text[at - lead:at + CHUNK].encode("utf-32-le", "replace"), dtype="<u4").astype("int64") + 1
            code = np.concatenate([np.zeros(ORDER - 1 - lead, dtype="int64"), code])
            held.append((row, code[:-3] << 2 * BITS | code[1:-2] << BITS | code[2:-1], code[3:]))
            size += len(code) - ORDER + 1
            if size >= CHUNK:
                yield _together(held)
                held, size = [], 0
    if held:
        yield _together(held)


def _together(held: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, contexts, symbols = zip(*held)
    return np.repeat(rows, [len(x) for x in symbols]), np.concatenate(contexts), np.concatenate(symbols)


def distinct(contexts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, context, symbol): which of the different n-grams each one is, and these."""
    code, context = pd.factorize(contexts)
    number, gram = pd.factorize(code.astype("int64") << BITS | symbols)
    return number, context[gram >> BITS], gram & (1 << BITS) - 1


def text_key(doc_id: Column, text: Column) -> Column:
    """A digest of id and text (NULL: empty)."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text.cast("string"), F.lit(""))))


def batched(docs: DataFrame) -> tuple[DataFrame, int]:
    """(batch, key, doc_id, lang, packed): compressed texts (NULL: empty), dealt by doc_id, or by text where that is NULL. ``key`` stands for id and text; ids are text, as pandas
    has no whole numbers beside NULL. And the number of batches."""
    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // BATCH))

    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=3)
        for series in texts:
            yield pd.Series([packer.compress(x.encode("utf-8", "replace")) for x in series], dtype=object)

    rows = docs.select(dealt(F.coalesce(doc, F.xxhash64(text)), n).alias("batch"), text_key(doc, text).alias("key"), doc.cast("string").alias("doc_id"),
                       F.col("lang").cast("string").alias("lang"), F.pandas_udf(pack, "binary")(text).alias("packed"))
    return rows, n


def dealt(number: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(number), F.lit(n)).cast("int")


def unpacked(packed: Iterable[bytes]) -> Iterator[str]:
    unpacker = zstandard.ZstdDecompressor()
    return (unpacker.decompress(x).decode() for x in packed)


def asked(docs: DataFrame, good: DataFrame, n: int) -> DataFrame:
    """(batch, context, symbol, n): the different n-grams of each batch of ``docs``, and how often they occur in documents whose ids are in ``good``."""
    def count(docs: pd.DataFrame, good: pd.DataFrame) -> pd.DataFrame:
        trusted, found = docs["doc_id"].isin(good["doc_id"]).to_numpy(), []
        for row, contexts, symbols in points(unpacked(docs["packed"])):
            number, context, symbol = distinct(contexts, symbols)
            found.append((context, symbol, np.bincount(number, weights=trusted[row], minlength=len(symbol)).astype("int64")))
        if not found:
            return pd.DataFrame({"batch": [], "context": [], "symbol": [], "n": []})
        contexts, symbols, ns = (np.concatenate(x) for x in zip(*found))
        number, context, symbol = distinct(contexts, symbols)
        total = np.zeros(len(symbol), dtype="int64")
        np.add.at(total, number, ns)
        return pd.DataFrame({"batch": docs["batch"].iloc[0], "context": context, "symbol": symbol, "n": total})

    ids = good.select(dealt(F.col("_id"), n).alias("batch"), F.col("_id").cast("string").alias("doc_id"))
    return docs.groupBy("batch").cogroup(ids.groupBy("batch")).applyInPandas(count, "batch int, context long, symbol int, n long")


def logarithms(grams: DataFrame) -> DataFrame:
    """(context, symbol, batches, logp) of ``grams`` (context, symbol, n, batches): natural logarithms of the probabilities. Those with n = 0 are asked for but do not count. Each order is a table
    of its own, and takes what its contexts leave from the probabilities of the order below."""
    levels = [grams]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols stand before the shorter n-gram
        shorter = (F.col("context") % F.lit(2**(BITS * (k - 1)))).alias("context")
        levels.append(levels[-1].groupBy(shorter, "symbol").agg(F.count(F.when(F.col("n") > 0, 1)).alias("n")))
    below = None
    for k, level in enumerate(levels[::-1], start=1):
        rows = level.crossJoin(F.broadcast(cuts(level))).withColumn("cut", F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, F.col("cut1")).when(
            F.col("n") == 2, F.col("cut2")).otherwise(F.col("cut3"))).drop("cut1", "cut2", "cut3")
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("back"))
        rows, lower = rows.join(contexts, "context"), F.lit(1.0 / POINTS)
        if below is not None:
            rows = rows.withColumn("_shorter", F.col("context") % F.lit(2**(BITS * (k - 2)))).join(
                below.select(F.col("context").alias("_shorter"), "symbol", F.col("p").alias("_lower")), ["_shorter", "symbol"])
            lower = F.col("_lower")
        p = F.when(F.col("total") > 0, (F.col("n") - F.col("cut") + F.col("back") * lower) / F.col("total")).otherwise(lower)
        below = rows.select(*level.columns, p.alias("p"))
    return below.select("context", "symbol", "batches", F.log(F.greatest("p", F.lit(1e-12))).alias("logp"))


def cuts(level: DataFrame) -> DataFrame:
    """One row: the discounts cut1, cut2, cut3 of n-grams that occur once, twice and more often."""
    n1, n2, n3, n4 = (F.greatest(F.count(F.when(F.col("n") == k, 1)), F.lit(1)) for k in (1, 2, 3, 4))
    found = level.agg(n1.alias("n1"), n2.alias("n2"), n3.alias("n3"), n4.alias("n4"))
    y = F.col("n1") / (F.col("n1") + F.lit(2) * F.col("n2"))
    return found.select(*[F.least(F.greatest(F.lit(k) - F.lit(k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.1)), F.lit(k - 0.05)).alias(f"cut{k}")
                          for k in (1, 2, 3)])


def summed(docs: DataFrame, logs: DataFrame) -> DataFrame:
    """(key, doc_id, lang, score) per document: the negative log-likelihood of the whole text and its characters, from the logarithms of its batch."""
    def add(docs: pd.DataFrame, logs: pd.DataFrame) -> pd.DataFrame:
        known, number = np.unique(logs["context"].to_numpy(), return_inverse=True)
        gram = number.astype("int64") << BITS | logs["symbol"].to_numpy()
        order = np.argsort(gram)
        gram, logp = gram[order], logs["logp"].to_numpy()[order]
        loss, n = np.zeros(len(docs)), np.zeros(len(docs), dtype="int64")
        for row, contexts, symbols in points(unpacked(docs["packed"])):
            code, context, symbol = distinct(contexts, symbols)
            of = logp[np.searchsorted(gram, np.searchsorted(known, context) << BITS | symbol)]
            loss -= np.bincount(row, weights=of[code], minlength=len(docs))
            n += np.bincount(row, minlength=len(docs))
        return docs[["key", "doc_id", "lang"]].assign(loss=loss, n=n)

    out = docs.groupBy("batch").cogroup(logs.groupBy("batch")).applyInPandas(add, "key string, doc_id string, lang string, loss double, n long")
    return out.select("key", F.col("doc_id").cast("long").alias("doc_id"), "lang", F.struct("loss", "n").alias("score"))


def log_perplexity(score: Column, mean: Column) -> Column:
    """Per character, drawn to ``mean`` by PRIOR characters."""
    return (score["loss"] + PRIOR * mean) / (score["n"] + PRIOR)


def thresholds(scores: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(lang, mean, threshold) from trusted rows (lang, score): the exact quantile of the binned log perplexities per language. The row with
    lang NULL, from all rows, serves languages (and NULL) with fewer than MIN_TRUSTED rows."""
    rows = scores.select("lang", "score").withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).where(~F.col("_own") | F.col("lang").isNotNull())
    rows = rows.withColumn("lang", F.when(F.col("_own"), F.col("lang")))
    means = rows.groupBy("lang").agg((F.sum("score.loss") / F.greatest(F.sum("score.n"), F.lit(1))).alias("mean"), F.count(F.lit(1)).alias("_rows"))
    means = means.where(F.col("lang").isNull() | (F.col("_rows") >= MIN_TRUSTED)).orderBy(F.col("lang").isNull().desc(), F.col("_rows").desc(), "lang").limit(MAX_LANGUAGES)
    means = written_table(means, "language-means")
    bins = (rows.join(F.broadcast(means), rows["lang"].eqNullSafe(means["lang"])).drop(means["lang"])
            .groupBy("lang", "mean", "_rows", F.ceil(log_perplexity(F.col("score"), F.col("mean")) * BIN).alias("_bin")).agg(F.count(F.lit(1)).alias("_n")))
    upto = F.sum("_n").over(Window.partitionBy("lang").orderBy("_bin"))
    return (bins.withColumn("_upto", upto).where(F.col("_upto") >= quantile * F.col("_rows"))
            .groupBy("lang", "mean").agg((F.min("_bin") / BIN + slack).alias("threshold")))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of the rows marked as good by every label."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1").select("_id")


def held_out(doc_id: Column) -> Column:
    """Is the trusted document kept out of the counts?"""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit("held")), F.lit(HELD)) == 0


def as_unseen(trusted: DataFrame) -> DataFrame:
    """(lang, score) of ``trusted`` rows (doc_id, lang, score), where those that the model has counted are as unlikely as others would be: the mean loss per character of
    their language's held-out documents less that of the counted ones is added. Without held-out text of the language, nothing is."""
    rows = trusted.select("lang", "score", held_out(F.col("doc_id")).alias("_held"))
    per = lambda held: F.sum(F.when(F.col("_held") == held, F.col("score.loss"))) / F.nullif(F.sum(F.when(F.col("_held") == held, F.col("score.n"))), F.lit(0))
    gaps = rows.groupBy("lang").agg(F.greatest(F.coalesce(per(True) - per(False), F.lit(0.0)), F.lit(0.0)).alias("_gap"))
    added = F.when(F.col("_held"), F.lit(0.0)).otherwise(F.col("_gap") * F.col("score.n"))
    return with_key_values(rows, gaps, ["lang"]).select("lang", F.struct((F.col("score.loss") + added).alias("loss"), F.col("score.n").alias("n")).alias("score"))


def losses(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, lang, score) of all documents under the model of the trusted text, that of documents with quality 1 in ``labels`` (but those held out), and the trusted ids. Labels grow with the documents,
    so they are never broadcast. The n-grams and the scores are written tables."""
    good, (rows, n) = trusted_ids(labels), batched(docs)
    grams = asked(rows, good.where(~held_out(F.col("_id"))), n).groupBy("context", "symbol").agg(F.sum("n").alias("n"), F.collect_list("batch").alias("batches"))
    logs = logarithms(written_table(grams, "ngrams")).select(F.explode("batches").alias("batch"), "context", "symbol", "logp")
    return written_table(summed(rows, logs), "scores"), good.hint("merge")  # the same plan at every size


def limited(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (_of: the language, score) with ``loss``, ``chars``, ``log_perplexity`` and ``threshold``. A language without a threshold of its own has that of
    all; without trusted rows there is none (NULL)."""
    every = limits.where("lang is null").select(F.col("mean").alias("_mean0"), F.col("threshold").alias("_threshold0"))
    own = limits.where("lang is not null").select(F.col("lang").alias("_lang"), F.col("mean").alias("_mean"), F.col("threshold").alias("_own"))
    out = rows.join(F.broadcast(own), F.col("_of") == F.col("_lang"), "left")  # at most MAX_LANGUAGES rows
    out = out.join(F.broadcast(every), F.lit(True), "left")  # one row, or none
    return out.select(*[c for c in rows.columns if c not in ("_of", "score")], F.col("score.loss").alias("loss"), F.col("score.n").alias("chars"),
                      log_perplexity(F.col("score"), F.coalesce("_mean", "_mean0", F.lit(0.0))).alias("log_perplexity"),
                      F.coalesce("_own", "_threshold0").alias("threshold"))


def scored(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(row, loss, chars, log_perplexity, threshold) per document: the whole row, and the threshold of its language. NULL and empty texts have the mean of their
    language. Each text is scored once; whole rows meet their scores by id and text."""
    slim, limits = judged(docs, labels, quantile, slack)
    once = slim.groupBy(F.col("key").alias("_key")).agg(F.any_value("score").alias("score"))
    rows = docs.select(whole_row(docs)).select("row", F.col("row.lang").cast("string").alias("_of"), text_key(F.col("row.doc_id"), F.col("row.text")).alias("_key"))
    return limited(rows.join(once.hint("merge"), "_key").drop("_key"), limits)


def judged(docs: DataFrame, labels: DataFrame, quantile: float, slack: float) -> tuple[DataFrame, DataFrame]:
    """The scores of all documents, see ``losses``, and the thresholds of the languages."""
    slim, good = losses(docs, labels)
    trusted = slim.join(good, slim["doc_id"] == good["_id"], "left_semi")
    return slim, written_table(thresholds(as_unseen(trusted), quantile, slack), "thresholds")


def accepted() -> Column:
    """Is the perplexity within the threshold of the language (or is there none)?"""
    return F.col("threshold").isNull() | (F.col("log_perplexity") <= F.col("threshold"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """(doc_id, lang, n_chars, log_perplexity, perplexity, threshold, kept) per document; repeated rows stay. ``n_chars`` counts the characters of the text. Each text is
    scored once."""
    slim, limits = judged(docs, labels, quantile, slack)
    slim = slim.drop("key")
    rows = limited(slim.withColumn("_of", F.col("lang")), limits)
    return rows.select("doc_id", "lang", F.col("chars").alias("n_chars"), "log_perplexity", F.exp("log_perplexity").alias("perplexity"), "threshold", accepted().alias("kept"))
