"""Toxicity by a weighted finite-state pattern grammar.

A clause (text between stops) is read word by word by small transducers that emit typed arcs: insults (a lexicon of words
and of stems with an ending, learned from labelled rows), threats, targets, negation and reported speech (fixed lists). The
arcs of a clause are composed into one match type: a plain insult, one with a target, a negated or a reported one, a threat. The
weights of match types come from a logistic fit on the same rows, so a text is scored by its matched clauses, not
by single words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from reckoner.llm.common import checkpointed, digest_sample

SAMPLE = 12_000  # labelled rows the lexicon and the weights are fitted on, about, at most
MIN_DOCS = 4  # toxic texts that must hold a learned word or stem
MIN_G2 = 21.0  # log-likelihood ratio statistic a learned word or stem must reach
MIN_PURITY = 0.7  # least share of toxic texts among those that hold it
STEMS = range(3, 11)  # letters of a stem; a word matches a stem if it goes on after it
DOMINANT = 0.7  # a stem is no stem if one of its words makes up that share of its texts
THRESHOLD = 0.7
#: Words and word sequences of the grammar's closed classes, in the languages at hand.
TARGETS = set("you your yours u ur youre he she they him her them his their this these those people guy man woman du dich dir ihr euch sie er tu te toi vous ton ta il elle "
              "ils elles tú usted ustedes él ella ellos ellas".split())
NEGATIONS = set("not no never none nobody isn't aren't wasn't don't doesn't nicht kein keine keinen nie niemals pas jamais aucun aucune non nunca jamás ningún ninguna".split())
REPORTS = set("said says say called calls quoted wrote claimed claims reported heard sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())
THREATS = set("kill murder hurt destroy shoot stab strangle burn beat töten umbringen erschießen schlagen tuer frapper brûler matar golpear quemar".split())
INTENTS = set("will gonna going i'll we'll should must werde werden vais va allons voy vamos".split())
INSULTS = set("idiot idiots moron morons stupid pathetic loser losers scum trash worthless disgusting imbecile cretin dumbass asshole bastard".split())
CLAUSE, WORD = re.compile(r"[.!?;:\n\r|()\[\]\"“”«»]+"), re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
REACH = 3  # words between a negation and what it negates
TYPES = ("plain", "targeted", "negated", "reported", "threat")


@dataclass
class Grammar:
    """``words`` and ``stems`` carry weights; ``types`` weighs the match types, ``bias`` stands alone."""
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    types: dict[str, float] = field(default_factory=lambda: dict(zip(TYPES, (4.0, 5.0, 1.5, 2.0, 4.0))))
    bias: float = -3.0

    def insult(self, word: str) -> float:
        """The weight on which the insult transducer accepts ``word``: the word itself, or the longest stem that it goes on after."""
        if word in self.words:
            return self.words[word]
        for n in range(min(len(word) - 1, STEMS.stop - 1), STEMS.start - 1, -1):
            if word[:n] in self.stems:
                return self.stems[word[:n]]
        return 0.0

    def clause(self, words: list[str]) -> dict[str, float]:
        """Weights of the match types of one clause. Each transducer keeps the state it needs: the last negation and the reports and targets so far."""
        out: dict[str, float] = {}
        negated = intent = -REACH - 2
        reported, target, hits = False, False, []
        for i, w in enumerate(words):
            if w in NEGATIONS:
                negated = i
            elif w in REPORTS:
                reported = True
            elif w in INTENTS:
                intent = i
            elif w in THREATS:
                if i - intent <= REACH and i + 1 < len(words) and words[i + 1] in TARGETS and i - negated > REACH:
                    out["threat"] = out.get("threat", 0.0) + 1.0
            else:
                weight = self.insult(w)
                if weight:
                    hits.append((weight, i - negated <= REACH, reported))
                elif w in TARGETS:
                    target = True
        for weight, no, said in hits:
            kind = "negated" if no else "reported" if said else "targeted" if target else "plain"
            out[kind] = out.get(kind, 0.0) + weight
        return out

    def matches(self, text: str) -> np.ndarray:
        """Per match type the summed weight of its clauses, damped so that a long text is not toxic by its length."""
        total, lowered = dict.fromkeys(TYPES, 0.0), text.lower()
        vocabulary = set(WORD.findall(lowered))
        heads = {s[:STEMS.start] for s in self.stems}
        if any(w in self.words or w[:STEMS.start] in heads and self.insult(w) for w in vocabulary) or not vocabulary.isdisjoint(THREATS):
            for clause in CLAUSE.split(lowered):
                for kind, weight in self.clause(WORD.findall(clause)).items():
                    total[kind] += weight
        return np.array([math.log1p(total[t]) for t in TYPES])

    def score(self, text: str | None) -> float:
        x = self.bias + float(np.dot(self.matches(text or ""), [self.types[t] for t in TYPES]))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x))))


def features(text: str) -> set[str]:
    """Words, and stems as ``stem*``."""
    words = set(WORD.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if n < len(w)}


def held_out(doc_id: Column) -> Column:
    """Rows no label may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic): about ``sample`` labelled rows, chosen by a digest of doc_id, one per distinct text. Near copies would pass their words off as
    evidence: of the texts with a common smallest word digest, for each of three digests, one stays."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = digest_sample(known, F.col("_id"), sample)  # bounded, so it may be broadcast
    rows = (docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(known), "_id").withColumn("_at", F.xxhash64("text")))
    words = F.split(F.lower("text"), " ")
    rows = rows.select("text", "toxic", "_at", *[F.array_min(F.transform(words, lambda w, s=s: F.xxhash64(F.lit(s), w))).alias(f"_m{s}") for s in (1, 2, 3)])
    rows = checkpointed(rows)
    for key in ("_at", "_m1", "_m2", "_m3"):  # within the bounded sample
        rows = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct("toxic", "_at", "text")).alias("r")).select("r.*")
    return rows.select("text", "toxic")


def _count(rows: DataFrame, wanted: set[str] | None = None) -> Counter:
    """Texts that hold each feature (of ``wanted``)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter()
        for frame in frames:
            for text in frame["text"]:
                found = features(text)
                n.update(found if wanted is None else found & wanted)
        if n:  # a frame without rows has no text column
            yield pd.DataFrame({"feature": list(n.keys()), "n": list(n.values())})

    total = rows.select("text").mapInPandas(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    return Counter({r["feature"]: r["n"] for r in (total if wanted is not None else total.where(F.col("n") >= MIN_DOCS)).collect()})


def g2(a: float, b: float, n1: float, n0: float) -> float:
    """Log-likelihood ratio statistic of a feature in ``a`` of ``n1`` and ``b`` of ``n0`` texts."""
    p = (a + b) / (n1 + n0)
    term = lambda k, n, q: k * math.log(q) + (n - k) * math.log1p(-q) if 0 < q < 1 else 0.0
    return 2 * (term(a, n1, a / n1) + term(b, n0, b / n0) - term(a, n1, p) - term(b, n0, p))


def lexicon(toxic: Counter, clean: Counter, n1: int, n0: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems that tell toxic texts, with weights of 1 to about 2. A stem is kept at its shortest; words under it are left to it."""
    good = {}
    for feature, a in toxic.items():
        b = clean[feature]
        if a >= MIN_DOCS and a / (a + b) >= MIN_PURITY and g2(a, b, n1, n0) >= MIN_G2:
            good[feature] = min(2.0, 1.0 + math.log10(a / (a + b) * n0 / n1 + 1) / 2)
    single = Counter()  # the most texts of one word under each stem
    for feature, a in toxic.items():
        if not feature.endswith("*"):
            for n in STEMS:
                if n < len(feature):
                    single[feature[:n]] = max(single[feature[:n]], a)
    stems = {f[:-1]: w for f, w in good.items() if f.endswith("*") and single[f[:-1]] < DOMINANT * toxic[f]}
    stems = {s: w for s, w in stems.items() if not any(s[:n] in stems for n in range(STEMS.start, len(s)))}
    covered = lambda w: any(w[:n] in stems for n in range(STEMS.start, len(w)))
    return {f: w for f, w in good.items() if not f.endswith("*") and not covered(f)}, stems


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the bias) by Newton's method, drawn to ``prior``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.astype(float).copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + strength * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """Learn the lexicon and the weights. Without labels the fixed lexicon and weights hold."""
    rows = checkpointed(training(docs, labels, sample))
    toxic, clean = rows.where("toxic = 1"), rows.where("toxic != 1")
    n1, n0 = toxic.count(), clean.count()
    words, stems = {w: 1.5 for w in INSULTS}, {}
    if n1 and n0:
        counts = _count(toxic)
        more, stems = lexicon(counts, _count(clean, set(counts)), n1, n0)
        words = {**words, **more}
    grammar = Grammar(words, stems)

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([grammar.matches(t) for t in frame["text"]]).reshape(-1, len(TYPES)).round(6)
            yield pd.DataFrame(x, columns=list(TYPES)).assign(toxic=frame["toxic"].to_numpy())

    if n1 and n0:
        found = rows.mapInPandas(match, ", ".join(f"{t} double" for t in TYPES) + ", toxic int").toPandas()  # five numbers per sampled row
        found = found.sort_values([*TYPES, "toxic"])
        weight = logistic(found[list(TYPES)].to_numpy(), found["toxic"].to_numpy(dtype=float), np.array([*grammar.types.values(), grammar.bias]))
        grammar.types, grammar.bias = dict(zip(TYPES, np.maximum(weight[:-1], 0.0).tolist())), float(weight[-1])
    return grammar


def scorer(grammar: Grammar):
    """A function from a text column to the score (0 to 1) of each whole text; NULL text is empty."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series([grammar.score(x) for x in series], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document; doc_id NULL is not held out. Repeated rows get the same score."""
    score = scorer(fit(docs, labels))(F.col("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score.alias("score")).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"))
