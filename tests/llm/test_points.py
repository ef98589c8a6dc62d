"""The language model of op4 and the pipeline counts real code points."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from reckoner.llm import perplexity

WORDS = "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой весна год от так для".split()


def plain_loss(trusted):
    """Interpolated modified Kneser-Ney over code points by dictionaries: a function from a text to its negative log-likelihood."""
    n = perplexity.ORDER
    symbols = lambda t: [0] * (n - 1) + [ord(c) + 1 for c in t]
    grams = lambda t: [tuple(s[i - n + 1:i + 1]) for s in [symbols(t)] for i in range(n - 1, len(s))]
    counts = {n: Counter(g for t in trusted for g in grams(t))}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    level = {}
    for k, c in counts.items():
        of = [max(1, sum(v == x for v in c.values())) for x in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        cut = [min(max(j + 1 - (j + 2) * y * of[j + 1] / of[j], 0.1), j + 0.95) for j in range(3)]
        total, back = Counter(), Counter()
        for g, v in c.items():
            total[g[:-1]] += v
            back[g[:-1]] += cut[min(v, 3) - 1]
        level[k] = c, cut, total, back

    def p(g):
        if not g:
            return 1 / perplexity.POINTS
        c, cut, total, back = level[len(g)]
        lower = p(g[1:])
        if not total[g[:-1]]:
            return lower
        own = c[g] - cut[min(c[g], 3) - 1] if c[g] else 0
        return own / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * lower

    return lambda t: -sum(math.log(max(1e-12, p(g))) for g in grams(t))


def test_losses_are_kneser_ney_of_code_points(spark, monkeypatch):
    texts = ["The cat sat on the mat.", "Кот сидел на коврике.", "猫坐在垫子上。", "éÉ the 😀 mat", "", None, "The mat sat.", "Кто сидел?", "猫在上", "zzz \U0010ffff"]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[0], None), (0, texts[0], "en"), (2**60 + 1, texts[1], "ru")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in (0, 1, 2, 3, 4, 2**60 + 1, 999)] + [(6, 0), (None, 1)], "doc_id long, quality int")
    held = {r.doc_id for r in docs.where(perplexity.held_out(F.col("doc_id"))).collect()}
    loss = plain_loss([t or "" for i, t, _ in rows if i in (0, 1, 2, 3, 4, 2**60 + 1) and i not in held])
    want = sorted((i is None, i or 0, len(t or ""), round(loss(t or ""), 4)) for i, t, _ in rows)
    for batch in (perplexity.BATCH, 40):  # one batch, and several
        monkeypatch.setattr(perplexity, "BATCH", batch)
        slim, _ = perplexity.losses(docs, labels)
        got = sorted((r.doc_id is None, r.doc_id or 0, r.score.n, round(r.score.loss, 4)) for r in slim.collect())
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-3)


def test_n_grams_reach_over_pieces(monkeypatch):
    texts = ["Кот sat 猫 on 😀 mat. " * 30, "", "ab", "x" * 95]
    whole = [np.concatenate(x) for x in zip(*perplexity.points(texts))]
    for chunk in (1, 2, 7, 100):
        monkeypatch.setattr(perplexity, "CHUNK", chunk)
        assert [np.concatenate(x).tolist() for x in zip(*perplexity.points(texts))] == [x.tolist() for x in whole]
    assert len(whole[0]) == sum(map(len, texts)) and whole[2][:3].tolist() == [ord(c) + 1 for c in "Кот"]


def test_junk_in_another_script_is_rejected(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(150))
    junk = lambda t: "".join(rng.sample(t, len(t)))
    good, fresh = [text() for _ in range(60)], [text() for _ in range(10)]
    rows = [(i, t, "ru") for i, t in enumerate([*good, *fresh, *map(junk, fresh)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(60).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    kept = {r.doc_id: r.kept for r in perplexity.judge(docs, labels).collect()}
    assert all(kept[i] for i in range(60, 70)) and not any(kept[i] for i in range(70, 80))
    stayed = {r.row.doc_id for r in perplexity.scored(docs, labels).where(perplexity.accepted()).select("row").collect()}
    assert stayed == {i for i, k in kept.items() if k}


def test_thresholds_suit_texts_the_model_has_not_seen(spark):
    """Clean texts stay though the model has not counted them: a small model finds its own texts much likelier."""
    rng = random.Random(3)
    alphabet = [chr(0x4E00 + i) for i in range(300)]
    text = lambda: "".join(rng.choices(alphabet, [1 / (i + 1) for i in range(300)], k=400))
    docs = spark.createDataFrame([(i, text(), "zh") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.range(80).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    kept = [r.kept for r in perplexity.judge(docs, labels).where("doc_id >= 80").collect()]
    assert len(kept) == 120 and sum(kept) >= 0.95 * len(kept)
