"""Learned operators: held-out accuracy, brute force for the language model, and given pages for the extraction."""

import math
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reckoner.llm import html, perplexity, toxicity
from reckoner.llm.queries import QUERIES
from tests.llm.conftest import SF

LARGER = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    rows = QUERIES["op7_toxicity"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("held_out").collect()
    hits, found, true = (sum(f(r) for r in rows) for f in (lambda r: r.toxic and r.predicted, lambda r: r.predicted, lambda r: r.toxic))
    assert hits >= 0.95 * found and hits >= 0.5 * true
    assert sum(r.toxic == r.predicted for r in rows) >= 0.9 * len(rows)
    order = sorted(rows, key=lambda r: r.score)
    rank = {id(r): i for i, r in enumerate(order)}
    auc = (sum(rank[id(r)] for r in rows if r.toxic) - true * (true - 1) / 2) / (true * (len(rows) - true))
    assert auc >= 0.75


def test_labels_of_held_out_rows_are_not_read(spark, docs, labels):
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert (a.words, a.stems, a.types, a.bias) == (b.words, b.stems, b.types, b.bias)


def test_grammar_scores_clauses():
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, 1.5))
    assert g.clause("you are an idiot".split()).keys() == {"targeted"} and g.clause("what an idiot".split()).keys() == {"plain"}
    assert g.clause("you are not an idiot".split()).keys() == {"negated"} and g.clause("he said idiot".split()).keys() == {"reported"}
    assert g.clause("i will kill you".split()).keys() == {"threat"} and not g.clause("i will not kill you".split()) and not g.clause("they kill time".split())
    assert g.score("You are an idiot.") > 0.7 > g.score("You are not an idiot.") > g.score("A fine day.") == g.score(None) == g.score("")
    assert g.score("He said. You idiot!") > g.score("He said you idiot!")


def test_toxicity_of_odd_rows_and_without_labels(odd, none, labels):
    rows = toxicity.judge(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.judge(none, labels).collect() == [] and toxicity.judge(odd, labels.limit(0)).count() == odd.count()


def plain_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries: a function from a text to its negative log-likelihood."""
    n = perplexity.ORDER
    symbols = lambda t: [0] * (n - 1) + [int(perplexity.CLASS[min(ord(c), 0x250)]) for c in t]
    counts = {n: Counter(tuple(s[i - n + 1:i + 1]) for t in texts for s in [symbols(t)] for i in range(n - 1, len(s)))}
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
            return 1 / perplexity.CLASSES
        c, cut, total, back = level[len(g)]
        lower = p(g[1:])
        if not total[g[:-1]]:
            return lower
        own = c[g] - cut[min(c[g], 3) - 1] if c[g] else 0
        return own / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * lower

    return lambda t: -sum(math.log(max(1e-12, p(tuple(s[i - n + 1:i + 1])))) for s in [symbols(t)] for i in range(n - 1, len(s)))


def test_model_is_kneser_ney(spark):
    texts = ["The cat sat on the mat.", "A dog, a cat and 12 mats!", "éÉ the", "", "The mat sat."]
    model = perplexity.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert np.allclose(np.exp(model.reshape(-1, perplexity.CLASSES).astype(float)).sum(axis=1), 1, atol=1e-4)
    plain = plain_model(texts)
    for t in [*texts, "Zebra zoo 99", "the cat"]:
        assert math.isclose(-float(model[perplexity.grams(t)].sum(dtype="float64")), plain(t), rel_tol=1e-4, abs_tol=1e-4)


def test_pieces_of_a_long_text_are_scored_as_one(spark, monkeypatch):
    text = "The cat sat on the mat. éß 99\n" * 40
    for chunk in (1, 2, 3, 50, 10_000):
        assert np.concatenate(list(perplexity.pieces(text, chunk))).tolist() == perplexity.grams(text).tolist()
    monkeypatch.setattr(perplexity, "CHUNK", 100)  # counts are put together many times in a task
    rows = [(text[:k],) for k in range(0, 900, 7)] + [(None,)]
    got = {r.gram: r.n for r in perplexity.counts(spark.createDataFrame(rows, "text string")).collect()}
    assert got == dict(Counter(g for (t,) in rows for g in perplexity.grams(t or "").tolist()))


def test_quality_keeps_good_and_rejects_bad_text(spark):
    rows = QUERIES["op4_quality_classifier"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_thresholds_are_quantiles_of_a_language(spark):
    rows = [("en" if i % 2 else "de", (float(i), 100)) for i in range(400)] + [("xx", (5.0, 100))] * 3 + [(None, (7.0, 100))]
    got = {r.lang: r for r in perplexity.thresholds(spark.createDataFrame(rows, "lang string, score struct<loss: double, n: long>"), 0.9, 0.0).collect()}
    assert set(got) == {"en", "de", None}
    for lang, some in (("en", [x for x in rows if x[0] == "en"]), (None, rows)):
        mean = sum(s[0] for _, s in some) / (100 * len(some))
        value = sorted(math.ceil(round((s[0] + perplexity.PRIOR * mean) / (100 + perplexity.PRIOR) * perplexity.BIN, 9)) for _, s in some)
        assert abs(got[lang].threshold - value[math.ceil(0.9 * len(some)) - 1] / perplexity.BIN) < 2e-3


def test_quality_of_odd_rows_and_without_labels(odd, none, labels):
    rows = perplexity.judge(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.kept is not None for r in rows)
    assert perplexity.judge(none, labels).collect() == []
    assert all(r.kept and r.threshold is None for r in perplexity.judge(odd, labels.limit(0)).collect())


def test_extraction_of_the_given_pages(spark):
    given = {r.page_id: r.html for r in spark.read.parquet(f"{LARGER}/pages.parquet").collect()}
    for r in QUERIES["op9_html_extraction"](spark, LARGER).collect():
        article = given[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(unescape(b).split()) for b in re.split(r"<[^<>]*>", re.sub("</?b>", "", article)))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGES = {
    "without an article": ("""<body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies on this site to make it work.</div><div class="sidebar"><p>Popular posts of this week.</p>
        </div><div class="post-content"><h2>Title</h2><p>One two three &eacute;&nbsp;four five six   seven
        eight nine ten.</p><p>Short.</p><div class="ad">Buy now</div><form><p>Your mail</p></form><p>More <i>wor</i>ds in a row, and some more.</p></div>
        <div id="comments"><p>First! I like this a lot, thanks.</p></div></body><footer>c</footer>""",
                           "Title\nOne two three é four five six seven eight nine ten.\nShort.\nMore words in a row, and some more."),
    "scripts, styles, remarks": ("<main><script>if (a < b) { var t = '</p>'; }</script><style>p > a {}</style><p>Text <!-- <p>no</p> --> goes on &lt;here&gt; &amp; ends.</p></main><script>x",
                                 "Text goes on <here> & ends."),
    "broken": ("<p>An open paragraph of several words<p>another one with < and <b>bold text", "An open paragraph of several words\nanother one with < and bold text"),
    "plain": ("no markup at all", "no markup at all"), "empty": ("", ""), "null": (None, ""), "only a menu": ("<nav><a href=x>one</a> <a>two</a></nav>", ""),
}


OPEN = {"select": "<select><option>x", "video": "<video src=v>", "object": "<object data=o>", "svg": "<svg width=1>", "closed select": "<select><option>x<option>y</select>",
        "closed video": "<video><p>no video here</p></video>", "second closed": "<svg><svg><text>z</text></svg>"}
ARTICLE = "<body><article><p>One two three four five six.</p>%s<p>Seven eight nine ten eleven.</p></article></body>"


@pytest.mark.parametrize("name", OPEN)
def test_extraction_goes_on_after_an_open_element(name):
    assert html.main_text(ARTICLE % OPEN[name], html.weights({}, {})) == "One two three four five six.\nSeven eight nine ten eleven."


@pytest.mark.parametrize("head", ["<head><title>t</title>", "<head><title>t</title><meta name=x><script>a</script><noscript><link></noscript></head>", "<head>"])
@pytest.mark.parametrize("body", ["<body>", ""])
def test_extraction_without_an_end_of_the_head(head, body):
    page = f"<html>{head}{body}<article><p>One two three four five six.</p></article>"
    assert html.main_text(page, html.weights({}, {})) == "One two three four five six."


@pytest.mark.parametrize("name", PAGES)
def test_extraction_of_made_pages(name):
    assert html.main_text(PAGES[name][0], html.weights({}, {})) == PAGES[name][1]


def test_best_region_is_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(50):
        scores = rng.normal(size=30).round(2).tolist()
        low, high = html.best_region(scores)
        assert math.isclose(sum(scores[low:high]), max(0, max(sum(scores[i:j]) for i in range(30) for j in range(i, 31))), abs_tol=1e-9)


def test_extraction_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "<p>a b c d</p>", 3), (1, None, "<p>a b c d</p>", 3), (None, "u", None, 4)], "page_id long, url string, html string, text long")
    assert sorted(map(tuple, html.extract(df).collect()), key=repr) == sorted([(1, None, "a b c d", 7)] * 2 + [(None, "u", "", 0)], key=repr)
    assert html.extract(df.limit(0)).collect() == []


def test_pipeline_by_stage(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "packing":
            assert out.agg(F.sum("length")).first()[0] >= docs.count()
            assert sorted(r.doc_id for r in out.where("piece = 0").collect()) == sorted(r.doc_id for r in docs.collect())
            break
        assert out.columns == docs.columns
        out = out.checkpoint() if spark.sparkContext.getCheckpointDir() else out
        assert out.join(docs, docs.columns, "left_anti").count() == 0  # nothing new
        kept[name], docs = out.count(), out
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert kept["mix"] > 0 and spark.read.parquet(f"{SF}/documents.parquet").count() > kept["toxicity"] > kept["quality"] >= kept["near-dedup"]
    assert labels.count() > 0


def test_stages_of_odd_and_of_no_rows(spark, odd, none):
    for given in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            assert out.count() >= 0 and (name == "packing" or out.columns == given.columns)
