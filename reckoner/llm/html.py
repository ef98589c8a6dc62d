"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is a row of tokens. A word or a tag scores the log-likelihood ratio of its kind inside and outside of
main content, with counts from pages that mark their article, on top of prior counts. One linear scan
finds the contiguous region with the highest score. The region is widened to the element that holds it,
and what is menu, notice, advert, form or comment within it is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reckoner.llm.common import digest_sample

SAMPLE = 2_000  # pages with a marked article that the weights are fitted on, about, at most
#: Element names of HTML by their role.
RAW = "script style textarea title".split()  # no markup up to the end tag
EMBEDDED = set("noscript template iframe svg object canvas select option datalist math audio video".split())
OF_HEAD = set("base basefont bgsound html link meta noscript template".split())  # what does not end an open head
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
MENUS = set("nav footer aside form button menu dialog fieldset label".split())
CONTENT = {"article", "main"}
#: Words in class, id or role that name something other than the article.
SIDE = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-links comment comments commentlist consent cookie cookies "
           "copyright disclaimer discussion disqus donate footer gdpr header login masthead menu menubar meta-links modal nav navbar navigation navmenu newsletter "
           "notice outbrain overlay pager pagination paywall popup promo promoted promotion reader-comments recommended related replies reply respond rss search "
           "share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription taboola teaser toolbar topbar widget widgets".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s(?:\"[^\"]*\"|'[^']*'|[^'\">])*)?)/?>", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Prior counts (inside, outside) of token kinds; learned counts are added to them.
PRIOR = {"word": (60, 20), "word in a": (2, 40), "word aside": (1, 400), "p": (10, 2), "a": (4, 30), "li": (4, 20), "ul": (1, 8), "div": (4, 20),
         "h": (4, 4), "table": (2, 6), "inline": (8, 8), "other": (3, 6)}
PRIOR_TOKENS, TRUST = 1_000, 0.5  # tokens after which learned counts weigh half of what they may; the most they may
KINDS = {**dict.fromkeys("p br blockquote pre".split(), "p"), "a": "a", "li": "li", **dict.fromkeys("ul ol nav menu footer aside form".split(), "ul"),
         **dict.fromkeys("div section".split(), "div"), **dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "h"),
         **dict.fromkeys("table tr td th tbody thead".split(), "table"), **dict.fromkeys("b i em strong span u code sub sup small q cite mark".split(), "inline")}


@dataclass
class Page:
    """Tokens of a page. ``kinds`` scores them, ``owner`` is the element they stand in, ``texts`` a text or None for a tag."""
    kinds: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)  # words in a text token, 1 for a tag
    owner: list[int] = field(default_factory=list)
    texts: list[str | None] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    side: list[bool] = field(default_factory=list)
    # elements
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    aside: list[bool] = field(default_factory=lambda: [False])
    inside: list[bool] = field(default_factory=lambda: [False])  # an article or main element, or within one
    hidden: list[bool] = field(default_factory=lambda: [False])  # a head or embedded element, or within one: has no tokens
    first: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])


def _is_side(tag: str, attrs: str, within_article: bool) -> bool:
    if tag in MENUS or tag == "header" and not within_article:
        return True
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            for word in value.split():
                if word in SIDE or word in ("complementary", "contentinfo") or SIDE & set(re.split(r"[-_]+", word)) and not re.search("article|content|entry|post-body|story", word):
                    return True
    return False


def _closed(tokens: list[re.Match]) -> set[int]:
    """Starts of the embedded elements that have an end tag."""
    out, opened = set(), {}
    for m in tokens:
        tag = (m["tag"] or "").lower()
        if tag in EMBEDDED:
            if not m["end"]:
                opened.setdefault(tag, []).append(m.start())
            elif opened.get(tag):
                out.add(opened[tag].pop())
    return out


def parse(source: str) -> Page:
    """The tokens of ``source``. Elements end with their end tag, or with that of an element around them. A head also ends where something
    else than its own elements begins; an embedded element without an end tag is empty."""
    page, stack, at = Page(), [0], 0
    tokens = list(TOKEN.finditer(source))
    closed = _closed(tokens)

    def end_head() -> None:
        if page.names[stack[-1]] == "head":
            page.last[stack.pop()] = len(page.kinds)

    def text(piece: str) -> None:
        piece = html.unescape(piece)
        n = len(piece.split())
        if n:
            end_head()
        if n or piece:
            top = stack[-1]
            kind = "word aside" if page.aside[top] else "word in a" if any(page.names[e] == "a" for e in stack) else "word"
            add(kind, n, top, piece, "")

    def add(kind: str, n: int, owner: int, piece: str | None, tag: str) -> None:
        if page.hidden[owner]:
            return
        page.kinds.append(kind)
        page.counts.append(n)
        page.owner.append(owner)
        page.texts.append(piece)
        page.tags.append(tag)

    for m in tokens:
        if m.start() > at:
            text(source[at:m.start()])
        at = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        kind = KINDS.get(tag, "other")
        if page.names[stack[-1]] == "option" and not (m["end"] and tag == "option"):  # holds text only, ends at the next tag
            page.last[stack.pop()] = len(page.kinds)
        if m["end"]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if page.names[stack[i]] == tag), None)
            add(kind, 1, stack[depth] if depth and page.hidden[stack[-1]] else stack[-1], None, tag)
            if depth:
                for e in stack[depth:]:
                    page.last[e] = len(page.kinds)
                del stack[depth:]
            continue
        if tag in EMBEDDED and tag != "option" and m.start() not in closed:
            continue
        if tag not in OF_HEAD:
            end_head()
        top = stack[-1]
        if tag == "p" and page.names[top] == "p":  # an open paragraph ends where the next begins
            page.last[top] = len(page.kinds)
            stack.pop()
            top = stack[-1]
        if tag not in VOID and not m[0].endswith("/>"):
            page.names.append(tag)
            page.parents.append(top)
            page.aside.append(page.aside[top] or _is_side(tag, m["attrs"], page.inside[top]))
            page.inside.append(page.inside[top] or tag in CONTENT)
            page.hidden.append(page.hidden[top] or tag in EMBEDDED or tag == "head")
            page.first.append(len(page.kinds))
            page.last.append(0)
            stack.append(len(page.names) - 1)
        add(kind, 1, stack[-1], None, tag)
    if at < len(source):
        text(source[at:])
    for e in stack:
        page.last[e] = len(page.kinds)
    return page


def learn(page: Page) -> tuple[Counter, Counter]:
    """Token kinds inside and outside of the marked article of a page."""
    inside, outside = Counter(), Counter()
    for kind, n, owner in zip(page.kinds, page.counts, page.owner):
        (inside if page.inside[owner] and not page.aside[owner] else outside)[kind] += n
    return inside, outside


def weights(inside: dict[str, float], outside: dict[str, float]) -> dict[str, float]:
    """Log-likelihood ratios of token kinds, from learned shares averaged with those of the prior."""
    def share(counts: dict[str, float], side: int, kind: str) -> float:
        prior = PRIOR[kind][side] / sum(v[side] for v in PRIOR.values())
        seen = sum(counts.values())
        trust = seen / (seen + PRIOR_TOKENS)  # of what the pages say
        return (1 - TRUST * trust) * prior + TRUST * trust * counts.get(kind, 0) / max(1, seen)

    out = {}
    for kind in PRIOR:
        ratio = math.log(share(inside, 0, kind) / share(outside, 1, kind))
        # a word of running text is worth something; a link, a side text and a tag cost something, whatever the pages say
        out[kind] = max(ratio, 0.2) if kind == "word" else min(ratio, -0.1 if kind.startswith("word") else -0.05)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Ends [low, high) of the contiguous run with the highest sum; (0, 0) if none is positive. The first of equals, the shortest at its start."""
    best, low, high, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def main_text(source: str | None, weight: dict[str, float]) -> str:
    """The main text of a page: blocks joined by a line feed, white space in a block as one space."""
    page = parse(source or "")
    low, high = best_region([weight[k] * n for k, n in zip(page.kinds, page.counts)])
    if low == high:
        return ""
    # the lowest element that holds all texts of the region, unless it is the page itself
    texts = [i for i in range(low, high) if page.texts[i] is not None and not page.aside[page.owner[i]]]
    if texts:
        e = page.owner[texts[0]]
        while e and page.last[e] <= texts[-1]:
            e = page.parents[e]
        up = e
        while up and page.names[up] not in CONTENT:
            up = page.parents[up]
        e = up or e
        if e and page.names[e] not in ("body", "html"):
            low, high = page.first[e], page.last[e]
    blocks, now = [], []
    for i in range(low, high):
        if page.texts[i] is None:
            if page.tags[i] in BLOCKS:
                blocks.append(now)
                now = []
        elif not page.aside[page.owner[i]]:
            now.append(page.texts[i])
    return "\n".join(b for b in (" ".join("".join(x).split()) for x in [*blocks, now]) if b)


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from about ``sample`` pages, chosen by a digest, that mark an article; without such pages, those of the prior."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = Counter(), Counter()
        for frame in frames:
            for source in frame["html"]:
                for t, new in zip(total, learn(parse(source))):
                    t.update(new)
        rows = [(k, i, n) for i, t in enumerate(total) for k, n in t.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["kind", "side", "n"])

    marked = pages.select("html").where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    some = digest_sample(marked, F.col("html"), sample)
    rows = some.mapInPandas(count, "kind string, side int, n long").groupBy("kind", "side").agg(F.sum("n").alias("n")).collect()
    return weights(*[{r["kind"]: r["n"] for r in rows if r["side"] == i} for i in (0, 1)])


def extract(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, over its whole html. NULL or empty html gives an empty text; repeated rows stay;
    other columns are not read. ``weight`` takes weights fitted before."""
    weight = weight or fit(pages)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [main_text(x, weight) for x in frame.pop("html")]
            yield frame.assign(page_id=frame["page_id"].astype("Int64"), text=texts, n_chars=[len(t) for t in texts])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInPandas(
        run, "page_id long, url string, text string, n_chars long")
