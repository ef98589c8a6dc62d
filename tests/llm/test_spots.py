"""Spot signatures against a plain implementation."""

import base64
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from reckoner.llm import spots
from tests.llm.conftest import ODD, COLUMNS

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COMMON = "the of and to in is for that".split()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def first32(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def plain_signatures(text, anchors):
    w = WORD.findall(low(text))
    out, rest = set(), []
    for a in reversed(w):
        if a not in anchors:
            rest = [a, *rest[:1]]
        elif len(rest) == 2:
            out.add(sum(first32(x) * m for x, m in zip([a, *rest], spots.MIX)) % 2**64 >> 32)
    return out or {first32(text)}


def plain(rows):
    langs, docs = {}, Counter(lang for _, _, lang in rows)
    for _, text, lang in rows:
        langs.setdefault(lang, Counter()).update(set(WORD.findall(low(text))))
    anchors = {w for lang, c in langs.items() if docs[lang] * spots.LANGUAGES >= len(rows)
               for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:spots.ANCHORS]}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (doc, text, _), (_, follow, _) in zip(order, order[1:] + order[:1]):
        text, follow = text or "", follow or ""
        n = len(text) // 3
        z = text[:len(text) - n] + follow[:n]
        s, e, f = (plain_signatures(t, anchors) for t in (text, z, follow))
        show = lambda x: base64.b64encode(b"".join(v.to_bytes(4, "big") for v in sorted(x))).decode()
        near = lambda a, b: len(a & b) / len(a | b)
        out.append((doc, len(text), hashlib.sha256(z.encode()).hexdigest(), show(s), show(e), near(s, e), near(s, f), near(s, e) >= 0.8, near(s, f) >= 0.8))
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choice("abcdéKß") for _ in range(rng.randint(2, 5))) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


def test_equals_the_plain_version(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 3, 40, 200])), rng.choice(["en", "fr", None])) for i in range(300)]
    rows += [(1000 + i, rows[7][1], "en") for i in range(50)]
    rng.shuffle(rows)
    got = spots.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_odd_rows(spark, odd):
    """Equal ids stand in the order of their texts' digests: here they have equal texts, but for the rows without an id."""
    got = sorted((tuple(r) for r in spots.fingerprinted(odd).collect()), key=repr)
    rows = [(d, x, lang) for d, x, lang, _ in ODD]
    swapped = [r for r in rows if r[0] is not None] + [r for r in rows if r[0] is None][::-1]
    assert got in (plain(rows), plain(swapped))


def test_long_text_one_row_no_rows(spark, none):
    text = prose(random.Random(1), 400_000)
    assert len(text) > 1_500_000
    rows = [(1, text, "en"), (2, text[:-9], "en"), (3, "", "en")]
    got = spots.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    one = spots.fingerprinted(spark.createDataFrame([(7, "the a b of c d", "en")], COLUMNS.replace(", source string", ""))).first()
    assert one.near_next == 1.0 and one.similar_next
    assert spots.fingerprinted(none).collect() == []


def test_near_copies_are_alike_and_others_not(spark):
    rng = random.Random(8)
    base = prose(rng, 600)
    near = " ".join(w if rng.random() > 0.01 else "changed" for w in base.split(" "))
    rows = [(3, base, "en"), (2, near, "en"), (1, prose(rng, 600), "en")]
    got = {r.doc_id: r for r in spots.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[3].near_next > 0.85 and got[3].similar_next and got[2].near_next < 0.1 and 0.3 < got[3].near_edited < 0.8


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_pruned_comparison_decides_as_the_full_one(threshold):
    rng = np.random.default_rng(2)
    both = 0
    for _ in range(600):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 2**32, n, dtype="uint32"))
        keep = a[rng.random(len(a)) < rng.choice([0.3, 0.7, 0.9, 0.97, 1.0])]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**32, int(len(a) * rng.choice([0, 0.05, 0.3, 2])) + (len(keep) == 0), dtype="uint32")]))
        want = spots.likeness(a, b) >= threshold
        both += want
        assert spots.similar(a, b, threshold, 16) == spots.similar(b, a, threshold, 16) == want
        if want:
            assert abs(spots.partition(len(a), threshold) - spots.partition(len(b), threshold)) <= 1
        assert (spots.signatures_of(spots.fingerprint(a)) == a).all()
    assert 50 < both < 550
