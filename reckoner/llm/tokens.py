"""Token ids of whole texts by a public tokenizer, each distinct word encoded once per worker.

Two kinds of pre-tokenizer can be cut into independent units. Where white space is dropped (``"words"``),
no token crosses it. Where it is kept (``"spaces"``), a run of white space and the word after it
are a unit: the split pattern never looks beyond the next character after the run. Both kinds part letters
and digits from other characters, so a full stop or comma right after one of them starts a unit as well. The
ids of a text are the ids of its units in a row, and a worker keeps the ids of the units it has met, in a bounded number of bytes. Whole batches are cut
and their units numbered by Arrow; only units that are new are looked at one by one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_BYTES = 60_000_000  # about so much a worker keeps of the units it has met; others are encoded anew in each batch
UNIT_BYTES = 150  # of a kept unit besides its ids: text, entry, numbers
#: Characters that Python counts as white space and Unicode's White_Space property does not (fixed value).
ODD_SPACE = "\x1c\x1d\x1e\x1f"
MARK = "\x1f"
RUNS = re.compile(r"\s*\S+|\s+").findall
_OPEN: dict[tuple[str, str], Encoder] = {}


@cache
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it a letter or digit, is it white space (as the patterns above have it)?"""
    every = [chr(c) for c in range(0x110000)]
    return np.fromiter(map(str.isalnum, every), dtype=bool, count=len(every)), np.fromiter(map(str.isspace, every), dtype=bool, count=len(every))


def irregular(texts: Sequence[str], runs: bool) -> np.ndarray:
    """Which texts hold a stop or comma that does not follow a letter or digit, or (``runs``) white space after white space."""
    word, space = kinds()
    points = np.frombuffer(("a" + "\0".join(texts)).encode("utf-32-le"), dtype="<u4")
    ends = np.cumsum([len(x) + 1 for x in texts])  # a text ends before the NUL that parts it from the next one
    starts = np.concatenate([[0], ends[:-1]]) + 1
    stops = np.flatnonzero((points == 46) | (points == 44))
    bad = stops[~word[points[stops - 1]]]  # the NUL before a text is neither, the letter before the first one is
    if len(texts) and texts[0][:1] in (".", ","):
        bad = np.append(bad, 1)
    if runs:
        blank = space[points]
        bad = np.concatenate([bad, np.flatnonzero(blank[1:] & blank[:-1]) + 1])
    out = np.zeros(len(texts), dtype=bool)
    out[np.searchsorted(starts, bad, side="right") - 1] = True
    return out


def cut_words(texts: Sequence[str]) -> pa.ListArray:
    """The units of each text where white space is dropped."""
    joined = irregular(texts, False)
    parted = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.string()), ".", " ."), ",", " ,")
    if joined.any():
        parted = pc.if_else(pa.array(joined), pa.array(texts, pa.string()), parted)
    return pc.utf8_split_whitespace(parted)


def cut_spaces(texts: Sequence[str]) -> pa.ListArray:
    """The units of each text where a run of white space belongs to the word after it."""
    odd = irregular(texts, True)
    marked = pa.array(["" if o else x for o, x in zip(odd.tolist(), texts)], pa.string())
    for c in " \n.,":
        marked = pc.replace_substring(marked, c, MARK + c)
    cut = pc.split_pattern(marked, MARK)
    if odd.any():
        by_hand = pa.array([RUNS(x) if o else None for o, x in zip(odd.tolist(), texts)], pa.list_(pa.string()))
        cut = pc.coalesce(by_hand, cut)
    return cut


UNITS = {"words": cut_words, "spaces": cut_spaces}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers. ``units`` names the way texts are cut ("" for none)."""

    def __init__(self, path: str, units: str, kept_bytes: int = KEPT_BYTES):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cut = UNITS.get(units)
        self.room = kept_bytes
        self.number: dict[str, int] = {"": 0}  # the units that are kept
        self.ends = np.zeros(1, dtype="int64")  # of each unit's ids in ``pool``
        self.pool = np.zeros(0, dtype="<u4")

    def whole(self, texts: Sequence[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _learnt(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each of the distinct ``units``, ends, pool). New units are kept as long as there is room; the arrays that come back hold all."""
        numbers = list(map(self.number.get, units))
        new = [u for u, k in zip(units, numbers) if k is None]
        if not new:
            return np.array(numbers, dtype="int32"), self.ends, self.pool
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype="int64", count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype="<u4", count=int(sizes.sum()))
        ends, pool = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)]), np.concatenate([self.pool, flat])
        given = np.arange(len(self.ends), len(ends), dtype="int32")
        cost = UNIT_BYTES * len(new) + 4 * len(flat)
        if cost <= self.room:
            self.room -= cost
            self.ends, self.pool = ends, pool
            self.number.update(zip(new, given.tolist()))
        out = np.array([-1 if k is None else k for k in numbers], dtype="int32")
        out[out < 0] = given
        return out, ends, pool

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        texts = [x or "" for x in texts]
        if self.cut is None:
            return self.whole(texts)
        odd = [i for i, x in enumerate(texts) if any(c in x for c in ODD_SPACE)]
        plain = [x for i, x in enumerate(texts) if i not in set(odd)] if odd else texts
        out = self._encode(plain)
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out.insert(i, ids)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        cut = self.cut(texts)
        cut = cut.combine_chunks() if isinstance(cut, pa.ChunkedArray) else cut
        coded = cut.flatten().dictionary_encode()
        numbers, ends, pool = self._learnt(coded.dictionary.to_pylist())
        unit = numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, dtype="int32")
        first = np.concatenate([[0], ends[:-1]])
        sizes = (ends - first).astype("int32")[unit]
        until = np.cumsum(sizes, dtype="int64")
        at = np.repeat(first[unit] - (until - sizes), sizes)
        at += np.arange(len(at))
        raw = memoryview(pool[at].tobytes())
        units_until = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))]).astype("int64")
        cuts = (4 * np.concatenate([[0], until])[units_until]).tolist()
        del cut, coded
        pa.default_memory_pool().release_unused()  # a worker lives on; what a batch took goes back
        return [raw[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def encoder(path: str, units: str, kept_bytes: int = KEPT_BYTES) -> Encoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker, and keeps ``kept_bytes`` at most."""
    if (path, units) not in _OPEN:
        _OPEN[path, units] = Encoder(path, units, kept_bytes)
    return _OPEN[path, units]


def batches(texts: Sequence[str | None], chars: int = 4_000_000):
    """Slices of ``texts`` with about ``chars`` characters, so that memory follows the longest text."""
    start = size = 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
