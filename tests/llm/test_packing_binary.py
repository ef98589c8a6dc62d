"""Packing against item-by-item best-fit decreasing; token files against an exact round trip."""

import bisect
import random
import uuid
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reckoner.llm import binary, packing, tokens
from reckoner.llm.queries import QUERIES
from reckoner.session import shared_folder, written_table
from tests.llm.conftest import ODD, SF

FILES = {"words": public_tokenizers.path("word_bpe_49k.json"), "spaces": public_tokenizers.path("byte_bpe_50k.json")}


def ids(units: str, texts) -> list[list[int]]:
    t = Tokenizer.from_file(FILES[units])
    t.encode_special_tokens = True
    return [x.ids + [0] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(x) -> int:
    return zlib.crc32(np.array(x, dtype="<u4").tobytes())


@pytest.mark.parametrize("units", FILES)
def test_units_give_the_ids_of_whole_texts(units):
    random.seed(3)
    texts = ["", " ", ".", "a.b,c", "x)., y", "a  b", "a\n\n b.\tc", "İ ΑΣ ΑΣ. é. 3.14,15", "a\x1cb c\x1fd", "<|endoftext|> hi", "...,,. a_.b", "trail.\n", "a　. b"]
    texts += ["".join(random.choice("ab.,  \n\té'_-3́Σ$") for _ in range(random.randint(1, 40))) for _ in range(3000)]
    texts += ["é.a", "“.a", "x\u2028 y", "a\u00a0\u00a0b.", " .", "\u3000,b", "a" * 50 + "\u0085.", "٣.٤", "_,a", None]
    encoder, whole = tokens.Encoder(FILES[units], units), tokens.Encoder(FILES[units], units).whole([x or "" for x in texts])
    assert encoder.encode(texts) == whole
    assert encoder.encode(texts) == whole  # all units are known by now
    full = tokens.Encoder(FILES[units], units, 2_000)  # room for a few units
    assert full.encode(texts) == whole and full.encode(texts[::-1]) == whole[::-1] and len(full.number) < 20
    assert [encoder.encode([x])[0] for x in texts[:60]] == whole[:60] and encoder.encode([]) == []


@pytest.mark.parametrize("units", FILES)
def test_long_texts_and_many_batches_give_the_same_ids(units):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() + rng.choice(["", "", ".", ",\n"]) for _ in range(n)) for n in (200_000, 3, 0, 50_000, 1)]
    assert sum(map(len, texts)) > 1_000_000
    encoder = tokens.Encoder(FILES[units], units, 3_000_000)
    whole = encoder.whole(texts)
    assert encoder.encode(texts) == whole
    assert [x for low, high in tokens.batches(texts, 100_000) for x in encoder.encode(texts[low:high])] == whole


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(3, 1.2, 800).astype(int), 1, 100)
    histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.plan(histogram, 100)
    free, bins = [], 0
    for x in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(free, x)
        if at < len(free):
            left = free.pop(at)
        else:
            left, bins = 100, bins + 1
        if left > x:
            bisect.insort(free, left - x)
    fill, count = defaultdict(int), 0
    for length, low, high, first, offset in sorted(plan.itertuples(index=False), key=lambda r: r.offset):
        for b in range(first, first + high - low):
            assert fill[b] == offset
            fill[b] += length
            count += 1
    assert count == len(lengths) and len(fill) == bins and max(fill.values()) <= 100


def check_packing(rows, texts, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert sum(r.length for r in pieces) <= capacity
    expected = sorted((d is None, d or 0, i // capacity, i, len(x[i:i + capacity]), crc(x[i:i + capacity])) for d, x in texts for i in range(0, len(x), capacity))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    return len(by_sequence)


def test_query_packs_every_piece(spark, docs):
    rows = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n = check_packing(rows, list(zip([d for d, _ in given], ids("words", [t for _, t in given]))))
    total = sum(r.length for r in rows)
    assert n <= 1.03 * total / 2048 + 1


def test_packing_of_odd_rows_and_sequences(spark, odd, none):
    rows = packing.pack(odd, FILES["words"], "words").collect()
    check_packing(rows, list(zip([d[0] for d in ODD], ids("words", [d[1] for d in ODD]))))
    assert packing.pack(none, FILES["words"], "words").collect() == []
    pieces = written_table(packing.pieces(odd, FILES["words"], "words", 64, with_ids=True), "test-pieces")
    sequences = packing.sequences(packing.assign(pieces, 64)).collect()
    assert sum(len(s.ids) for s in sequences) == 4 * sum(len(x) for x in ids("words", [d[1] for d in ODD]))
    assert all(len(s.ids) <= 4 * 64 for s in sequences)


@pytest.mark.parametrize("n, values", [(0, 1), (1, 1), (511, 3), (512, 2), (513, 5000), (20_000, 50_000)])
def test_huffman_round_trip(n, values):
    given = (np.random.default_rng(n).zipf(1.3, n) - 1) % values
    symbols, counts = np.unique(given, return_counts=True) if n else (np.array([0]), np.array([1]))
    bits = binary.code_lengths(counts)
    assert bits.max() <= binary.MAX_BITS and (0.5**bits).sum() <= 1
    code = binary.Code(symbols, bits)
    payload, checkpoints = code.encode(given)
    assert len(checkpoints) == -(-n // binary.BLOCK) and (code.decode(payload, checkpoints, n) == given).all()


def test_length_limit_is_optimal_where_it_does_not_bind_and_kept_where_it_does():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(sum(fibonacci[-2:]))
    bits = binary.code_lengths(np.array(fibonacci), 8)
    assert bits.max() == 8 and (0.5**bits).sum() == 1
    assert sorted(binary.code_lengths(np.array([5, 9, 12, 13, 16, 45])).tolist()) == [1, 3, 3, 3, 4, 4]


def expected_binary(rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        x = ids("spaces", [text])[0]
        out.append((doc, start, len(x), crc(x)))
        start += len(x)
    return out


def test_token_files_round_trip(spark, docs):
    rows = QUERIES["op10_token_binary"](spark, SF).collect()
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == expected_binary([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_token_files_of_odd_rows(spark, odd, none):
    folder = f"{shared_folder(spark)}/binary-{uuid.uuid4().hex}"
    binary.write(odd, folder, FILES["spaces"], "spaces")
    got = sorted(map(tuple, binary.read(spark, folder).collect()), key=lambda r: r[1])
    assert got == expected_binary([(d[0], d[1]) for d in ODD])
    whole = {(r.doc_id, r.ids_crc32): r.ids for r in binary.decoded(spark, folder, with_ids=True).collect()}
    assert all(zlib.crc32(v) == k[1] for k, v in whole.items())
    binary.write(none, folder + "-none", FILES["spaces"], "spaces")
    assert binary.read(spark, folder + "-none").collect() == []
