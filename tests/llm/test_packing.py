import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import packing

COLUMNS = {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def by_plan(histogram, capacity):
    """Expands a plan: {(length, rank): [(start, size, seq, offset)]} and the sequences' fills."""
    rows, n = packing.make_plan(histogram, capacity)
    pieces, fills = defaultdict(list), defaultdict(list)
    for length0, _, rank, k, start, size, seq, per, base, first in rows:
        for i in range(k):
            item = first + i
            s, o = seq + item // per, base + item % per * size
            pieces[length0, rank + i].append((start, size, s, o))
            fills[s].append((o, size))
    return pieces, fills, n


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 9), max_size=20))
def test_plan_places_every_token_once_without_gaps(histogram):
    pieces, fills, n = by_plan(histogram, 64)
    assert set(pieces) == {(length, r) for length, c in histogram.items() for r in range(c)}
    for (length, _), found in pieces.items():
        at = 0
        for start, size, _, _ in sorted(found):
            assert start == at and size > 0
            at += size
        assert at == length
    assert set(fills) == set(range(n))
    for found in fills.values():
        at = 0
        for offset, size in sorted(found):
            assert offset == at
            at += size
        assert at & (at - 1) == 0 and at <= 64  # full or a power of two: nothing is padded


def test_fullest_matches_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        items = Counter(rng.randint(1, 30) for _ in range(rng.randint(0, 9)))
        room = rng.randint(0, 60)
        sums = {0}
        for x in items.elements():
            sums |= {s + x for s in sums if s + x <= room}
        counts = [items.get(n, 0) for n in range(65)]
        fill, used = packing.fullest(counts, sorted(items, reverse=True), room)
        assert fill == max(sums) == sum(n * k for n, k in used.items())
        assert all(k <= items[n] for n, k in used.items())


def test_a_third_of_rows_with_one_length_gives_a_short_plan():
    rows, _ = packing.make_plan({3000: 10**9, 100: 5, 4095: 10**8})
    assert len(rows) < 500


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["alpha", "Beta,", "don't", "été", "x\x1cy", "a b", "中文字", "é", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "é<|startoftext|><|endoftext|>.", "<|endof", "text|>", "<|end<|endoftext|>oftext|>", "42", "…", "ǅ", "İ", "ΑΣ"]
    out = [None, "", " \n\t ", "one", "one"]
    out += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 900))) for _ in range(30)]
    out += ["\v".join(rng.choice(words) for _ in range(9000))]
    return out


def test_word_cache_equals_whole_text(texts):
    t = Tokenizer.from_file(packing.default_tokenizer())
    encoder = packing.Encoder(packing.default_tokenizer())
    for x in texts:
        assert encoder.ids(x, None).tolist() == t.encode(x or "", add_special_tokens=False).ids


def test_ranked_words_equal_the_tokenizer():
    rng = random.Random(1)
    t, encoder = Tokenizer.from_file(packing.default_tokenizer()), packing.Encoder(packing.default_tokenizer())
    whole = [w.removesuffix("</w>") for w in t.get_vocab() if w.endswith("</w>")]
    words = {w for w in whole if w.isalpha() and w.isascii()}
    words |= {"".join(rng.choice("etaoinshrdlcumwfgypbvkjxqzéüñß") for _ in range(rng.randint(1, 16))) for _ in range(30000)}
    words |= {rng.choice(whole) + rng.choice(whole) for _ in range(30000)} | {"a" * 3000}
    words = sorted(w for w in words if w.isalpha() and w.lower() == w)
    encoder.encode([w.encode() for w in words])
    for w, e in zip(words, t.encode_batch(words, add_special_tokens=False), strict=True):
        assert np.frombuffer(encoder.known[w.encode()], np.uint32).tolist() == e.ids, w


def test_pack_round_trip(spark, texts):
    docs = spark.createDataFrame([(i, x, 1, "y") for i, x in enumerate(texts)], "doc_id long, text string, start int, ids string").repartition(5)
    t = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [2] for i, x in enumerate(texts)}
    rows = packing.pack(docs, packing.default_tokenizer(), with_ids=True).collect()
    plain = packing.op3_query(docs)
    assert set(plain.columns) == COLUMNS
    assert sorted(map(tuple, plain.collect())) == sorted(tuple(r[:-1]) for r in rows)
    got, fills = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id]) and len(r.ids) == r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id].append((r.start, list(r.ids)))
        fills[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in got.items()} == ids
    for v in fills.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 4096


def test_repeated_rows_null_ids_and_empty(spark):
    schema = "doc_id long, text string"
    rows = packing.op3_query(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], schema)).collect()
    assert sum(r.length for r in rows) == 3 + 3 + 1
    assert packing.op3_query(spark.createDataFrame([], schema)).count() == 0
