"""Near copies against the similarity of all pairs."""

import random

import corpus_pipeline
import numpy as np
from test_simhash import brute_print

from plumbline.llm import near_copies


def brute_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_kept(texts):
    own, least = [brute_set(x or "") for x in texts], list(range(len(texts)))
    links = [(i, j) for i in range(len(own)) for j in range(i) if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    return sorted(set(least))


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randint(0, 10**9)}"
    return out


def corpus():
    rng = random.Random(5)
    texts = [None, "", " \n", "one", "One", "one two"]
    for _ in range(25):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(50, 300))]
        texts += [" ".join(words), *(" ".join(edited(rng, words, rng.randint(0, 6))) for _ in range(rng.randint(0, 3)))]
    words = [f"w{rng.randint(0, 5000)}" for _ in range(200)]
    texts += [" ".join(edited(rng, words, rng.randint(1, 6))) for _ in range(60)]  # many buckets of one large group
    return texts


def test_stage_against_all_pairs(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_kept(texts)
    prints = [brute_print(x) for x in texts]
    apart = [i for i in range(len(texts)) if i not in want and all((prints[i] ^ prints[j]).bit_count() > 2 for j in range(i))]
    assert len(apart) > 20  # near copies that two bits of a fingerprint do not show
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want


def test_tiles_of_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_CLASSES", 7)
    texts = corpus()[-60:]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == brute_kept(texts)


def test_overlaps_against_sets(monkeypatch):
    monkeypatch.setattr(near_copies, "COLUMNS", 5)
    rng = random.Random(3)
    own = [{rng.randint(0, 40) for _ in range(rng.randint(1, 30))} for _ in range(20)]
    got = near_copies.overlaps([np.array(sorted(x), np.uint64) for x in own])
    assert all(got[i, j] == len(own[i] & own[j]) for i in range(20) for j in range(20) if i != j)


def test_repeats_null_ids_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "q r s t u"), (3, None), (9, "")]
    kept = near_copies.keep_first(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, "q r s t u"), (3, ""), (5, "a b c")]
    assert near_copies.keep_first(spark.createDataFrame([], schema)).collect() == []


def test_fingerprints_alone_link_too(spark):
    """The trees' links count even where the sets share less: a passage said once beside one said 40 times moves few bits."""
    rng = random.Random(11)
    once, other = ([f"w{rng.randint(0, 10**6)}" for _ in range(n)] for n in (60, 40))
    texts = [" ".join(once * 40), " ".join(once * 40 + other), " ".join(other)]
    assert (brute_print(texts[0]) ^ brute_print(texts[1])).bit_count() <= 2 and brute_kept(texts) == [0, 1, 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]


def test_many_named_rows_give_the_same(spark, monkeypatch):
    texts = corpus()[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_copies, "NAMED_ROWS", 0)
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == brute_kept(texts)
