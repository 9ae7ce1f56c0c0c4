import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash


def brute_print(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def test_query_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["Ab", "cd", "É", "e\x1cf", "ǅ", "gh", "x y", "12", "."]
    texts = [None, "", " \n", "one", "One", "one two", "a b c"]
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append("\t".join(base))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(70000)))
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)], "doc_id long, text string, fp string")
    prints = {i: brute_print(x) for i, x in enumerate(texts)}
    want = brute_components(prints)
    rows = simhash.op7_query(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def near_points(rng, n, centres, flips):
    out = set()
    while len(out) < n:
        x = int(rng.choice(centres))
        for _ in range(rng.integers(0, flips + 1)):
            x ^= 1 << int(rng.integers(0, 64))
        out.add(x)
    return np.array(sorted(out), np.uint64)


def brute_labels(p):
    d = np.bitwise_count(p[:, None] ^ p[None, :]) <= 2
    found = np.arange(len(p))
    while True:
        new = np.array([found[d[i]].min() for i in range(len(p))])
        if (new == found).all():
            return found
        found = new


def test_tree_loses_no_link(spark):
    rng = np.random.default_rng(1)
    p = np.concatenate([near_points(rng, 1500, rng.integers(0, 2**63, 40), 5), near_points(rng, 1500, rng.integers(0, 2**63, 1), 6)])
    p = np.unique(p)
    want = brute_labels(p)
    assert (simhash.near_forest(p) == want).all()
    tree = simhash.VantageTree(p[::7], 16)
    assert tree.shards > 8
    at, shard = tree.route(p)
    linked = np.bitwise_count(p[:, None] ^ p[None, :]) <= 2
    member = np.zeros((len(p), tree.shards), bool)
    member[at, shard] = True
    i, j = np.nonzero(linked)
    assert (member[i] & member[j]).any(axis=1).all()


def test_large_shards_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_SHARD_ROWS", 150)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 1 << 20)
    rng = np.random.default_rng(2)
    p = near_points(rng, 900, rng.integers(0, 2**63, 12), 4)
    signed = p.view(np.int64)
    found = simhash.near_components(spark.createDataFrame([(int(x),) for x in signed], "fp long"))
    got = {r.node: r.root for r in found.collect()}
    want = brute_labels(p)
    groups = {}
    for x, k in zip(signed.tolist(), want.tolist(), strict=True):
        groups.setdefault(k, []).append(x)
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}


def test_shards_that_no_vantage_parts_go_to_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_SHARD_ROWS", 50)
    monkeypatch.setattr(simhash, "split", lambda points, radius: None)
    p = near_points(np.random.default_rng(5), 200, [7], 3)
    got = {r.node: r.root for r in simhash.near_components(spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fp long")).collect()}
    groups = {}
    for x, k in zip(p.view(np.int64).tolist(), brute_labels(p).tolist(), strict=True):
        groups.setdefault(k, []).append(x)
    assert got == {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    tiles, following = simhash._in_tiles(spark.range(200).select(F.col("id").alias("fp")), 200, 5)
    assert tiles.groupBy("shard").count().agg(F.max("count")).first()[0] < 200 and following == 5 + 64


def test_sample_of_many_fingerprints(spark):
    points = spark.range(1 << 16).select(F.xxhash64("id").alias("fp"))
    assert len(simhash._sample(points, 1 << 18, 10**10)) < 30
    assert 400 < len(simhash._sample(points, 512, 1 << 16)) < 650


def test_repeats_null_ids_and_empty(spark):
    schema = "doc_id long, text string, n int"
    rows = [(5, "a b c", 1), (5, "a b c", 2), (None, "a b c", 3), (None, "q r s t u", 4), (3, None, 5), (9, "", 6)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.op7_query(docs).collect())
    assert got == [(-1, -1), (-1, 5), (3, 3), (5, 5), (5, 5), (9, 3)]
    kept = simhash.keep_first(docs).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, "q r s t u"), (3, ""), (5, "a b c")]
    assert simhash.op7_query(spark.createDataFrame([], schema)).collect() == []
    assert simhash.keep_first(spark.createDataFrame([], schema)).collect() == []
