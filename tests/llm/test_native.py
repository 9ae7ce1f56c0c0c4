"""The native operators against brute force, with nulls, repeats, clashing columns and empty tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import draw, licences, mixing, quality_rules, sharding, url_rules

PYTHON = ("PythonUDF", "ArrowEval", "MapInPandas", "MapInArrow", "BatchEvalPython")


def plan(df):
    return df._jdf.queryExecution().toString()


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\v\f\r":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def base(text):
    words, seen, dup = split(text), set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    fails = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), fails


def test_quality_base_and_verdicts(spark):
    rng = random.Random(2)
    vocabulary = ["the", "Ä", "a\x1cb", "𝒳y", "#", "|", "word,", "end."]
    texts = [None, "", "\n \t", "a b c"]
    texts += ["".join(rng.choice(vocabulary) + rng.choice(" \n\t\v ") for _ in range(rng.randint(1, 130))) for _ in range(80)]
    texts += ["a b c d " * 30000, " ".join(f"word{i}" for i in range(30000))]
    docs = spark.createDataFrame([(i, x, 1, "c") for i, x in enumerate(texts)], "doc_id long, text string, n_words int, kept string")
    df = quality_rules.op1_query(docs)
    assert not any(k in plan(df) for k in PYTHON)
    rows = {r.doc_id: r for r in df.collect()}
    for i, x in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(x), x and x[:200]
        assert not (r.base_failed and r.kept)


def test_quality_rules_reject_junk_and_keep_prose(spark):
    prose = " ".join(f"{w}{i}" for i in range(40) for w in ("plain", "words", "réel", "of"))
    junk = {"pipes": prose.replace(" ", " | "), "shout": prose.upper(), "marks": prose.replace(" ", "!! "), "lines": (prose[:40] + "\n") * 4 + prose, "numbers": " ".join(map(str, range(200))), "dots": "\n".join(f"{a} {a}x..." for a in prose.split())}
    few = (prose[:40] + "\n") * 2 + prose  # one repeated line is no reason
    docs = spark.createDataFrame([("clean", prose), ("few", few), *junk.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert got["clean"].kept and got["clean"].rejected_by is None
    assert [k for k, r in got.items() if r.kept] == ["clean", "few"]
    assert got["lines"].rejected_by == "duplicate_lines"


def sampled(spark, lengths, times=1):
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),) for n in lengths for _ in range(times)], "text string")
    return quality_rules.sample(docs)


def test_cascade_order_follows_rejection_per_cost(spark, monkeypatch):
    ticks = iter(range(10**6))
    monkeypatch.setattr(quality_rules.time, "perf_counter", lambda: next(ticks))  # every rule costs the same
    rules = [quality_rules.Rule("few", lambda t, f: f["n_words"] < 103), quality_rules.Rule("most", lambda t, f: f["n_words"] < 109), quality_rules.Rule("rest", lambda t, f: f["n_words"] >= 109)]
    order = quality_rules.estimate(sampled(spark, [*range(101, 112), 3, 4]), rules)  # the last two fail the base
    assert [n for n, _, _ in order] == ["most", "rest", "few"]
    assert [round(s * 11) for _, _, s in order] == [8, 3, 0]


def test_estimates_agree(spark):
    """Rules of like rejection and unlike cost, and one that rejects nothing: three runs give one order."""
    dear = lambda t: F.size(F.filter(F.split(t, ""), lambda x: x.rlike("[0-8]"))) >= 0
    rules = [quality_rules.Rule("none", lambda t, f: f["n_words"] < 0), quality_rules.Rule("dear", lambda t, f: dear(t) & (f["n_words"] < 160)), quality_rules.Rule("cheap", lambda t, f: f["n_words"] >= 160)]
    held = sampled(spark, range(100, 220), 4)
    orders = [quality_rules.estimate(held, rules) for _ in range(3)]
    assert [[n for n, _, _ in o] for o in orders] == [["cheap", "dear", "none"]] * 3
    assert all(o[0][1] < o[1][1] for o in orders)


def test_sample_is_from_all_partitions(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(20000).repartition(8).select(F.concat(F.lit(text), F.spark_partition_id().cast("string")).alias("text"))
    rows = quality_rules.sample(docs, rows=400).groupBy("text").count().collect()
    assert len(rows) == 8 and 250 < sum(r["count"] for r in rows) < 550


def test_draws_of_any_count(spark):
    """A count of 10^10 rows or of none draws its share without overflow; 20 million rows draw about what is asked for."""
    assert draw.share(512, 10**10) == -(-(512 << 40) // 10**10) and draw.share(5, 0) == draw.share(9, 3) == draw.SPACE
    rows = spark.range(20_000_000)
    assert draw.drawn(rows, 512, 10**10, F.col("id")).count() < 30
    assert 300 < draw.drawn(rows, 512, 20_000_000, F.col("id")).count() < 800
    assert draw.drawn(rows, 20_000_000, 20_000_000, F.col("id")) is rows


def test_sample_of_many_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(60)),)], "text string")
    monkeypatch.setattr(type(docs), "count", lambda self: 10**10)
    assert len(quality_rules.sample(docs).collect()) <= 1


def test_quality_empty(spark):
    assert quality_rules.op1_query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def mix_brute(rows, targets):
    """How near each source's taken words must come: one document."""
    taken, longest = Counter(), Counter()
    for r in rows:
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= longest[s] + 1e-6, (s, taken[s], t)


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "c", None, "", "é"] + ["hot"] * 6), "w " * rng.randint(0, 40), "clash") for i in range(600)]
    rows += [(5, "rep", "x y z", "r")] * 50 + [(None, "b", None, "n"), (9000, "zero", "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size string").repartition(5)
    df = mixing.mix(docs)
    assert not any(k in plan(df) for k in PYTHON)
    got = df.collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, s, t, _ in rows:
        size[s] += len(split(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    want, left, free = {}, sum(size.values()), set(order)
    while True:  # reshare the excess until no source is above its cap
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 3 * size[s]
            left -= want[s]
            free.remove(s)
    want |= {s: level * weight[s] for s in free}
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 3 * r.size
    mix_brute(got, want)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    copies = mixing.repeat(docs)
    assert copies.columns == docs.columns
    assert Counter(r.doc_id for r in copies.collect()) == Counter({k: n for k in {r.doc_id for r in got} if (n := sum(r.copies for r in got if r.doc_id == k))})


def test_mixing_empty_and_wordless(spark):
    schema = "doc_id long, source string, text string"
    assert mixing.op9_query(spark.createDataFrame([], schema)).collect() == []
    got = mixing.op9_query(spark.createDataFrame([(1, None, None), (2, "a", " ")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def judge_brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for rule, verdict in url_rules.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, "allow"))


def test_url_rules(spark):
    rng = random.Random(6)
    hosts = ["EXAMPLE.com", "www.example.com", "a.b.www.example.com", "xexample.com", "x.net", "net", "com", "com.", ".com", "", "a..net", "ÉX.com", "com:80", "u@com"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "/es/?q", "/fr/#://x", "?a/en/", "#/en/", "/en/\n/y"]
    urls = [None, "", "no scheme", "://", "http:/x.com/"] + [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths]
    pages = spark.createDataFrame([(i % 90, u, "clash") for i, u in enumerate(urls)] + [(None, "http://com/", "r")] * 40, "page_id long, url string, host string")
    df = url_rules.op4_query(pages)
    got = Counter(map(tuple, df.collect()))
    assert got == Counter((i, *judge_brute(u)) for i, u, _ in pages.collect())
    assert url_rules.op4_query(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_url_rules_without_rules_and_with_two_verdicts(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None), (3, "http://b.org")], "page_id long, url string")
    none = url_rules.judge(pages, url_rules.rule_table(spark, []))
    assert sorted((r.page_id, r.rule, r.verdict) for r in none.collect()) == [(1, None, "allow"), (2, None, "allow"), (3, None, "allow")]
    twice = url_rules.judge(pages, url_rules.rule_table(spark, [("com/", "block"), ("com/", "allow"), ("a.com/x", "block"), ("a.com/x", "block")]))
    assert sorted((r.page_id, r.rule, r.verdict) for r in twice.collect()) == [(1, "a.com/x", "block"), (2, None, "allow"), (3, None, "allow")]
    same = url_rules.judge(pages, url_rules.rule_table(spark, [("com/", "block"), ("com/", "allow")]))
    assert [(r.rule, r.verdict) for r in same.collect() if r.page_id == 1] == [("com/", "allow")]


def test_very_long_texts_in_shards_and_mixes(spark):
    long = "word " * 700_000
    docs = spark.createDataFrame([(1, long, "a"), (2, "x y", "a"), (3, "z", "b"), (4, None, None)], "doc_id long, text string, source string")
    shards = {r.doc_id: r for r in sharding.op6_query(docs).collect()}
    assert shards[1].n_bytes == len(long) and shards[1].shard_docs == 1 and shards[2].shard_bytes <= sharding.LIMIT_BYTES
    mix = {r.doc_id: r for r in mixing.op9_query(docs).collect()}
    assert mix[1].size == 700_000 and mix[4].size == 0 and mix[3].target == 3.0 and all(r.taken <= 3 * r.size for r in mix.values())


@pytest.mark.parametrize("limit", [60, 400, 10**6])
def test_sharding(spark, limit):
    rng = random.Random(8)
    rows = [(i, "é" * rng.randint(0, 20), "clash") for i in range(300)] + [(7, "y" * 10, "r")] * 100 + [(None, None, "n"), (1000, "z" * 500, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(3)
    got = sharding.shard(docs, limit_bytes=limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len((t or "").encode())) for i, t, _ in rows)
    total, members = Counter(), Counter()
    for r in got:
        total[r.shard] += r.n_bytes
        members[r.shard] += 1
    shards = sorted(total)
    assert all((total[r.shard], members[r.shard], len(r.shard)) == (r.shard_bytes, r.shard_docs, r.depth) for r in got)
    assert all(total[s] <= limit or members[s] == 1 for s in shards)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))  # prefix-free
    for s in shards:  # a bucket splits only if it is oversized
        if s:
            assert sum(n for k, n in total.items() if k.startswith(s[:-1])) > limit


def test_sharding_empty(spark):
    assert sharding.op6_query(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_licences(spark):
    mit = dict((n, b) for n, b in reversed(licences.known_texts()))["MIT"]
    texts = [mit, "The MIT License (MIT)\n\nCopyright (c) 2019 Some One\nAll rights reserved.\n\n" + mit.upper().replace(" ", "\n  "), mit.replace("sublicense", "sub-licence"), mit + " and more", "prose\nLicensed under CC BY-NC 4.0.", "LICENCED under cc by-nc 4.0!", None, "", "...", "(c) only a notice"]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(texts)] + [(3, mit, "r")], "doc_id long, text string, license_id string")
    df = licences.op10_query(docs)
    assert not any(k in plan(df) for k in PYTHON)
    rows = df.collect()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r.license_id)
    assert got[0] == got[1] == got[2] == ["MIT"] and sorted(map(str, got[3])) == ["MIT", "None"]
    assert [got[k] for k in range(4, 10)] == [[None], ["CC-BY-NC-4.0-notice"], [None], [None], [None], [None]]
    assert all(r.canonical_sha256 is None for r in rows if r.doc_id >= 6)
    long = spark.createDataFrame([(1, "word " * 10**6)], "doc_id long, text string").withColumn("text", F.col("text"))
    assert licences.op10_query(long).first().license_id is None
    assert licences.op10_query(spark.createDataFrame([], "doc_id long, text string")).collect() == []
