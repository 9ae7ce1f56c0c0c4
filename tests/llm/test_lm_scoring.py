import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import gru, lm_scoring


def brute(rows):
    """Base scores as the contract words them."""
    split = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    docs = [(i, [w for w in split(t) if w] + [None]) for i, t in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in docs]
    c = Counter(w for h, (_, ws) in zip(held, docs, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for h, (i, ws) in zip(held, docs, strict=True)]


@pytest.fixture
def small(monkeypatch):
    """Most words are not among those that workers know, so the join has work to do."""
    monkeypatch.setattr(lm_scoring, "KNOWN_WORDS", 60)


def corpus(n, seed=0):
    """Two languages whose words never mix, so context tells a lot."""
    rng = random.Random(seed)
    tongues = [[f"{k}{i}" for i in range(150)] for k in ("Da", "ü")]
    out = [(i, " ".join(rng.choice(tongues[i % 2]) if rng.random() < 0.4 else tongues[i % 2][rng.randrange(9)] for _ in range(rng.randint(0, 70)))) for i in range(n)]
    return [*out, (n, None), (n + 1, ""), (n + 1, ""), (None, "Da1 unseen"), (n + 2, "Da1\tü2 " * 4000)]


def test_base_against_brute_force_and_the_model_beats_it_on_held_out_texts(spark, small):
    rows = corpus(500)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string").repartition(4)
    got = lm_scoring.op8_query(docs).collect()
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=key) == sorted(brute(rows), key=key)
    held = [r for r in got if r.held_out]
    assert len(held) > 40 and all(r.score < 0 for r in got)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_does_not_depend_on_windows_or_lanes(monkeypatch):
    monkeypatch.setattr(gru, "CLASS_SIZE", 8)
    p, rng = gru.fresh(24, 3), np.random.default_rng(0)
    p = [a + rng.normal(size=a.shape).astype(np.float32) * 0.3 for a in p]
    docs = [rng.integers(0, 24, n) for n in (1, 5, 40, 333)]
    want = np.array([gru.score(p, [d])[0] for d in docs])
    for lanes, window in ((1, 16), (2, 7), (4, 1000)):
        monkeypatch.setattr(gru, "SCORE_LANES", lanes)
        monkeypatch.setattr(gru, "WINDOW", window)
        assert np.allclose(gru.score(p, docs), want, atol=1e-3)
    every = [gru.score(p, [np.array([a])])[0] for a in range(24)]
    assert abs(np.exp(every).sum() - 1) < 1e-4  # a distribution over symbols


def test_gradients_by_differences(monkeypatch):
    for name, value in {"HIDDEN": 4, "WINDOW": 6, "CLASS_SIZE": 4}.items():
        monkeypatch.setattr(gru, name, value)
    rng = np.random.default_rng(1)
    p = [a.astype(float) + rng.normal(size=a.shape) * 0.4 for a in gru.fresh(12, 1)]
    x, y, _, real = next(gru.Lanes([rng.integers(0, 12, n) for n in (3, 6, 2, 1)], 2).windows())
    h = np.zeros((4, x.shape[1]))
    grads, rows, _, _ = gru.gradients(p, x, y, real, h)
    whole = np.zeros(p[0].shape)
    whole[rows] = grads[0]
    grads[0] = whole
    for k, a in enumerate(p):
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in a.shape)
            was, losses = a[at], []
            for step in (0.01, -0.01):
                a[at] = was + step
                losses.append(gru.gradients(p, x, y, real, h)[3])
            a[at] = was
            assert abs((losses[0] - losses[1]) / 0.02 - grads[k][at]) < 2e-2 * max(1, abs(grads[k][at]))


def test_training_lowers_the_loss_of_held_out_texts(monkeypatch):
    """A pass over texts whose next word depends on the last one, scored on others: well below their frequencies' loss."""
    rng = np.random.default_rng(3)
    step = rng.integers(1, 300, 300)
    docs = [np.array(_walk(rng, step), np.int32) for _ in range(700)]
    p = gru.fresh(300)
    counts = np.bincount(np.concatenate(docs[:600]), minlength=300)
    gru.set_biases(p, counts)
    n = sum(map(len, docs[600:]))
    before = -gru.score(p, docs[600:]).sum() / n
    monkeypatch.setattr(gru, "LANES", 32)
    seen = [np.full_like(a, 1e-6) for a in p]
    gru.train(p, seen, docs[:600])
    assert -gru.score(p, docs[600:]).sum() / n < 0.75 * before


def _walk(rng, step):
    out = [int(rng.integers(1, 300))]
    for _ in range(80):
        out.append(int(step[out[-1]]) if rng.random() < 0.8 else int(rng.integers(1, 300)))
    return out


def test_empty_table_and_nothing_to_train_on(spark, small):
    schema = "doc_id long, text string"
    assert lm_scoring.op8_query(spark.createDataFrame([], schema)).collect() == []
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm_scoring.op8_query(spark.createDataFrame([(held, "a b")], schema)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


def test_size_of_the_model():
    p = gru.fresh(lm_scoring.SYMBOLS)
    assert p[1].shape[0] >= 16
    words = [b"w%d" % i for i in range(3000)]
    known = lm_scoring.Lexicon(3000, 3000, words, np.ones(3000), np.zeros(16), np.zeros(16)).ready()
    assert len({s for s in known.symbols.tolist() if s > lm_scoring.ENDINGS}) >= 2031  # words with a symbol of their own


def softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def brute_score(p, lexicon, counts, words):
    """A text's log10 probability, one token and one number at a time."""
    h, total, before = [0.0] * gru.HIDDEN, 0.0, len(p[0]) - 1
    top = {w: 1 + lm_scoring.ENDINGS + i for i, w in enumerate(lexicon.words[: lm_scoring.SYMBOLS - 1 - lm_scoring.ENDINGS]) if w}
    sig = lambda v: 1 / (1 + math.exp(-v))
    for w in [*words, b""]:
        x, n = p[0][before], gru.HIDDEN
        hu = [sum(h[i] * p[1][i][k] for i in range(n)) for k in range(3 * n)]
        z, r = [sig(x[k] + hu[k]) for k in range(n)], [sig(x[n + k] + hu[n + k]) for k in range(n)]
        c = [math.tanh(x[2 * n + k] + r[k] * hu[2 * n + k]) for k in range(n)]
        h = [c[k] + z[k] * (h[k] - c[k]) for k in range(n)]
        end = zlib.crc32(w[-2:]) % lm_scoring.ENDINGS
        y = 0 if not w else top.get(w, 1 + end)
        kind, own = divmod(y, gru.CLASS_SIZE)
        total += math.log10(softmax([sum(h[i] * p[2][i][k] for i in range(n)) + p[3][k] for k in range(len(p[3]))])[kind])
        total += math.log10(softmax([sum(h[i] * p[4][kind][i][k] for i in range(n)) + p[5][kind][k] for k in range(gru.CLASS_SIZE)])[own])
        if 1 <= y <= lm_scoring.ENDINGS:  # within a class of rare words, by count
            rare = [v for v in counts if v and v not in top and zlib.crc32(v[-2:]) % lm_scoring.ENDINGS == end]
            total += math.log10((counts.get(w, 0) + 1) / (sum(counts[v] for v in rare) + len(rare) + 1))
        before = y
    return total


def test_whole_documents_against_brute_force(monkeypatch):
    """Texts with rare, unknown and common words: base and model score from what workers and the join add up."""
    monkeypatch.setattr(lm_scoring, "SYMBOLS", 40)
    monkeypatch.setattr(gru, "CLASS_SIZE", 8)
    rng = np.random.default_rng(5)
    p = [a + rng.normal(size=a.shape).astype(np.float32) * 0.3 for a in gru.fresh(40, 2)]
    rows = corpus(120)[:-1] + [(200, "Da1 never seen \u00fc2 " * 9)]
    counts = Counter(w for _, t in rows[::2] for w in [*lm_scoring.tokens(t), b""])
    ordered = sorted(counts.items(), key=lambda r: (-r[1], r[0]))[:60]
    tails = np.zeros((lm_scoring.ENDINGS, 2))
    for w, c in counts.items():
        if w and w not in [v for v, _ in ordered[: 40 - 1 - lm_scoring.ENDINGS]]:
            tails[lm_scoring.ending(w)] += (c, 1)
    known = lm_scoring.Lexicon(sum(counts.values()), len(counts), [w for w, _ in ordered], np.array([c for _, c in ordered], float), tails[:, 0], tails[:, 1]).ready()
    double, unseen = [a.astype(float) for a in p], 0
    for _, t in rows[:40] + rows[-3:]:
        n, _, base, own, rare, symbols = known.read(t)
        more = sum(math.log10(counts[w] + 1) for w in rare)
        unseen += any(w not in counts for w in rare)
        words = lm_scoring.tokens(t)
        got = gru.score(p, [np.frombuffer(symbols, "<u2").astype(np.int32)])[0] / math.log(10) + own + more
        assert n == len(words) + 1 and abs(got - brute_score(double, known, counts, words)) < 1e-4 * n, t
        assert abs(base + more - sum(math.log10((counts[w] + 1) / (known.total + known.types + 1)) for w in [*words, b""])) < 1e-6
    assert unseen


def test_windows_follow_tokens_not_the_longest_document():
    """Short documents beside a long one: every symbol once and in order, in windows of about the first one's tokens."""
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 9, n) for n in (20_000, *[40] * 200)]
    lanes, seen = gru.Lanes(docs, 64), [[] for _ in docs]
    windows = list(lanes.windows())
    for x, y, owners, real in windows:
        assert real.any(axis=1).all() and x.size <= gru.WINDOW * 64
        for lane in range(x.shape[1]):
            for i in np.unique(owners[:, lane][real[:, lane]]):
                seen[i] += y[:, lane][real[:, lane] & (owners[:, lane] == i)].tolist()
    assert all(s == d.tolist() for s, d in zip(seen, docs, strict=True))
    assert len(windows) < 40  # 1,250 if each had 16 steps


def test_texts_are_read_together_as_alone():
    words = [b"a", b"b\xc3\xbc", b""]
    known = lm_scoring.Lexicon(9, 5, words, np.array([5.0, 3.0, 1.0]), np.arange(16.0), np.ones(16)).ready()
    texts = ["A bü new", None, "", "new " * 30, "a"]
    together = list(zip(*(c.to_pylist() for c in known.read_all(texts)), strict=True))
    assert together == [known.read(t) for t in texts]
    assert [r[:2] for r in together] == [(4, 3), (1, 1), (1, 1), (31, 1), (2, 2)] and together[0][4] == [b"new"] and len(together[3][5]) == 62
    none = lm_scoring.Lexicon(0, 0, [], np.zeros(0), np.zeros(16), np.zeros(16)).ready().read("a b")
    assert none[:2] == (3, 0) and none[4] == [b"a", b"b"]
