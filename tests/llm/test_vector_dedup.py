import numpy as np
import pytest

from plumbline.llm import vector_dedup


def brute(rows):
    fine = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in fine:
        for b in fine:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.float32(rows[a][1]).astype(float), np.float32(rows[b][1]).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    links[a].add(b)
                    links[b].add(a)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - group:
                group.add(j)
                todo.append(j)
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return out


@pytest.mark.parametrize("threshold_spread", [0.2, 0.45])
def test_query_against_brute_force(spark, monkeypatch, threshold_spread):
    monkeypatch.setattr(vector_dedup, "BLOCK_ROWS", (8, 16))
    monkeypatch.setattr(vector_dedup, "PIVOTS", (4, 8))
    monkeypatch.setattr(vector_dedup, "SUB", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 16))
    rows = [(i, (rng.choice(centres) + threshold_spread * rng.normal(size=16)).tolist()) for i in range(150)]
    rows += [(200 + i, [float(x) for x in centres[0]]) for i in range(6)] + [(200, rows[3][1]), (None, rows[3][1])]
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [1.0, None] * 8), (304, [float("nan")] * 16), (305, [float("inf")] * 16)]
    rows += [(400, [1.0, 2.0]), (401, [1.0, 2.1]), (402, [1e-38, 2e-38]), (403, [1e38, 2e38]), (404, [-1.0, -2.0])]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, n_links string")
    got = sorted(map(tuple, vector_dedup.op5_query(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_bound_holds_for_any_vectors():
    rng = np.random.default_rng(4)
    for scale in (1, 40):
        u = vector_dedup.unit(rng.standard_t(2, size=(300, 24)) * np.r_[np.full(3, scale), np.ones(21)])
        q, s, e = vector_dedup.quantise(u)
        assert np.abs(q).max() <= 127
        q = q.astype(int)
        off = np.abs(u @ u.T - (q @ q.T).astype(float) * s[:, None] * s)
        assert (off <= e[:, None] * (1 + e) + e + 1e-12).all()


def test_possible_pairs_hold_all_links_and_sure_ones_are():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 12))
    u = vector_dedup.unit(centres[rng.integers(0, 6, 400)] + 0.3 * rng.normal(size=(400, 12)))
    codes, links = vector_dedup.quantise(u), np.triu(u @ u.T >= 0.9, 1)
    parts = list(vector_dedup.possible(codes, None))
    i, j, sure = (np.concatenate(x) for x in zip(*parts, strict=True))
    seen = np.zeros_like(links)
    seen[i, j] = True
    assert (seen | ~links).all() and links[i[sure], j[sure]].all() and 0 < (~sure).sum() < len(i) / 2


def test_empty_and_all_invalid(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_dedup.op5_query(spark.createDataFrame([], schema)).collect() == []
    got = vector_dedup.op5_query(spark.createDataFrame([(1, None), (2, [0.0])], schema)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]
