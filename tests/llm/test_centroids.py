import hashlib
import math

import numpy as np
import pytest

from plumbline.llm import centroids


def brute(rows, size, k, rounds, scale=1024):
    """Plain Python over all centroids."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(v) for _, v in by_hash[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        found = [near(v)[1] for _, v in kept]
        c = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), f in zip(kept, found, strict=True) if f == j]) else c[j] for j in range(len(c))]
    last = [near(v) for _, v in kept]
    top = (1 << 63) - 1
    sums = {j: sum(min(d, top) for d, f in last if f == j) for j in range(len(c))}
    return [(i, j, min(d, top), min(sums[j], top), min(sum(sums.values()), top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)]


def near_rows(n, size, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size)) * np.array([[0.1], [1], [1], [3], [10]])
    return [(i, [float(x) for x in np.float32(centres[rng.integers(5)] + 0.3 * rng.normal(size=size))]) for i in range(n)]


def test_query_against_brute_force(spark):
    rows = near_rows(150, 64, 1) + [(7, [0.5] * 64)] * 40 + [(None, [0.25] * 64)] * 2
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("-inf")] * 64)]
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "vec_id long, embedding array<float>, cluster string, distance double").repartition(5)
    got = sorted(map(tuple, centroids.op11_query(docs).collect()), key=str)
    assert got == sorted(brute(rows, 64, 8, 10), key=str)
    again = sorted(map(tuple, centroids.op11_query(docs.repartition(2)).collect()), key=str)
    assert again == got


@pytest.mark.parametrize("k,rounds", [(1, 3), (3, 4), (200, 2)])
def test_other_sizes_ties_and_huge_components(spark, k, rounds):
    rows = [(i, [float(i % 4), float(-(i % 3))]) for i in range(30)] + [(40, [3.0e38, -3.0e38]), (41, [1.0e30, 2.0]), (42, [-0.0001, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(map(tuple, centroids.cluster(docs, size=2, k=k, rounds=rounds).collect()))
    assert got == sorted(brute(exact, 2, k, rounds))


def test_annulus_keeps_the_nearest_and_boundary_ties():
    rng = np.random.default_rng(2)
    for scale in (3, 50, 5000):
        x, c = rng.integers(-scale, scale, (400, 3)), rng.integers(-scale, scale, (60, 3))
        c[10:20] = c[:10]  # equal centroids
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        found, best, asked = centroids.nearest(x, c)
        assert (best == d.min(axis=1)).all() and (found == d.argmin(axis=1)).all()
        assert asked < 0.8 * d.size  # the annulus leaves centroids out
    line = np.array([[0, 0], [4, 0], [-4, 0], [0, 4]])
    assert centroids.nearest(np.array([[2, 0], [-2, 0], [2, 2]]), line)[0].tolist() == [0, 0, 0]
    assert centroids.nearest(np.array([[2, 0]]), line[::-1])[0].tolist() == [2]  # (4, 0) and (0, 0) at distance 2: the smaller number


def test_empty_and_nothing_fine(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.op11_query(spark.createDataFrame([], schema)).collect() == []
    assert centroids.op11_query(spark.createDataFrame([(1, None), (2, [1.0])], schema)).collect() == []
    one = centroids.op11_query(spark.createDataFrame([(1, [0.5] * 64)], schema)).collect()
    assert [tuple(r)[:5] for r in one] == [(1, 0, 0, 0, 0)]
