import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import multi_index


def exact(rows, every=50, nearest=5):
    """(place of the query row, its nearest as (score, id)) by brute force in double precision."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(fine):
        if i % every == 0:
            near = [(float(v @ w) / float(np.linalg.norm(v)) / float(np.linalg.norm(w)), j) for b, (j, w) in enumerate(fine) if b != a and len(w) == len(v)]
            out.append((i, sorted(near, key=lambda x: (-round(x[0], 12), x[1]))[:nearest]))
    return out


def compared(found, want):
    """(share of the true neighbours found, rows); scores are checked."""
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for i, near in want:
        mine = sorted(got.get(i, []))
        assert [r for r, *_ in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(near)
        assert all(s >= t for (*_, s), (*_, t) in zip(mine, mine[1:], strict=False))
        hits += len({j for _, j in near} & {j for _, j, _ in mine})
        total += len(near)
        assert all(abs(s - dict((j, s) for s, j in near)[j]) < 1e-9 for _, j, s in mine if j in {j for _, j in near})
    return hits / max(total, 1), len(found)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CELL", 8), ("TILE", 16), ("QUERIES", 4), ("SUB", 5), ("CALIBRATION", 30)):
        monkeypatch.setattr(multi_index, name, value)


def clustered(n, size, spread, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    return [(i, [float(x) for x in np.float32(centres[rng.integers(12)] + spread * rng.normal(size=size))]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_recall_with_many_cells(spark, small, spread):
    rows = clustered(1200, 16, spread)
    found = multi_index.op13_query(spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(5)).collect()
    share, n = compared(found, exact(rows))
    assert share >= 0.9 and n == 24 * 5
    again = multi_index.op13_query(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))


def test_copies_ties_repeated_rows_and_odd_vectors(spark, small):
    """A third of all rows is one vector, some are its multiples; the search is exact there but for what the cells miss."""
    rows = clustered(150, 5, 0.3) + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0]) for i in range(100)]
    rows += [(2000 + i, [2.0**i * x for x in (1.0, 2.0, 3.0, 4.0, 5.0)]) for i in range(1, 8)]
    rows += [(1050, [1.0, 2.0, 3.0, 4.0, 5.0]), (3000, [1e-38] * 5), (3050, [1e38] * 5), (3100, [3.0, 4.0]), (3150, [4.0, 3.0]), (3200, [1.0, 0.0, 0.0])]
    rows += [(None, [1.0, 2.0, 3.0, 4.0, 5.0]), (4000, None), (4050, []), (4100, [0.0] * 5), (4150, [None] + [1.0] * 4), (4200, [float("nan")] * 5), (4250, [float("inf")] * 5)]
    found = multi_index.op13_query(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.query_id for r in found} == {0, 50, 100, 1000, 1050, 2000 + 0} - {2000} | {3000, 3050, 3100, 3150}
    near = {}
    for r in found:
        near.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert sorted(near[1000]) == [(k, 1000 + k) for k in range(1, 6)]
    assert sorted(near[1050])[:2] == [(1, 1000), (1, 1000)] and len(near[1050]) == 10  # two rows with one id: each is a query
    assert near[3100] == [(1, 3150)] and near[3150] == [(1, 3100)]
    single = [(i, v) for i, v in rows if i != 1050]
    share, _ = compared([r for r in found if r.query_id != 1050], [(i, n) for i, n in exact(rows) if i != 1050])
    assert share >= 0.9 and single


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(3)
    for ties in (False, True):
        first, second = rng.random(9), rng.random(7)
        if ties:
            first, second = np.round(first * 3), np.round(second * 3)
        counts = rng.integers(0, 3, 63)
        order = multi_index.traverse(first, second, counts, 10**9)
        sums = [first[c // 7] + second[c % 7] for c in order]
        assert sums == sorted(sums) and sorted(order) == np.flatnonzero(counts).tolist()
        reached = np.cumsum([0, *counts[order]])
        assert multi_index.before(first, second, counts, order) == reached[:-1].tolist()
        part = multi_index.traverse(first, second, counts, 20)
        assert part == order[: len(part)] and reached[len(part)] >= 20 > reached[len(part) - 1]


def test_layout_keeps_tiles_small():
    counts = np.array([3, 0, 4, 9, 30, 1, 1, 0, 8])
    first, spread = multi_index.layout(counts, 8)
    assert spread.tolist() == [1, 1, 1, 2, 4, 1, 1, 1, 1]
    assert first[[0, 2, 3, 4, 5, 6, 8]].tolist() == [0, 0, 1, 3, 7, 7, 8]


def test_recall_on_the_given_vectors(spark, monkeypatch):
    """The given vectors have no structure beyond a label, the worst case; with cells of 16 the traversal must leave some out."""
    monkeypatch.setattr(multi_index, "CELL", 16)
    path = "/root/testdata/sf0.1/embeddings.parquet"
    t = pq.read_table(path).to_pydict()
    found = multi_index.op13_query(spark.read.parquet(path)).collect()
    share, n = compared(found, exact(list(zip(t["vec_id"], t["embedding"], strict=True))))
    assert share >= 0.9 and n == 200


def test_empty_and_alone(spark):
    schema = "vec_id long, embedding array<float>"
    assert multi_index.op13_query(spark.createDataFrame([], schema)).collect() == []
    assert multi_index.op13_query(spark.createDataFrame([(50, [1.0]), (51, None)], schema)).collect() == []
    assert [tuple(r) for r in multi_index.op13_query(spark.createDataFrame([(50, [1.0]), (51, [-2.0])], schema)).collect()] == [(50, 1, 51, -1.0)]
    by_label = multi_index.search(spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.5], "b")], schema + ", label string"), F.col("label") == "b", nearest=1)
    assert [(r.query_id, r.vec_id) for r in by_label.collect()] == [(2, 1)]
