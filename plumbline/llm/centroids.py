"""Centroid clustering in whole numbers, with annulus search for the nearest centroid.

By the triangle inequality a centroid within u of a vector has a norm within u of the vector's. So centroids are sorted
by norm; a binary search finds the one of nearest norm, whose exact distance is the vector's upper bound u, and two more
find the annulus of norms within u. Only the centroids there are compared, outwards from the first, exactly, each better
one narrowing the annulus; of equal distances the smaller number wins. Rounding can only widen the annulus, so a tie on
its boundary is never lost.

Components are integers and every sum is exact, so results do not depend on partitions or order. A round reads the
written vectors once and keeps nothing between rounds but the centroids: a lost executor costs its tasks alone. A task
passes on one partial sum for each centroid's component; the driver gets their totals, centroids times components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import Table, saved
from plumbline.llm.vector_dedup import matrix

COMPONENTS, CLUSTERS, ROUNDS, SCALE = 64, 8, 10, 1024
#: The largest magnitude of a component: that of a finite float.
LARGEST = float(np.finfo(np.float32).max)
#: Sums travel as five limbs of 32 bits, so that their totals fit in a long for any number of partitions; the last is signed.
LIMBS = 5
LONG_MAX = (1 << 63) - 1
#: What rounding can add to a norm or a bound, as a share of them.
SLACK = 1e-9


def whole(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * x) as float64, which rows have squared distances that fit in a long whatever small row they meet)."""
    y = np.floor(x * scale)
    return y, np.abs(y).max(axis=1, initial=0) < 2 ** ((61 - max(x.shape[1] - 1, 1).bit_length()) // 2)


def integers(y: np.ndarray, small: bool) -> np.ndarray:
    """Whole numbers in float64 as int64 where they are small, else as Python's integers."""
    return y.astype(np.int64) if small else np.array([[int(v) for v in row] for row in y], object).reshape(y.shape)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1).astype(np.float64))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, how many distances were computed) for each row of integers."""
    if object in (x.dtype, centroids.dtype):
        x, centroids = x.astype(object), centroids.astype(object)
    own, all_norms = norms(x), norms(centroids)
    order = np.argsort(all_norms, kind="stable")
    ring, last = all_norms[order], len(centroids) - 1
    right = np.searchsorted(ring, own).clip(0, last)
    left = np.maximum(right - 1, 0)
    guess = np.where(np.abs(ring[left] - own) <= np.abs(ring[right] - own), left, right)
    found = order[guess]
    best, asked = ((x - centroids[found]) ** 2).sum(axis=1), len(x)
    reach = lambda rows: np.sqrt(best[rows].astype(np.float64)) + SLACK * (own[rows] + np.sqrt(best[rows].astype(np.float64)) + 1)
    everyone = np.arange(len(x))
    first = reach(everyone)
    low, high = np.searchsorted(ring, own - first, "left"), np.searchsorted(ring, own + first, "right")
    for side in (-1, 1):  # outwards from the guess; a better centroid narrows the annulus
        rows, p = everyone, guess
        while True:
            p = p + side
            inside = (low[rows] <= p) & (p < high[rows])
            rows, p = rows[inside], p[inside]
            inside = np.abs(ring[p] - own[rows]) <= reach(rows)
            rows, p = rows[inside], p[inside]
            if not len(rows):
                break
            j = order[p]
            d = ((x[rows] - centroids[j]) ** 2).sum(axis=1)
            closer = ((d < best[rows]) | ((d == best[rows]) & (j < found[rows]))).astype(bool)
            best[rows[closer]], found[rows[closer]] = d[closer], j[closer]
            asked += len(rows)
    return found, best, asked


def _assigned(column: pa.Array, scale: int, centroids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, their integers, centroids, distances), rows with small components and others apart."""
    y, small = whole(matrix(column), scale)
    fixed = np.array(centroids, object).reshape(len(centroids), -1)
    if max(map(abs, fixed.flat)) < 2 ** ((61 - max(y.shape[1] - 1, 1).bit_length()) // 2):
        fixed = fixed.astype(np.int64)
    for which, kind in ((small, True), (~small, False)):
        rows = np.flatnonzero(which)
        if len(rows):
            x = integers(y[rows], kind)
            found, distance, _ = nearest(x, fixed)
            yield rows, x, found, distance


def _moved(held: DataFrame, scale: int, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: the exact floor of the mean of the vectors nearest to each; empty ones stay."""
    k, size = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, size), object)
        for b in batches:
            if b.num_rows:
                for _, x, found, _ in _assigned(b.column(0), scale, centroids):
                    for j in np.unique(found):
                        mine = x[found == j]
                        count[j] += len(mine)
                        total[j] += mine.sum(axis=0).astype(object)
        used = np.flatnonzero(count)
        flat = [int(v) for v in total[used].flat]
        limbs = [[v >> 32 * n & 0xFFFFFFFF for v in flat] for n in range(LIMBS - 1)] + [[v >> 32 * (LIMBS - 1) for v in flat]]
        columns = [np.repeat(used, size), np.tile(np.arange(size), len(used)), np.repeat(count[used], size), *limbs]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["c", "i", "n", *(f"l{n}" for n in range(LIMBS))])

    parts = held.select("_v").mapInArrow(sums, "c long, i long, n long, " + ", ".join(f"l{n} long" for n in range(LIMBS)))
    rows = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), *(F.sum(f"l{n}").alias(f"l{n}") for n in range(LIMBS))).collect()  # k * size at most
    out = [list(c) for c in centroids]
    for r in rows:
        out[r["c"]][r["i"]] = sum(r[f"l{n}"] << 32 * n for n in range(LIMBS)) // r["n"]
    return out


def fine(vector: Column, size: int) -> Column:
    """Whether a vector has exactly ``size`` components, none of them null or non-finite (or beyond what a float holds)."""
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST))), F.lit(False))


def seeds(held: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The first centroids: the k rows of smallest sha256 of ``salt:id``; null ids come last, rows of one id by vector."""
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("_id").cast("string")), 256)
    rows = held.orderBy(drawn.asc_nulls_last(), "_v").limit(k).select("_v").collect()  # each partition sends k at most
    return [[int(v) for v in np.floor(np.array(r[0], np.float64) * scale)] for r in rows]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", size: int = COMPONENTS, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, salt: str = "3") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every row whose vector is ``fine``.

    Vectors that are null, of another length or with null or non-finite components get no row. Repeated rows count each
    for itself; ids may repeat or be null. With fewer rows than ``k`` there are as many centroids; an empty table, or
    one without a fine vector, gives none. Equal centroids: the smaller number gets all. Components of any magnitude
    that a float holds are exact; distances and inertias above the largest long are given as that. Other columns of
    ``vectors`` are not read. ``k`` and ``size`` set what the driver and each task hold: their product in integers.
    """
    own = vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    held = saved(own.where(fine(F.col("_v"), size)), "cluster-vectors")
    centroids = seeds(held, k, scale, salt)
    for _ in range(rounds if centroids else 0):
        following = _moved(held, scale, centroids)
        if following == centroids:  # nothing can change any more
            break
        centroids = following
    kind = own.schema["_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                number, distance = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64)
                for rows, _, found, d in _assigned(b.column(1), scale, centroids):
                    number[rows], distance[rows] = found, np.minimum(d, LONG_MAX)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number), pa.array(distance)], names=["_id", "cluster", "distance"])

    named = Table(held.mapInArrow(assign, f"_id {kind}, cluster int, distance long"), "cluster-named").df
    capped = lambda x: F.least(x, F.lit(LONG_MAX)).cast("long")
    totals = named.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_t")).collect()  # k rows at most
    total = sum(int(r["_t"]) for r in totals)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [(r["cluster"], min(int(r["_t"]), LONG_MAX), min(total, LONG_MAX), digest[r["cluster"]]) for r in totals]
    facts = own.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return named.join(F.broadcast(facts), "cluster").select(F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_query(vectors: DataFrame) -> DataFrame:
    return cluster(vectors.select("vec_id", "embedding"))


def op11_sql() -> str:
    """The same in SQL: a block of common tables a round, every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, x)) - 1 AS c, x FROM (SELECT x, sha256('3:' || vec_id::VARCHAR) AS h FROM v ORDER BY h NULLS LAST, x LIMIT {CLUSTERS}))""",
    ]
    near = "a{n} AS MATERIALIZED (SELECT r, min(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {k} + c) AS m FROM v, c{n} AS c GROUP BY r)"
    for n in range(ROUNDS):
        parts += [
            near.format(n=n, k=CLUSTERS),
            f"""s{n} AS (SELECT a.m % {CLUSTERS} AS c, i, sum(v.x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n} AS a JOIN v ON a.r = v.r, range(1, {COMPONENTS + 1}) AS g(i) GROUP BY ALL)""",
            f"""m{n} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{n} GROUP BY c)""",
            f"""c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{n} AS o LEFT JOIN m{n} AS m ON o.c = m.c)""",
        ]
    parts += [near.format(n=ROUNDS, k=CLUSTERS), f"f AS (SELECT r, (m % {CLUSTERS})::INTEGER AS cluster, (m // {CLUSTERS})::BIGINT AS distance FROM a{ROUNDS})"]
    return f"""WITH {", ".join(parts)}
    SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM f JOIN v ON f.r = v.r JOIN c{ROUNDS} AS c ON c.c = f.cluster"""
