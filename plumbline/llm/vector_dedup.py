"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors u are quantised as u = s q + e with q in int8 and the error's length |e| known for each vector. For two
of them, u.v differs from s t (q.p) by at most |e| (1 + |f|) + |f|, so a tile product of the q alone shows which pairs
surely reach the threshold, which surely do not, and which are possible. Products run as float32 matrix products of
whole numbers, which are exact below 2**24.

Vectors that are equal are one class with a weight. Classes are dealt to blocks (nearest of a few pivots, then a hash,
so no block is large), blocks too far apart by the triangle inequality of angles are never paired, and each remaining
pair of blocks is one tile. What goes to the tiles are the codes, a byte a component, packed in lumps. A tile passes on,
for each class with links, their weight and one edge of a spanning forest, never its pairs; and each class that is in a
possible pair. Those alone meet their whole vectors, tile by tile, where their possible pairs are computed in double
precision.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import Forest, components
from plumbline.llm.draw import drawn
from plumbline.llm.scratch import saved
from plumbline.llm.skew import join_counted

LOG = logging.getLogger(__name__)

THRESHOLD = 0.9
#: Pivots: the square root of a 1024th of the classes within these bounds.
PIVOTS = (8, 256)
#: Classes in a block: n / MIN_BLOCKS within these bounds (and BLOCK_BYTES of codes), and never so few that there are more than MAX_BLOCKS.
BLOCK_ROWS, BLOCK_BYTES = (256, 32768), 1 << 25
MIN_BLOCKS = 8
MAX_BLOCKS = 1 << 14
SUB = 1024
SLACK = 1e-9


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls and with equal lengths as float64 rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # tiny and huge vectors alike
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q in int8, scale, bound of the error's length) of unit rows; the last two are numbers that float32 holds."""
    s = np.nextafter((np.abs(u).max(axis=1) / 127).astype(np.float32), np.float32(2)).astype(np.float64)
    q = np.rint(u / s[:, None])
    error = np.linalg.norm(u - q * s[:, None], axis=1) + 1e-12
    return q.astype(np.int8), s, np.nextafter(error.astype(np.float32), np.float32(4)).astype(np.float64)


Codes = tuple[np.ndarray, np.ndarray, np.ndarray]


def possible(a: Codes, b: Codes | None, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i in a, j in b or i < j in a, sure) of the pairs that may have cosine >= threshold; sure ones have, a part at a time."""
    kind = np.float32 if a[0].shape[1] <= 1000 else np.float64
    (qa, sa, ea), (qb, sb, eb) = ((q.astype(kind), s, e) for q, s, e in (a, a if b is None else b))
    for i0 in range(0, len(qa), SUB):
        for j0 in range(i0 if b is None else 0, len(qb), SUB):
            i, j = slice(i0, i0 + SUB), slice(j0, j0 + SUB)
            product = qa[i] @ qb[j].T
            widest = eb[j].max()
            low = (threshold - SLACK - ea[i] * (1 + widest) - widest) / sa[i]
            low = np.where(low > 0, low / sb[j].max(), -np.inf).astype(product.dtype) - 1  # loose by one for rounding
            x, y = np.nonzero(product >= low[:, None])
            if b is None and i0 == j0:
                x, y = (v[x < y] for v in (x, y))
            about, off = product[x, y] * sa[i][x] * sb[j][y], ea[i][x] * (1 + eb[j][y]) + eb[j][y]
            may = about + off >= threshold - SLACK
            yield x[may] + i0, y[may] + j0, (about - off >= threshold + SLACK)[may]


#: What a tile returns: links and forest edges of classes, or (_tile not null) classes of possible pairs with their codes.
TILE = "_cid long, _links long, _root long, _tile long, _side long, _diagonal boolean, _w long, _q binary, _s double, _e double"


def _linked(cid: np.ndarray, w: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """_cid, _links and _root from pairs of positions."""
    links, forest = np.zeros(len(cid), np.int64), Forest(len(cid))
    for i, j in pairs:
        np.add.at(links, i, w[j])
        np.add.at(links, j, w[i])
        forest.add(i, j)
    found, at = forest.labels(), np.flatnonzero(links)
    return {"_cid": cid[at], "_links": links[at], "_root": cid[found[at]]}


def _first_pass(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        order = np.argsort(side, kind="stable")
        lumps = lambda name, kind: np.concatenate([np.frombuffer(table.column(name)[int(k)].as_buffer(), kind) for k in order])
        cid, w, s, e = lumps("_cids", "<i8"), lumps("_ws", "<i8"), lumps("_ss", "<f4").astype(float), lumps("_es", "<f4").astype(float)
        q = lumps("_qs", np.int8).reshape(len(cid), -1)
        sides = np.repeat(side[order], [len(table.column("_cids")[int(k)].as_buffer()) // 8 for k in order])
        n, alone = int((sides == 0).sum()), bool(table.column("_diagonal")[0].as_py())
        maybe = np.zeros(len(cid), bool)

        def sure() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if n and (alone or n < len(cid)):
                for i, j, known in possible((q[:n], s[:n], e[:n]), None if alone else (q[n:], s[n:], e[n:]), threshold):
                    j = j if alone else j + n
                    maybe[i[~known]] = maybe[j[~known]] = True
                    yield i[known], j[known]

        found, at = _linked(cid, w, sure()), np.flatnonzero(maybe)
        k, m = len(found["_cid"]), len(at)
        none = lambda count, kind: pa.nulls(count, kind)
        tile = table.column("_tile")[0].as_py()
        both = {
            "_cid": [pa.array(found["_cid"]), pa.array(cid[at])], "_links": [pa.array(found["_links"]), none(m, pa.int64())], "_root": [pa.array(found["_root"]), none(m, pa.int64())],
            "_tile": [none(k, pa.int64()), pa.array(np.full(m, tile, np.int64))], "_side": [none(k, pa.int64()), pa.array(sides[at])], "_diagonal": [none(k, pa.bool_()), pa.array(np.full(m, alone))],
            "_w": [none(k, pa.int64()), pa.array(w[at])], "_q": [none(k, pa.binary()), pa.array([q[r].tobytes() for r in at], pa.binary())], "_s": [none(k, pa.float64()), pa.array(s[at])], "_e": [none(k, pa.float64()), pa.array(e[at])],
        }
        return pa.table({c: pa.chunked_array(v) for c, v in both.items()})

    return run


def _second_pass(threshold: float):
    """Links of the possible pairs that are not sure, by whole vectors."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        order = np.argsort(side, kind="stable")
        table, n = table.take(pa.array(order)), int((side == 0).sum())
        u, cid, w = unit(matrix(table.column("_v"))), table.column("_cid").to_numpy(), table.column("_w").to_numpy()
        q = np.frombuffer(b"".join(table.column("_q").to_pylist()), np.int8).reshape(len(cid), -1)
        s, e, alone = table.column("_s").to_numpy(), table.column("_e").to_numpy(), bool(table.column("_diagonal")[0].as_py())

        def exact() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if n and (alone or n < len(cid)):
                for i, j, known in possible((q[:n], s[:n], e[:n]), None if alone else (q[n:], s[n:], e[n:]), threshold):
                    i, j = i[~known], (j if alone else j + n)[~known]
                    for k in range(0, len(i), 1 << 16):
                        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                        near = np.einsum("ij,ij->i", u[x], u[y]) >= threshold
                        yield x[near], y[near]

        return pa.table(_linked(cid, w, exact()))

    return run


def _tiled(classes: DataFrame, n: int, size: int, threshold: float) -> DataFrame:
    """(_cid, _links, _root) of all tiles over the n classes (_cid, _w, _v) of one length, ``size``."""
    spark = classes.sparkSession
    most = max(1, min(BLOCK_ROWS[1], BLOCK_BYTES // size))
    rows = max(min(most, max(BLOCK_ROWS[0], n // MIN_BLOCKS)), -(-n // (MAX_BLOCKS - PIVOTS[1])))
    n_pivots = min(PIVOTS[1], max(PIVOTS[0], int((n / 1024) ** 0.5)))
    picked = drawn(classes.select("_v"), 4 * n_pivots, n, F.col("_v")).collect() or classes.select("_v").limit(1).collect()  # about 4 * PIVOTS[1] at most
    pivots = unit(np.array(sorted(r[0] for r in picked)[:: max(1, len(picked) // n_pivots)][:n_pivots], np.float64))
    n_pivots = len(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(matrix(b.column(2)))
                q, s, e = quantise(u)
                cosine = u @ pivots.T
                near = cosine.argmax(axis=1)
                angle = np.arccos(np.clip(cosine[np.arange(len(near)), near], -1, 1))
                codes = pa.array([r.tobytes() for r in q], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:2], codes, pa.array(s), pa.array(e), pa.array(near.astype(np.int64)), pa.array(angle)], names=["_cid", "_w", "_q", "_s", "_e", "_pivot", "_angle"])

    placed = saved(classes.select("_cid", "_w", "_v").mapInArrow(place, "_cid long, _w long, _q binary, _s double, _e double, _pivot long, _angle double"), "vector-codes")
    size_of = {r["_pivot"]: r["count"] for r in placed.groupBy("_pivot").count().collect()}
    chunks = [-(-size_of.get(p, 0) // rows) for p in range(n_pivots)]
    first = np.concatenate(([0], np.cumsum(chunks)))
    pick = lambda v: F.get(F.array(*[F.lit(int(k)) for k in v]), F.col("_pivot").cast("int"))
    block = pick(first[:-1]) + F.pmod(F.xxhash64("_cid"), F.greatest(pick(chunks), F.lit(1))).cast("int")
    blocked = placed.withColumn("_block", block)
    reach = np.zeros(int(first[-1]))
    for r in blocked.groupBy("_block").agg(F.max("_angle").alias("a")).collect():  # at most MAX_BLOCKS rows
        reach[r["_block"]] = r["a"]
    owner = np.repeat(np.arange(n_pivots), chunks)
    between = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    theta = np.arccos(threshold) + 1e-6
    shared = spark.sparkContext.broadcast((reach, owner, between))
    kept = sum(int((between[owner[k]][owner] - reach[k] - reach <= theta).sum()) for k in range(len(reach)))
    LOG.info("vectors of %d: %d classes in %d blocks, %d of %d ordered pairs of blocks pruned", size, n, len(reach), len(reach) ** 2 - kept, len(reach) ** 2)
    names = ["_tile", "_side", "_diagonal", "_cids", "_ws", "_qs", "_ss", "_es"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, owner, between = shared.value
        total = len(reach)
        for b in batches:
            mine = b.column(5).to_numpy()
            for k in np.unique(mine):
                at = np.flatnonzero(mine == k)
                part = b.take(pa.array(at))
                number = lambda c, kind: part.column(c).to_numpy().astype(kind).tobytes()  # noqa: E731,B023
                lump = [number(0, "<i8"), number(1, "<i8"), b"".join(part.column(2).to_pylist()), number(3, "<f4"), number(4, "<f4")]
                partners = np.flatnonzero(between[owner[k]][owner] - reach[k] - reach <= theta).tolist()
                for p in range(0, len(partners), 64):
                    to = partners[p : p + 64]
                    out = [pa.array([min(k, j) * total + max(k, j) for j in to], pa.int64()), pa.array([int(k > j) for j in to], pa.int64()), pa.array([bool(k == j) for j in to])]
                    yield pa.RecordBatch.from_arrays([*out, *(pa.array([x] * len(to), pa.binary()) for x in lump)], names=names)

    lumps = "_tile long, _side long, _diagonal boolean, _cids binary, _ws binary, _qs binary, _ss binary, _es binary"
    tiles = blocked.select("_cid", "_w", "_q", "_s", "_e", "_block").mapInArrow(spread, lumps)
    once = saved(tiles.groupBy("_tile").applyInArrow(_first_pass(threshold), TILE), "vector-tiles")
    again = once.where("_tile IS NOT NULL").drop("_links", "_root").join(classes.select("_cid", "_v"), "_cid")
    return once.where("_tile IS NULL").select("_cid", "_links", "_root").unionByName(again.groupBy("_tile").applyInArrow(_second_pass(threshold), "_cid long, _links long, _root long"))


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    Null, empty and zero vectors and those with null or non-finite components link with nothing: 0 links, their own
    component, kept. Vectors of different lengths do not link. Rows with equal vectors link with each other, repeated
    rows too. Ids may repeat or be null: links go by row, component_id is the least id that is not null, and kept says
    that the row's id is that. An empty table gives none. The driver gets counts by length, pivot and block only.
    """
    own = vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("_v", lambda x: x != 0)
    held = saved(own.withColumn("_fine", F.coalesce(fine, F.lit(False))).withColumn("_hash", F.when(F.col("_fine"), F.xxhash64("_v"))), "vector-rows")
    grouped = held.where("_fine").groupBy("_hash", "_v").agg(F.count("*").alias("_w"), F.min("_id").alias("_least"))
    classes = saved(grouped.withColumn("_cid", F.monotonically_increasing_id()), "vector-classes")
    lengths = [(r["k"], r["count"]) for r in classes.groupBy(F.size("_v").alias("k")).count().orderBy("k").collect()]
    if not lengths:
        return held.select(F.col("_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    found = saved(reduce(DataFrame.unionByName, [_tiled(classes.where(F.size("_v") == k), n, k, threshold) for k, n in lengths]), "vector-links")
    links = found.groupBy("_cid").agg(F.sum("_links").alias("_links"))
    linked = saved(components(found.select(F.col("_cid").alias("a"), F.col("_root").alias("b"))), "vector-components")
    roots = linked.join(classes.select("_cid", "_least"), F.col("node") == F.col("_cid")).groupBy("root").agg(F.min("_least").alias("_component"))
    named = linked.join(roots, "root").select(F.col("node").alias("_cid"), "_component")
    full = classes.join(links, "_cid", "left").join(named, "_cid", "left")
    full = full.select(F.struct("_hash", "_v").alias("_key"), F.col("_w").alias("_n"), (F.coalesce("_links", F.lit(0)) + F.col("_w") - 1).alias("_links"), F.coalesce("_component", "_least").alias("_c"))
    fine_rows = held.where("_fine").select("_id", F.struct("_hash", "_v").alias("_key"))
    out = join_counted(fine_rows, saved(full, "vector-named"), "_key").select("_id", "_links", "_c")
    out = out.unionByName(held.where("NOT _fine").select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_c")))
    return out.select(F.col("_id").alias(id_col), F.col("_links").cast("long").alias("n_links"), F.col("_c").alias("component_id"), F.col("_id").eqNullSafe(F.col("_c")).alias("kept"))


def op5_query(vectors: DataFrame) -> DataFrame:
    return dedup(vectors.select("vec_id", "embedding"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
f AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
c AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT c.vec_id, l.b FROM c JOIN l ON c.r = l.a),
m AS (SELECT vec_id, min(r) AS component_id FROM c GROUP BY ALL), k AS (SELECT a, count(*) AS n FROM l GROUP BY ALL)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k ON vec_id = a
"""
