"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut in two halves, and each half is quantised by a codebook of its own, so K centroids a half make K * K
cells, far finer than K of whole vectors. A query adds up its halves' distances and traverses pairs of centroids by the
sum with a heap, nearest first, until the cells it has reached hold its budget of entries; those are reranked exactly.

The codebooks are fitted to a bounded sample; every vector is indexed. The budget is measured, not guessed: for a sample
of the queries the true neighbours are found by a scan of the whole index, and the budget is the least with which the
traversal reaches TARGET of them. So recall holds at any size and on any data; what follows the data is the work.

Equal vectors are one entry with its least ids, as many as a result can hold. Neighbouring cells are packed into tiles of
bounded size, a cell with more entries is dealt over several, and a tile's queries over parts; a tile reranks all its
entries, also those of cells beyond the budget. So no task gathers more than a tile, however many vectors are alike.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.draw import drawn
from plumbline.llm.scratch import saved
from plumbline.llm.skew import join_counted
from plumbline.llm.vector_dedup import matrix, unit

LOG = logging.getLogger(__name__)

NEAREST, EVERY = 5, 50
#: The codebooks' sample: about so many vectors, and so many components of all together.
SAMPLE, SAMPLE_FLOATS = 1 << 14, 1 << 20
#: Entries that a cell should have, centroids of a half at most, sampled vectors a centroid at least, rounds of fitting.
CELL, MAX_CODES, PER_CODE, ROUNDS = 256, 512, 8, 12
#: Queries whose true neighbours set the budget, about, and the share of those neighbours that it must reach.
CALIBRATION, TARGET = 256, 0.95
#: Entries in a tile, queries in a part of a tile, and queries that are ranked at once.
TILE, QUERIES, SUB = 2048, 4096, 256
#: How far two computations of one cosine can differ.
EPS = 1e-12


class Books:
    """Codebooks of the two halves."""

    def __init__(self, sample: np.ndarray, k: int) -> None:
        self.cut, self.k = -(-sample.shape[1] // 2), k
        self.halves = [self._fit(half, k) for half in (sample[:, : self.cut], sample[:, self.cut :])]

    @staticmethod
    def _gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1), 0)

    def _fit(self, x: np.ndarray, k: int) -> np.ndarray:
        c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(ROUNDS):
            gaps = self._gaps(x, c)
            near = gaps.argmin(axis=1)
            far = np.argsort(-gaps[np.arange(len(x)), near], kind="stable")
            for j in range(k):
                mine = near == j
                c[j] = x[mine].mean(axis=0) if mine.any() else x[far[j]]  # an empty centroid moves to a far vector
        return c

    def gaps(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of unit rows to the centroids of each half."""
        return self._gaps(u[:, : self.cut], self.halves[0]), self._gaps(u[:, self.cut :], self.halves[1])

    def cells(self, u: np.ndarray) -> np.ndarray:
        first, second = self.gaps(u)
        return first.argmin(axis=1) * self.k + second.argmin(axis=1)


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, budget: int) -> list[int]:
    """The cells that have entries, by summed distance, until they hold ``budget`` entries; ties by rank in the first half."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y, k = first[a].tolist(), second[b].tolist(), len(second)
    heap, out, got = [(x[0] + y[0], 0, 0)], [], 0
    while heap and got < budget:
        _, i, j = heappop(heap)
        if j + 1 < len(y):
            heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(x):
            heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        cell = int(a[i]) * k + int(b[j])
        if counts[cell]:
            out.append(cell)
            got += int(counts[cell])
    return out


def before(first: np.ndarray, second: np.ndarray, counts: np.ndarray, cells: list[int]) -> list[int]:
    """How many entries the traversal reaches before each of ``cells``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    order = (a[:, None] * len(second) + b[None])[np.arange(len(a))[:, None], np.arange(len(b))[None]].ravel()
    order = order[np.argsort((first[a][:, None] + second[b][None]).ravel(), kind="stable")]
    upto, place = np.cumsum(counts[order]), np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return [int(upto[place[c]] - counts[c]) for c in cells]


def layout(counts: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """(first tile of each cell, how many tiles the cell's entries are dealt over): small cells share a tile."""
    first, spread, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), -1, 0
    for c in np.flatnonzero(counts).tolist():
        if at < 0 or held + counts[c] > tile:
            at, held = at + 1, 0
        first[c], held = at, held + int(counts[c])
        if held > tile:  # a cell alone
            spread[c] = -(-held // tile)
            at += int(spread[c]) - 1
    return first, spread


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; rows are scaled by powers of two, so no square overflows and nothing is rounded."""
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None]) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


Ranked = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def first_of(rows: Ranked, most: int) -> Ranked:
    """Of (query, score, id, own, entry) the ``most`` first of each query: by score, then by id."""
    order = np.lexsort((rows[2], -rows[1], rows[0]))
    query = rows[0][order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    order = order[rank < most]
    return tuple(c[order] for c in rows)


def rank(queries: np.ndarray, entries: np.ndarray, ids: pa.ListArray, most: int) -> Ranked:
    """The ``most`` nearest ids of each query among the entries' ids; own says that the entry equals the query."""
    flat, offsets = ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy())]
    uq, ue, parts = unit(queries), unit(entries), []
    least = min(most, len(entries))
    for k in range(0, len(queries), SUB):
        product = uq[k : k + SUB] @ ue.T
        cut = np.partition(product, len(entries) - least, axis=1)[:, len(entries) - least]
        i, j = np.nonzero(product >= cut[:, None] - EPS)
        score, own = np.empty(len(i)), np.empty(len(i), bool)
        for p in range(0, len(i), 1 << 14):
            s = slice(p, p + (1 << 14))
            x, y = queries[k + i[s]], entries[j[s]]
            score[s], own[s] = cosine(x, y), (x == y).all(axis=1)
        n = offsets[j + 1] - offsets[j]
        at = np.repeat(offsets[j] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        again = np.repeat(np.arange(len(i)), n)
        parts.append(first_of(((k + i)[again], score[again], flat[at], own[again], j[again]), most))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _budget(placed: DataFrame, asked: DataFrame, n_asked: int, counts: np.ndarray, books: Books, most: int, target: float) -> int:
    """The least number of entries that reaches ``target`` of the sampled queries' true neighbours."""
    some = sorted(drawn(asked.select("_v"), CALIBRATION, n_asked, F.col("_v")).collect())  # about CALIBRATION vectors
    if not some or len(counts) == 1:
        return int(counts.sum())
    queries = np.array([r[0] for r in some], np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            if b.num_rows:
                q, score, ids, own, j = rank(queries, matrix(b.column(2)), b.column(1), most)
                rows = q, score, ids, own, b.column(0).to_numpy()[j]
                best = first_of(tuple(np.concatenate(c) for c in zip(best, rows, strict=True)), most) if best else rows
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["q", "score", "id", "own", "cell"])

    near = placed.select("_cell", "_ids", "_v").mapInArrow(scan, "q long, score double, id long, own boolean, cell long")
    top = near.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("r") <= most)
    true: dict[int, list] = {}
    for r in top.orderBy("q", "r").collect():  # CALIBRATION * most rows
        true.setdefault(r["q"], []).append(r)
    first, second = books.gaps(unit(queries))
    needs = []
    for q, rows in true.items():
        itself = next((k for k, r in enumerate(rows) if r["own"]), None)  # one row is the query's own
        needs += before(first[q], second[q], counts, [r["cell"] for k, r in enumerate(rows) if k != itself][: most - 1])
    if not needs:
        return int(counts.sum())
    return max(most, sorted(needs)[max(0, -(-int(target * 1e6) * len(needs) // 10**6) - 1)] + 1)


def _found(classes: DataFrame, asked: DataFrame, n: int, size: int, most: int, target: float) -> DataFrame:
    """(_qid, _score, _id, _own): the ``most`` nearest that the index finds for each of ``asked``, all vectors of one length."""
    spark = classes.sparkSession
    n_asked = asked.count()
    sample = sorted(drawn(classes.select("_v"), min(SAMPLE, SAMPLE_FLOATS // size), n, F.col("_v")).collect())
    sample = unit(np.array([r[0] for r in sample], np.float64))
    k = int(max(1, min(MAX_CODES, len(sample) // PER_CODE, round((n / CELL) ** 0.5))))
    shared = spark.sparkContext.broadcast(books := Books(sample, k))
    kind = classes.schema["_v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.cells(unit(matrix(b.column(1))))), *b.columns], names=["_cell", "_ids", "_v"])

    placed = saved(classes.select("_ids", "_v").mapInArrow(place, f"_cell long, _ids array<long>, _v {kind}"), "multi-index")
    counts = np.zeros(k * k, np.int64)
    for r in placed.groupBy("_cell").count().collect():  # MAX_CODES squared at most
        counts[r["_cell"]] = r["count"]
    budget = _budget(placed, asked, n_asked, counts, books, most, target)
    first, spread = layout(counts, TILE)
    LOG.info("vectors of %d: %d entries in %d of %d cells, budget %d entries a query", size, n, int((counts > 0).sum()), k * k, budget)
    plan = spark.sparkContext.broadcast((counts, first, spread))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, first, spread = plan.value
        for b in batches:
            for at in range(0, b.num_rows, SUB):
                part = b.slice(at, SUB)
                tiles = []
                for x, y in zip(*shared.value.gaps(unit(matrix(part.column(1)))), strict=True):
                    cells = np.array(traverse(x, y, counts, budget))
                    tiles.append(np.unique(np.concatenate([first[cells], *(np.arange(first[c], first[c] + spread[c]) for c in cells[spread[cells] > 1])])))
                rows = pa.array(np.repeat(np.arange(len(tiles)), [len(t) for t in tiles]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tiles)), part.column(0).take(rows), part.column(1).take(rows)], names=["_tile", "_qid", "_v"])

    probes = saved(asked.select("_qid", "_v").mapInArrow(probe, f"_tile long, _qid long, _v {kind}"), "multi-probes")
    parts = saved(probes.groupBy("_tile").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_parts")), "multi-parts")
    used = np.flatnonzero(counts)
    where = spark.createDataFrame([(int(c), int(first[c]), int(spread[c])) for c in used], "_cell long, _first long, _spread long")  # MAX_CODES squared rows at most
    tile = F.col("_first") + F.pmod(F.xxhash64("_ids", "_v"), F.col("_spread"))
    entries = placed.join(F.broadcast(where), "_cell").select(tile.alias("_tile"), "_ids", "_v").join(parts, "_tile")
    entries = entries.select("_tile", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.lit(None).cast("long").alias("_qid"), "_ids", "_v")
    asking = probes.join(parts, "_tile").select("_tile", F.pmod(F.xxhash64("_qid"), F.col("_parts")).cast("int").alias("_part"), "_qid", F.lit(None).cast("array<long>").alias("_ids"), "_v")

    def rerank(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("_qid").is_valid()
        q, e = table.filter(asks), table.filter(pc.invert(asks))
        if not q.num_rows or not e.num_rows:
            return pa.table({"_qid": pa.array([], pa.int64()), "_score": pa.array([], pa.float64()), "_id": pa.array([], pa.int64()), "_own": pa.array([], pa.bool_())})
        ids = e.column("_ids").combine_chunks()
        at, score, found, own, _ = rank(matrix(q.column("_v")), matrix(e.column("_v")), ids, most)
        return pa.table({"_qid": q.column("_qid").to_numpy()[at], "_score": score, "_id": found, "_own": own})

    near = entries.unionByName(asking).groupBy("_tile", "_part").applyInArrow(rerank, "_qid long, _score double, _id long, _own boolean")
    return near.withColumn("_r", F.row_number().over(W.partitionBy("_qid").orderBy(F.desc("_score"), "_id"))).where(F.col("_r") <= most).drop("_r")


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, score): the nearest rows of each row for which ``is_query`` holds, by cosine in double precision.

    Vectors that are null, empty or zero or hold null or non-finite components, and rows without an id, take no part, as
    queries or as candidates. Vectors are compared with those of equal length, each length by an index of its own.
    Candidates are all rows but the query's own: of repeated rows each is a query, and the others are its candidates.
    Ranks go by score, ties by id; a query with fewer candidates gets them all, one without any gets no row. Small
    tables have one cell, where the search is exact. An empty table gives none. Ids are longs; other columns are not
    read. The driver gets the samples, and counts by length and cell.
    """
    most = nearest + 1  # the query's own row may be among them
    own = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector).alias("_v"), is_query.alias("_asks"))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("_v", lambda x: x != 0)
    held = saved(own.where(F.col("_id").isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("_hash", F.xxhash64("_v")), "multi-rows")
    least = W.partitionBy("_hash", "_v").orderBy("_id")  # Spark keeps the first rows of a group before it shuffles
    few = held.select("_hash", "_v", "_id").withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= most)
    classes = saved(few.groupBy("_hash", "_v").agg(F.collect_list("_id").alias("_ids")).select("_ids", "_v"), "multi-classes")
    asking = held.where("_asks").select("_id", F.struct("_hash", "_v").alias("_key"))
    asked = saved(asking.groupBy("_key").agg(F.count("*").alias("_n")).select("_key", "_n", F.col("_key._v").alias("_v"), F.monotonically_increasing_id().alias("_qid")), "multi-asked")
    lengths = [(r["k"], r["count"]) for r in classes.groupBy(F.size("_v").alias("k")).count().orderBy("k").collect()]
    found = [_found(classes.where(F.size("_v") == k), asked.where(F.size("_v") == k), n, k, most, target) for k, n in lengths if asked.where(F.size("_v") == k).limit(1).count()]
    if not found:
        return own.where("false").select(F.col("_id").alias("query_id"), F.lit(0).alias("rank"), F.col("_id").alias(id_col), F.lit(0.0).alias("score"))
    near = reduce(DataFrame.unionByName, found).groupBy("_qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("_score")).alias("far"), F.col("_id").alias("id"), F.col("_own").alias("own"), F.col("_score").alias("score")))).alias("_near"))
    listed = saved(asked.join(near, "_qid").select("_key", "_n", "_near"), "multi-found")
    rows = join_counted(asking, listed, "_key")
    itself = F.array_position(F.transform("_near", lambda x: x["own"] & (x["id"] == F.col("_id"))), True)
    others = F.slice(F.filter("_near", lambda x, i: i + 1 != F.col("_itself")), 1, nearest)
    rows = rows.withColumn("_itself", itself).select("_id", F.posexplode(others).alias("_at", "_x"))
    return rows.select(F.col("_id").alias("query_id"), (F.col("_at") + 1).alias("rank"), F.col("_x.id").alias(id_col), F.col("_x.score").alias("score"))


def op13_query(vectors: DataFrame) -> DataFrame:
    return search(vectors.select("vec_id", "embedding"), F.coalesce(F.col("vec_id") % EVERY == 0, F.lit(False)))
