"""SimHash near-duplicates found with vantage-point trees.

Texts become 64-bit fingerprints; equal ones are one class from then on, however many copies there are. A tree of
vantage points, built from a bounded sample, cuts the space of fingerprints into shards: at a node with vantage v and
radius m, fingerprints within m go inside and the others outside. By the triangle inequality two fingerprints within
r of each other can only be parted there if the inner one is farther than m - r from v; such boundary fingerprints
also go outside. So every pair within r meets in some shard, whatever the sample was. Inside a shard the same tree,
built on the shard itself, prunes down to small tiles that are compared exactly.

A shard passes on a spanning forest of its links, not its pairs, and components are contracted across shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.batches import each
from plumbline.llm.components import Forest, components
from plumbline.llm.draw import drawn
from plumbline.llm.scratch import saved
from plumbline.llm.skew import join_counted

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Sampled fingerprints from which the tree between shards is built, and how many of them a shard gets.
SAMPLE = 1 << 18
SHARD_SAMPLE = 32
#: Distinct fingerprints that a shard should have (each level of the tree copies boundaries, so shards are not small), and
#: above which it is split again.
SHARD_ROWS = 1 << 13
MAX_SHARD_ROWS = 1 << 22
#: Tiles up to this size are compared directly.
TILE = 512
VANTAGES = 12


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as a signed long; 0 for null or a text without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    width = min(SHINGLE, len(words))
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    n = len(stops)
    for k in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : min(k + (1 << 16), n)], stops[k : k + (1 << 16)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """Column form of ``fingerprint``."""
    return each(fingerprint, pa.int64(), texts)


class VantageTree:
    """Nodes as arrays; a child below zero is shard ~child. ``first`` numbers the shards from there on."""

    def __init__(self, points: np.ndarray, leaf: int, radius: int = RADIUS, first: int = 0) -> None:
        self.radius, self.nodes, self.shards = radius, [], first
        todo = [(np.unique(points), -1, 0)]
        self.root = None
        while todo:
            found, parent, side = todo.pop()
            cut = split(found, radius) if len(found) > leaf else None
            if cut is None:
                child, self.shards = ~self.shards, self.shards + 1
            else:
                child = len(self.nodes)
                v, m = cut
                self.nodes.append([v, m, 0, 0])
                d = np.bitwise_count(found ^ v)
                todo += [(found[d <= m], child, 2), (found[d > m - radius], child, 3)]
            if parent < 0:
                self.root = child
            else:
                self.nodes[parent][side] = child

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in points, shards): every shard that each point belongs to."""
        where, shards, todo = [], [], [(self.root, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                where.append(at)
                shards.append(np.full(len(at), ~node))
                continue
            v, m, inner, outer = self.nodes[node]
            d = np.bitwise_count(points[at] ^ v)
            todo += [(inner, at[d <= m]), (outer, at[d > m - self.radius])]
        return (np.concatenate(where), np.concatenate(shards)) if where else (np.zeros(0, int), np.zeros(0, int))


def split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage and radius that leave the fewest pairs to compare; None if no choice saves a tenth."""
    n, best = len(points), None
    for v in points[np.linspace(0, n - 1, min(VANTAGES, n)).astype(int)]:
        upto = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65)).astype(float)
        outside = n - np.concatenate((np.zeros(radius), upto[: 65 - radius]))  # farther than m - radius
        work = upto**2 + outside**2
        work[(upto == n)] = np.inf
        m = int(work.argmin())
        if best is None or work[m] < best[0]:
            best = (work[m], v, m)
    return (best[1], best[2]) if best and best[0] < 0.9 * n * n else None


def near_forest(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Component labels (positions) of distinct points under links at ``radius`` or fewer bits; exact."""
    forest, todo = Forest(len(points)), [np.arange(len(points))]
    while todo:
        at = todo.pop()
        p = points[at]
        cut = split(p, radius) if len(at) > TILE else None
        if cut:
            d = np.bitwise_count(p ^ cut[0])
            todo += [at[d <= cut[1]], at[d > cut[1] - radius]]
            continue
        for k in range(0, len(at), TILE):
            i, j = np.nonzero(np.bitwise_count(p[k : k + TILE, None] ^ p[None, k:]) <= radius)
            keep = i < j
            forest.add(at[k + i[keep]], at[k + j[keep]])
    return forest.labels()


def _route(points: DataFrame, tree: VantageTree) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(tree)  # at most 2 * SAMPLE small nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            at, shard = shared.value.route(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(shard.astype(np.int64))], names=["fp", "shard"])

    return points.select("fp").mapInArrow(run, "fp long, shard long")


def _sample(points: DataFrame, n: int, total: int) -> np.ndarray:
    """About ``n`` of the ``total`` distinct fingerprints, those of least hash; no task gathers more than its share."""
    rows = drawn(points.select("fp"), n, total, F.col("fp")).collect()
    return np.array([r[0] for r in rows], np.int64).view(np.uint64)


def _in_tiles(points: DataFrame, rows: int, first: int) -> tuple[DataFrame, int]:
    """(points as the shards of all pairs of its blocks, numbered from ``first``; the next number) for what no vantage parts."""
    blocks = -(-2 * rows // MAX_SHARD_ROWS)
    own = F.pmod(F.xxhash64("fp", F.lit("block")), F.lit(blocks))
    each = points.select("fp", own.alias("_i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_j"))
    return each.select("fp", (F.lit(first) + F.least("_i", "_j") * blocks + F.greatest("_i", "_j")).alias("shard")), first + blocks * blocks


def near_components(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) for the distinct fingerprints ``fp`` that link with another; exact for any sample.

    The driver gets the sample (about SAMPLE fingerprints) and a count for each shard that is too large.
    """
    n = points.count()
    shards = min(max(n // SHARD_ROWS, 1), SAMPLE // SHARD_SAMPLE)
    tree = VantageTree(_sample(points, shards * SHARD_SAMPLE, n), SHARD_SAMPLE, radius)
    routed, parts, first = saved(_route(points, tree), "simhash-shards"), [], tree.shards
    while large := {r["shard"]: r["count"] for r in routed.groupBy("shard").count().where(F.col("count") > MAX_SHARD_ROWS).collect()}:
        parts.append(routed.where(~F.col("shard").isin(list(large))))
        rest = []
        for shard, rows in large.items():
            own = routed.where(F.col("shard") == shard)
            deeper = VantageTree(_sample(own, SAMPLE, rows), SHARD_SAMPLE, radius, first)
            if deeper.root is not None and deeper.root >= 0:
                first = deeper.shards
                rest.append(_route(own, deeper))
            else:
                tiles, first = _in_tiles(own, rows, first)
                parts.append(tiles)
        if not rest:
            routed = None
            break
        routed = saved(reduce(DataFrame.unionByName, rest), "simhash-shards")
    if routed is not None:
        parts.append(routed)

    def link(table: pa.Table) -> pa.Table:
        fp = np.unique(table.column("fp").to_numpy())
        found = near_forest(fp.view(np.uint64), radius)
        far = np.flatnonzero(found != np.arange(len(fp)))
        return pa.table({"a": fp[far], "b": fp[found[far]]})

    return components(reduce(DataFrame.unionByName, parts).groupBy("shard").applyInArrow(link, "a long, b long"))


def cluster(prints: DataFrame, id_col: str, radius: int = RADIUS) -> DataFrame:
    """(fp, component, _n): for each distinct fingerprint of ``prints`` (id, fp) the least id reachable, and its rows."""
    classes = saved(prints.groupBy("fp").agg(F.min(id_col).alias("_least"), F.count("*").alias("_n")), "simhash-classes")
    linked = saved(near_components(classes, radius).select("node", "root"), "simhash-links")
    roots = linked.join(classes, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("_least").alias("_component"))
    named = linked.join(roots, "root").select("node", "_component")
    return classes.join(named, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("_component", "_least").alias("component"), "_n")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component) for every row of ``docs``: the signed fingerprint and the least id reachable by links.

    Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows share a class. A null id
    is never a component's id unless all its ids are null. An empty table gives none. Other columns are not read.
    """
    prints = saved(docs.select(F.col(id_col), fingerprints(F.col(text)).alias("fp")), "simhash-prints")
    named = saved(cluster(prints, id_col, radius), "simhash-named")
    return join_counted(prints, named, "fp").select(id_col, "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component, the one of least id (of rows with one id, the first as written)."""
    held = saved(docs.withColumns({"_fp": fingerprints(F.col(text)), "_row": F.monotonically_increasing_id()}), "simhash-docs")
    narrow = held.select(F.struct(F.col(id_col).isNull(), F.col(id_col).alias("i"), "_row").alias("_key"), F.col("_fp").alias("fp"))
    first = narrow.groupBy("fp").agg(F.min("_key").alias("_key"))
    named = cluster(first.select("fp", F.col("_key._row").alias("_row"), "_key"), "_key", radius)
    kept = named.groupBy("component").count().select(F.col("component._row").alias("_row"))
    return held.join(kept, "_row", "left_semi").select(*docs.columns)


def op7_query(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
