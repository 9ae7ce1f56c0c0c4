"""Connected components: in numpy within a task, by star contraction between tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import Table

#: Edges that a Forest holds before it contracts them.
HELD_EDGES = 1 << 21


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' component under edges a-b."""
    p = np.arange(n)
    while True:
        ra, rb = p[a], p[b]
        apart = ra != rb
        if not apart.any():
            return p
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(p, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = p[p]
            if (up == p).all():
                break
            p = up


class Forest:
    """Edges among n nodes in memory that follows n, however many edges are added."""

    def __init__(self, n: int) -> None:
        self.n, self.parts, self.held = n, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.held += len(a)
        if self.held > max(HELD_EDGES, 2 * self.n):
            found = self.labels()
            far = np.flatnonzero(found != np.arange(self.n))
            self.parts, self.held = [(far, found[far])], len(far)

    def labels(self) -> np.ndarray:
        if not self.parts:
            return np.arange(self.n)
        return labels(self.n, *(np.concatenate(x) for x in zip(*self.parts, strict=True)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b) of longs; root is the component's least node.

    Alternates two contractions until nothing changes: every node hands its larger neighbours to its least neighbour
    (large star), then its smaller neighbours (small star); a few rounds, logarithmic in the component's size. Each
    round is two partial aggregations and two joins that Spark may split where a node has many neighbours, and is
    written to the shared folder, so lost executors cost one round. No edges give no rows.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct()
    held, seen = Table(e, "edges"), None
    while True:
        now = held.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = held.df.select("u", "v").unionByName(held.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        step = Table(large, "edges-large")
        least = step.df.groupBy("u").agg(F.min("v").alias("m"))
        mins = least.select(F.col("u").alias("w"), "m")
        small = step.df.join(mins, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = Table(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        step.drop()
        held.drop()
        held = following
    nodes = held.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
