"""Near copies: SimHash fingerprints joined by vantage-point trees, then what they cannot show by shared word shingles.

Two texts are linked if their fingerprints differ in 2 bits or fewer, or if the Jaccard similarity of their sets of
5-word shingles is 0.8 or more. Texts with equal sets are one class from the start, and the trees of ``simhash`` give the
components of all links of the first kind. Those of the second kind are mostly farther apart than 2 bits: classes meet
in buckets, one for each band of ROWS least hashes; a pair at exactly 0.8 meets in none of the BANDS with a probability
of 1e-7, and more similar ones with less. Every link of that kind is confirmed on the whole sets.

First every class is compared with its buckets' most central member, the one with the most neighbours in all its buckets:
one pair a row, but for those that the trees have joined. That joins most of a large group. What is left are buckets of
three or more whose classes are not one component. There the classes outside the largest component meet all others in
tiles: blocks of classes whose sets go to one task, where products of incidence matrices give all intersections. Nothing
that grows with a bucket's pairs is ever a row, and no pair of a bucket is left out but those already joined or compared,
and those whose sizes alone keep them below the similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.batches import each
from plumbline.llm.components import Forest, components
from plumbline.llm.scratch import Table, saved
from plumbline.llm.simhash import cluster, fingerprints
from plumbline.llm.skew import HOT_KEYS, join_counted

SHINGLE = 5
SEED = 42
#: Links have a similarity of NUMERATOR / DENOMINATOR or more.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 53, 6
#: Classes and shingles of a block at most (but a block has a class at least), and shingles of a product at once.
BLOCK_CLASSES, BLOCK_SHINGLES, COLUMNS = 256, 1 << 22, 4096
#: Shingles that are hashed BANDS * ROWS times at once.
AT_ONCE = 512
#: Rows of documents that are named to all tasks at most, 8 bytes each; more are met by a shuffle of the texts.
NAMED_ROWS = 1 << 21

_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 2**31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """The set of the text's shingles as sorted 64-bit hashes; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # as fingerprints read them
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends[min(SHINGLE, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)], np.uint64))


def signature(text: str | None) -> np.ndarray:
    """[digest of the set, its size, then a bucket for each band]; an empty set has no buckets."""
    own = shingles(text)
    head = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED), len(own)], np.uint64)
    if not len(own):
        return head.view(np.int64)
    low, high = own.astype(np.uint32), (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_TIMES), 2**32 - 1, np.uint32)
    for k in range(0, len(own), AT_ONCE):  # multiply-shift hashes of both halves
        np.minimum(least, (low[k : k + AT_ONCE, None] * _TIMES + (high[k : k + AT_ONCE, None] ^ _MIX)).min(axis=0), out=least)
    bands = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.concatenate((head, np.array(bands, np.uint64))).view(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def signatures(texts: pa.Array) -> pa.Array:
    """Column form of ``signature``."""
    return each(signature, pa.list_(pa.int64()), texts)


@F.arrow_udf(T.BinaryType())
def sets(texts: pa.Array) -> pa.Array:
    """Column form of ``shingles``, as bytes."""
    return each(lambda t: shingles(t).tobytes(), pa.binary(), texts)


def similar(a: bytes, b: bytes) -> bool:
    """Whether two sets reach the similarity, in whole numbers."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(x) + len(y) - both)


@F.arrow_udf(T.BooleanType())
def linked(a: pa.Array, b: pa.Array) -> pa.Array:
    """Column form of ``similar``."""
    return each(similar, pa.bool_(), a, b)


def _by_row(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``texts`` with ``rows`` (_row), which are written; texts stay where they are if those are few."""
    return texts.join(F.broadcast(rows) if rows.count() <= NAMED_ROWS else rows, "_row", how)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows of ``texts`` (_row, text) that are similar. Sets of rows with many pairs are broadcast."""
    each = saved(pairs.select(F.col("a").alias("_row")).unionByName(pairs.select(F.col("b").alias("_row"))).distinct(), "copies-named")
    made, total = saved(_by_row(texts, each, "left_semi").select("_row", sets("text").alias("_set")), "copies-sets"), pairs.count()
    for side in ("a", "b"):
        # found from counts alone, so that the sets are shuffled once a side
        hot = F.broadcast(pairs.groupBy(side).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT_KEYS >= F.lit(total)).select(side))
        own = made.select(F.col("_row").alias(side), F.col("_set").alias(f"_{side}"))
        few, rest = own.join(hot, side), pairs.join(hot, side, "left_anti")
        pairs = pairs.join(F.broadcast(few), side).unionByName(rest.join(own, side))
    return pairs.where(linked("_a", "_b")).select("a", "b")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairs' intersections, from products of incidence matrices over COLUMNS shared shingles at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, which, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    column = (np.cumsum(shared) - 1)[which]
    kept = shared[which]
    owner, column = owner[kept], column[kept]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, (k, k + COLUMNS))
        found = np.zeros((len(sets), COLUMNS), np.float32)
        found[owner[a:b], column[a:b] - k] = 1
        out += found @ found.T
    return out


def _tile(table: pa.Table) -> pa.Table:
    """Links (a, b) between the tile's classes of different components, as a forest."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("_set").combine_chunks()]
    c, root, block = (table.column(k).to_numpy() for k in ("c", "root", "block"))
    n, both = np.array([len(x) for x in sets], np.float64), overlaps(sets).astype(np.float64)
    near = DENOMINATOR * both >= NUMERATOR * (n[:, None] + n - both)
    near &= root[:, None] != root
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    if low != high:
        near &= block[:, None] != block
    i, j = np.nonzero(np.triu(near, 1))
    _, at = np.unique(root, return_index=True)
    first = at[np.searchsorted(root[at], root)]
    forest = Forest(len(c))
    forest.add(first[i], first[j])
    found = forest.labels()
    far = np.flatnonzero(found != np.arange(len(c)))
    return pa.table({"a": c[far], "b": c[found[far]]})


def _tiles(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of rows (b, c, n, root): those outside a bucket's largest meet all others.

    A bucket of two has been compared already.
    """
    by_root = rows.groupBy("b", "root").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    shape = by_root.groupBy("b").agg(F.max(F.struct("k", "root")).alias("most"), F.sum("k").alias("_n"), F.max("n").alias("longest"), F.count("*").alias("roots"))
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK_CLASSES), F.floor(F.lit(BLOCK_SHINGLES) / F.col("longest"))))
    blocks = lambda k: F.ceil(k / size)
    alone = F.col("_n") <= size
    others = F.when(alone, 1).otherwise(blocks(F.col("_n") - F.col("most.k")))
    inner = F.when(alone, 0).otherwise(blocks(F.col("most.k")))
    shape = shape.where("roots > 1 AND _n > 2").select("b", "_n", F.col("most.root").alias("_main"), others.cast("long").alias("_others"), inner.cast("long").alias("_inner"))
    placed = saved(join_counted(rows, shape, "b"), "copies-placed")
    h, inside = F.xxhash64("c"), (F.col("root") == F.col("_main")) & (F.col("_inner") > 0)
    placed = placed.withColumn("block", F.when(inside, F.col("_others") + F.pmod(h, F.col("_inner"))).otherwise(F.pmod(h, F.col("_others"))))
    last = F.when(inside, F.col("_others")).otherwise(F.col("_others") + F.col("_inner")) - 1
    spread = placed.select("b", "c", "root", "block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_with"))
    spread = spread.select("b", "c", "root", "block", F.least("block", "_with").alias("low"), F.greatest("block", "_with").alias("high"))
    each = saved(placed.select(F.col("c").alias("_row")).distinct(), "copies-named")
    made = saved(_by_row(texts, each, "left_semi").select(F.col("_row").alias("c"), sets("text").alias("_set")), "copies-tiles")
    return spread.join(made, "c").groupBy("b", "low", "high").applyInArrow(_tile, "a long, b long")


def links(classes: DataFrame, texts: DataFrame, near: DataFrame) -> DataFrame:
    """(node, root) for the classes (_row, n, bands) that link with another; root is the component's least row.

    ``near`` has the links (a, b) that are known from fingerprints.
    """
    every = Table(classes.select(F.explode("bands").alias("b"), F.col("_row").alias("c"), "n"), "copies-buckets")
    size = every.df.groupBy("b").agg(F.count("*").alias("size")).where("size > 1")
    # a class is in a bucket of each band, so no bucket has more than one row in BANDS
    rows = Table(every.df.join(size, "b"), "copies-shared")
    every.drop()
    named = components(near).withColumnRenamed("node", "c")
    central = rows.df.groupBy("c").agg(F.sum("size").alias("w")).join(named, "c", "left").select("c", "w", F.coalesce("root", "c").alias("root"))
    met = rows.df.join(central, "c")
    lead = met.groupBy("b").agg(F.max(F.struct("w", "c", "n", "root")).alias("lead"), F.count("*").alias("_n"))
    met = join_counted(met.select("b", "c", "n", "root"), lead, "b").where(F.col("root") != F.col("lead.root"))
    met = met.where(DENOMINATOR * F.least("n", "lead.n") >= NUMERATOR * F.greatest("n", "lead.n"))
    pairs = Table(met.select(F.least("c", "lead.c").alias("a"), F.greatest("c", "lead.c").alias("b")).distinct(), "copies-pairs")
    edges = saved(_confirmed(pairs.df, texts).unionByName(near), "copies-edges")
    pairs.drop()
    found = components(edges)
    n = rows.df.groupBy("c").agg(F.count("*").alias("_n"))
    named = n.join(found, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"))
    split = Table(rows.df.drop("size").join(named, "c"), "copies-split")
    more = saved(_tiles(split.df, texts), "copies-edges")
    split.drop()
    rows.drop()
    return found if more.isEmpty() else components(edges.unionByName(more))


def _near(prints: DataFrame) -> DataFrame:
    """Links (a, b) of the classes in ``prints`` (c, fp), from the components of their fingerprints."""
    named = saved(cluster(prints, "c"), "copies-prints")
    found = join_counted(prints, named, "fp").where("c <> component")
    return saved(found.select(F.col("component").alias("a"), F.col("c").alias("b")).distinct(), "copies-near")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of links, the one of least id (of rows with one id, the first as written)."""
    held = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "copies-docs")
    key = F.struct(F.col(id_col).isNull(), F.col(id_col).alias("i"), "_row").alias("_key")
    signed = Table(held.select("_row", key, signatures(F.col(text)).alias("_s"), fingerprints(F.col(text)).alias("fp")), "copies-signatures")
    own = signed.df.select(F.col("_s")[0].alias("_set"), "_key", "fp")
    firsts = Table(own.groupBy("_set").agg(F.min("_key").alias("_key")).select("_set", "_key", F.col("_key._row").alias("_row")), "copies-classes")
    # texts with one set may have several fingerprints; all of them take part
    near = _near(saved(own.select("_set", "fp").distinct().join(firsts.df, "_set").select(F.col("_row").alias("c"), "fp"), "copies-fingerprints"))
    classes = signed.df.join(firsts.df.select("_row"), "_row", "left_semi").select("_row", F.col("_s")[1].alias("n"), F.slice("_s", 3, BANDS).alias("bands"))
    found = links(classes, held.select("_row", F.col(text).alias("text")), near)
    named = firsts.df.join(found, F.col("_row") == F.col("node"), "left").select("_key", F.coalesce("root", "_row").alias("_root"))
    kept = named.groupBy("_root").agg(F.min("_key").alias("_key")).select(F.col("_key._row").alias("_row"))
    dropped = saved(signed.df.select("_row").join(kept, "_row", "left_anti"), "copies-dropped")
    signed.drop()
    firsts.drop()
    return _by_row(held, dropped, "left_anti").select(*docs.columns)
