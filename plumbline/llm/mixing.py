"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled (hash) order, repeated for up to three epochs. A copy's virtual
finish time is the source's cumulative tokens up to and with it, over the source's target. All copies together,
range-sorted by finish time, are taken until the total budget is reached.

Nothing gathers a source in one task: cumulative sums are taken within (source, hash bucket) groups, and the buckets'
offsets come from a table of sums with 4096 rows a source. The global cut is found by range refinement: a pass sums
tokens in 1024 ranges of finish times, and only the range in which the budget falls is cut finer, until it holds one
finish time. The driver sees 1024 sums a pass, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.scratch import saved
from plumbline.llm.words import n_words

#: A document is taken three times at most, and so a target is three times its source's size at most.
EPOCHS = 3
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
RANGES = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with target: the total shared by weight, none above EPOCHS times its source's size.

    Water filling in closed form: with sources sorted by cap over weight, the level at k is the total less the caps
    before k, over the weights from k on; sources stop at their cap while the level is above it. The level rises while
    it is above a source's cap and falls from then on, so the first level within reach is the largest. The windows
    hold one row a source in one task: the table grows with the number of sources, not of documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("_ratio", F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    picks = F.array(*[F.lit(w).cast("long") for w in weights])
    found = (
        sizes.withColumn("_w", F.get(picks, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
        .withColumn("_cap", F.col("source_size") * EPOCHS)
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_w"))
        .withColumn("_before", F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_weights", F.sum("_w").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(whole))
        .withColumn("_level", (F.col("_total") - F.coalesce("_before", F.lit(0))).cast("double") / F.col("_weights"))
        .withColumn("_final", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(whole))
    )
    capped = F.col("_final").isNull() | (F.col("_ratio") < F.col("_final"))
    return found.select("source", "source_size", F.when(capped, F.col("_cap").cast("double")).otherwise(F.col("_w") * F.col("_final")).alias("target"))


def _cut(timed: DataFrame, budget: int) -> float | None:
    """The largest finish time up to which all copies together stay within the budget; None if there is none."""
    copies = timed.where("size > 0 AND target > 0").select("size", F.explode(F.array(*[f"_f{e}" for e in range(EPOCHS)])).alias("f"))
    low, high = copies.agg(F.min("f"), F.max("f")).first()
    taken, cut = 0, None
    while low is not None:
        inside = copies.where(F.col("f").between(F.lit(low), F.lit(high)))
        span = high - low
        at: Column = F.floor((F.col("f") - F.lit(low)) / F.lit(span) * F.lit(float(RANGES - 1))) if span > 0 else F.lit(0)
        sums = sorted(inside.groupBy(at.alias("k")).agg(F.sum("size").alias("s"), F.min("f").alias("lo"), F.max("f").alias("hi")).collect())
        low = None
        for _, s, lo, hi in sums:
            if taken + s <= budget:
                taken, cut = taken + s, hi
                continue
            if lo < hi:
                low, high = lo, hi
            break
    return cut


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, copies, *carry) for every row of ``docs`` (doc_id, source, text).

    Sizes are words; a null text has none and is never taken. A null source is a source of its own, ordered last;
    sources without words get target 0. Documents shuffle by md5 of seed and id, ties by id and size, so reruns agree;
    rows equal in all three are alike. Copies with equal finish times are all in or all out. An empty table gives none.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    narrow = saved(docs.select("doc_id", "source", *carry, n_words(F.col(text)).alias("size"), hashed.alias("_h"), F.substring(hashed, 1, 3).alias("_b")), "mix-sizes")
    buckets = narrow.groupBy("source", "_b").agg(F.sum("size").alias("_bucket_size"))
    sources = targets(buckets.groupBy("source").agg(F.sum("_bucket_size").alias("source_size")), weights)
    upto = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select("source", "_b", F.coalesce(F.sum("_bucket_size").over(upto), F.lit(0)).alias("_offset")).alias("o")
    offsets = offsets.join(sources.alias("s"), F.expr("o.source <=> s.source")).selectExpr("o.source AS _source", "o._b AS _bucket", "_offset", "source_size", "target")
    within = W.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    run = narrow.withColumn("_cum", F.sum("size").over(within))
    timed = run.join(offsets, F.expr("source <=> _source AND _b = _bucket"))
    finish = {f"_f{e}": F.expr(f"try_divide(CAST({e} * source_size + _offset + _cum AS DOUBLE), target)") for e in range(EPOCHS)}
    timed = saved(timed.withColumns(finish).select("doc_id", "source", "size", "source_size", "target", *carry, *finish), "mix-times")
    budget = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = _cut(timed, budget)
    copies = sum((F.when(F.col(k) <= F.lit(cut), 1).otherwise(0) for k in finish), F.lit(0)) if cut is not None else F.lit(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("long")
    return timed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop(*finish)


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 42) -> DataFrame:
    """``docs`` with every row as often as the mix takes it; rows that it doesn't take are gone.

    Rows are numbered where they are written, so repeated rows and null ids are told apart without grouping them.
    """
    held = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-docs")
    taken = mix(held.select("doc_id", "source", "text", "_row"), weights=weights, seed=seed, carry=("_row",)).where("copies > 0").select("_row", "copies")
    out = held.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*docs.columns)


def op9_query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH n AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(concat_ws('|', '42', doc_id::VARCHAR)) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM n GROUP BY source),
w AS (SELECT *, ([1, 2, 3])[((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1]::BIGINT AS w, 3 * source_size AS cap FROM s),
x AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
y AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM x),
z AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS final FROM y),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR ratio < final THEN cap::DOUBLE ELSE w * final END AS target FROM z),
c AS (SELECT n.*, t.source_size, t.target, (sum(size) OVER (PARTITION BY n.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT AS cum
    FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source),
f AS (SELECT size, (e * source_size + cum)::DOUBLE / target AS f FROM c, (VALUES (0), (1), (2)) AS v(e) WHERE size > 0 AND target > 0),
g AS (SELECT f, sum(size) OVER (ORDER BY f) AS upto FROM f),
cut AS (SELECT max(f) AS f FROM g WHERE upto <= (SELECT sum(size) FROM n))
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN size * (SELECT count(*) FROM (VALUES (0), (1), (2)) AS v(e)
    WHERE (e * source_size + cum)::DOUBLE / target <= cut.f) ELSE 0 END::BIGINT AS taken
FROM c, cut
"""
