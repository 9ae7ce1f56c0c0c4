"""Exact paired tests, multiplicity, and the cluster bootstrap."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import selective

SEED = 20260904
DRAWS = 2000
#: Standard deviations beyond which a binomial's probabilities are not summed.
REACH = 12
#: Steps of a search over the counts of a binomial: those of a long.
HALVINGS = 63


def log_factorial(n: Column) -> Column:
    """ln n! of whole numbers: exact up to 20, then Stirling's series of ln gamma at n + 1, good to 1e-15 there."""
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _excess(n: str) -> str:
    """What ln n! has beyond (n + 1/2) ln n - n + ln(2 pi) / 2, for n > 0."""
    x = f"double({n})"
    small = f"ln(double(factorial(int({n})))) - (({x} + 0.5) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)}D)"
    return f"(CASE WHEN {n} <= 20 THEN {small} ELSE (1 / 12D - (1 / 360D - (1 / 1260D - 1 / 1680D / ({x} * {x})) / ({x} * {x})) / ({x} * {x})) / {x} END)"


def _deviance(x: str, mean: str) -> str:
    """x ln(x / mean) + mean - x, without cancellation where x is near the mean."""
    v, series = f"(({x} - {mean}) / ({x} + {mean}))", "0D"
    for j in range(9, 0, -1):
        series = f"{v} * {v} * (1 / {2 * j + 1}D + {series})"
    return f"(CASE WHEN abs({v}) < 0.1 THEN ({x} - {mean}) * {v} + 2 * {x} * {v} * {series} ELSE {x} * ln({x} / {mean}) + {mean} - {x} END)"


def log_binomial(k: str, n: str, p: float) -> str:
    """ln P(X = k) in SQL for k in 0..n, by saddle point: differences of small numbers, so it is as good for any n."""
    x, m, rest, q = f"double({k})", f"double({n})", f"double({n} - {k})", repr(1 - p)
    inner = f"{_excess(n)} - {_excess(k)} - {_excess(f'({n} - {k})')} - {_deviance(x, f'({m} * {p!r}D)')} - {_deviance(rest, f'({m} * {q}D)')} + 0.5 * ln({m} / ({2 * math.pi!r}D * {x} * {rest}))"
    return f"(CASE WHEN {k} <= 0 THEN {m} * {math.log1p(-p)!r}D WHEN {k} >= {n} THEN {m} * {math.log(p)!r}D ELSE {inner} END)"


def _first(low: str, high: str, holds) -> Column:
    """The least whole number above ``low`` at which the SQL ``holds``, if it holds from there up to ``high``; by halving."""
    at = "(s.low + (s.high - s.low) DIV 2)"
    step = f"CASE WHEN s.high - s.low <= 1 THEN s WHEN {holds(at)} THEN named_struct('low', s.low, 'high', {at}) ELSE named_struct('low', {at}, 'high', s.high) END"
    return F.expr(f"aggregate(sequence(1, {HALVINGS}), named_struct('low', bigint({low}), 'high', bigint({high})), (s, i) -> {step}).high")


def two_sided_p(df: DataFrame, k: str, n: str, p: float = 0.5) -> DataFrame:
    """``df`` with p_value: exact binomial, the sum of probabilities not above that of k (tolerance 1e-9); 1 for n = 0.

    Those counts are two tails: they end where halving finds the probability of k below and above the mode. Each tail is
    summed from its end outwards, over REACH standard deviations at most, beyond which less than 1e-30 of it is left.
    So the work follows the standard deviation of n, wherever k is, and is less the farther out the tail begins.
    """
    cases = df.select(F.col(k).cast("long").alias("_k"), F.col(n).cast("long").alias("_n")).distinct()
    size, logs = F.col("_n"), lambda j: log_binomial(j, "_n", p)
    cases = cases.withColumns({"_mode": F.least(size, F.floor((size + 1) * F.lit(p)).cast("long")), "_own": F.expr(logs("_k")) + 1e-9})
    # below the mode probabilities rise, so the first count that is too likely ends the lower tail
    ends = {"_low": _first("-1", "_mode + 1", lambda j: f"{logs(j)} > _own") - 1, "_high": _first("_mode", "_n + 1", lambda j: f"{logs(j)} <= _own")}
    cases = cases.withColumns(ends)
    reach = (F.ceil(F.sqrt(size * (p * (1 - p))) * REACH) + REACH * REACH).cast("long")
    # from k outwards each probability is at most this share of the one before
    down = F.try_divide(F.col("_low") * (1 - p), (size - F.col("_low") + 1) * p)
    up = F.try_divide((size - F.col("_high")) * p, (F.col("_high") + 1) * (1 - p))
    terms = lambda r: F.when(r > 0, F.least(reach, F.ceil(F.try_divide(F.lit(-70.0), F.log(r))).cast("long"))).otherwise(F.lit(0).cast("long"))
    whole = F.col("_low") >= F.col("_mode")
    lower = F.when(~whole & (F.col("_low") >= 0), F.sequence(F.greatest(F.lit(0).cast("long"), F.col("_low") - terms(down)), F.col("_low")))
    upper = F.when(~whole & (F.col("_high") <= size), F.sequence(F.col("_high"), F.least(size, F.col("_high") + terms(up))))
    empty = F.array().cast("array<long>")
    each = cases.select("_k", "_n", whole.alias("_whole"), F.explode_outer(F.concat(F.coalesce(lower, empty), F.coalesce(upper, empty))).alias("_j"))
    sums = each.groupBy("_k", "_n").agg(F.when(F.bool_or("_whole"), 1.0).otherwise(F.least(F.coalesce(F.sum(F.exp(F.expr(logs("_j")))), F.lit(0.0)), F.lit(1.0))).alias("p_value"))
    return df.join(sums, (F.col(k) == F.col("_k")) & (F.col(n) == F.col("_n")), "left").drop("_k", "_n")


def discordance(scores: DataFrame, repeat: int | None = 0) -> DataFrame:
    """(arm_a, arm_b, both_right, a_only, b_only, neither, n) of factual items that both arms have, for a < b.

    Items meet in one aggregation by item; arms, which are few, are paired within the item's row. Without a repeat all
    repeats are taken, each for itself, and named in a column.
    """
    by = ["repeat"] if repeat is None else []
    one = scores.where("item_type = 'factual'") if repeat is None else scores.where((F.col("repeat") == repeat) & (F.col("item_type") == "factual"))
    rows = one.groupBy("item_id", *by).agg(F.sort_array(F.collect_list(F.struct("arm", "correct"))).alias("_a"))
    pairs = rows.select(*by, F.posexplode("_a").alias("_i", "_x"), "_a").select(*by, "_x", F.explode(F.expr("slice(_a, _i + 2, size(_a))")).alias("_y"))
    x, y = F.col("_x.correct"), F.col("_y.correct")
    return pairs.groupBy(*by, F.col("_x.arm").alias("arm_a"), F.col("_y.arm").alias("arm_b")).agg(
        F.count_if(x & y).alias("both_right"), F.count_if(x & ~y).alias("a_only"), F.count_if(~x & y).alias("b_only"), F.count_if(~x & ~y).alias("neither"), F.count("*").alias("n"),
    )


def mcnemar(scores: DataFrame, repeat: int | None = 0) -> DataFrame:
    """``discordance`` with the exact p of the discordant items."""
    table = discordance(scores, repeat).withColumns({"_least": F.least("a_only", "b_only"), "_total": F.col("a_only") + F.col("b_only")})
    return two_sided_p(table, "_least", "_total").drop("_least", "_total")


def sensitivity(scores: DataFrame) -> DataFrame:
    """(arm_a, arm_b, n_repeats, p_first, p_min, p_max): how a pair's exact p moves over the repeats that both arms have."""
    p = mcnemar(scores, None)
    return p.groupBy("arm_a", "arm_b").agg(F.count("*").alias("n_repeats"), F.max(F.when(F.col("repeat") == 0, F.col("p_value"))).alias("p_first"), F.min("p_value").alias("p_min"), F.max("p_value").alias("p_max"))


def holm(df: DataFrame, p: str = "p_value", *ties: str) -> DataFrame:
    """``df`` with p_holm: (m - rank) p in rising order, made monotone, at most 1. One row a test."""
    order, whole = W.orderBy(p, *ties), W.partitionBy()
    step = (F.count("*").over(whole) - F.row_number().over(order) + 1) * F.col(p)
    return df.withColumn("_s", F.least(step, F.lit(1.0))).withColumn("p_holm", F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def _poisson_steps() -> list[str]:
    """Hex words of 32 bits at which a Poisson number of mean 1 steps up, as a uniform word reads them."""
    steps, below = [], 0.0
    for k in range(12):
        below += math.exp(-1) / math.factorial(k)
        steps.append(f"{math.ceil(below * 2**32):08x}")
    return steps


#: A word below the first step weighs 0, below the second 1, and so on.
STEPS = _poisson_steps()
#: Replicates that one digest weighs (it has as many words), and parts of the replicates, which are dealt out apart.
WORDS, PARTS = 4, 4
#: Clusters whose weights a worker holds at a time, and groups whose sums it holds before it passes them on.
CLUSTERS_AT_ONCE, GROUPS_HELD = 512, 512


def weights(clusters: list[str | None], n_draws: int = DRAWS, seed: int = SEED) -> np.ndarray:
    """(clusters, 1 + n_draws): one for the cells as they are, then how often each replicate takes each cluster.

    The same numbers as ``resampled``: a null cluster is left out of what is digested, as ``concat_ws`` does.
    """
    heads = [f"{seed}|{four}".encode() for four in range(-(-n_draws // WORDS))]
    steps = np.array([int(x, 16) for x in STEPS], np.int64)
    out = np.ones((len(clusters), 1 + n_draws))
    for row, name in zip(out, clusters, strict=True):
        tail = b"" if name is None else b"|" + name.encode()
        words = np.frombuffer(b"".join([md5(head + tail).digest() for head in heads]), ">u4")
        row[1:] = np.searchsorted(steps, words[:n_draws].astype(np.int64), side="right")
    return out


def replicates(cells: DataFrame, cluster: str, by: list[str], sums: list[str], n_draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, _rep, sums double): the sums over cells of each group in each replicate that draws any of it; -1 has the cells as they are.

    The cells of a cluster lie together, so its digests are taken once for all groups, and a task sums a group's cells
    by one product with their weights: what is shuffled is a row a group and replicate, not one a cell and replicate. A
    sum that is null counts as zero.
    """
    if not by:
        return replicates(cells.withColumn("_one", F.lit(1)), cluster, ["_one"], sums, n_draws, seed).drop("_one")
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.select(*by, F.col(cluster).cast("string").alias("_name"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums)).repartition(n, "_name").sortWithinPartitions("_name")
    kept = [dealt.schema[c] for c in by]
    schema = T.StructType([*kept, T.StructField("_rep", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in sums)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def passed() -> pa.RecordBatch:
            drawn = [np.flatnonzero(x[-1]) for x in held.values()]
            group = pa.array(np.repeat(np.arange(len(held)), [len(x) for x in drawn]))
            found = np.concatenate([x[:-1, at] for x, at in zip(held.values(), drawn, strict=True)], axis=1)
            keys = [pa.array(k, t).take(group) for k, t in zip(zip(*held, strict=True), types, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([*keys, pa.array((np.concatenate(drawn) - 1).astype(np.int32)), *map(pa.array, found)], names=schema.names)

        for b in batches:
            types = b.schema.types[: len(by)]
            code = b.column(len(by)).dictionary_encode(null_encoding="encode")
            at, names = code.indices.to_numpy(), code.dictionary.to_pylist()
            values = np.stack([*(b.column(i).to_numpy() for i in range(len(by) + 1, b.num_columns)), np.ones(b.num_rows)])
            for low in range(0, len(names), CLUSTERS_AT_ONCE):
                times = weights(names[low : low + CLUSTERS_AT_ONCE], n_draws, seed)
                rows = np.flatnonzero((at >= low) & (at < low + CLUSTERS_AT_ONCE))
                groups = pa.Table.from_batches([b.select(by)]).take(rows).append_column("_row", pa.array(rows)).group_by(by, use_threads=False).aggregate([("_row", "list")])
                for key, mine in zip(zip(*(groups[c].to_pylist() for c in by), strict=True), groups["_row_list"], strict=True):
                    mine = mine.values.to_numpy()
                    found = values[:, mine] @ times[at[mine] - low]
                    held[key] = held[key] + found if key in held else found
                    if len(held) >= GROUPS_HELD:
                        yield passed()
        if held:
            yield passed()

    drawn = dealt.mapInArrow(run, schema)
    return drawn.groupBy(*by, "_rep").agg(*(F.sum(c).alias(c) for c in sums))


def resampled(cells: DataFrame, cluster: str, n_draws: int = DRAWS, seed: int = SEED, shared: bool = False) -> DataFrame:
    """``cells`` with _rep and _times: once as they are (replicate -1), and once for each replicate that draws their cluster.

    A replicate takes each cluster a Poisson number of times of mean 1, read off a digest of seed, replicate and cluster:
    the resampling of a fixed number of clusters without the condition on that number, which ratios of sums do not
    depend on (their spread differs by a share of 1 / (2 clusters)). So clusters are not numbered, a cluster has the same
    weight in all groups and cells, and every engine draws the same. Where clusters have many cells each (``shared``),
    a cluster's digests are taken once and joined to its cells; else each cell takes its own, without a join.
    """
    spark = cells.sparkSession
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # few cells would be expanded in one task: their replicates are dealt out first
    if not shared:
        dealt = cells.withColumn("_part", parts)
        return _drawn(dealt.repartition(n, F.xxhash64(*dealt.columns)), cluster, cells.columns, n_draws, seed)
    named = cells.withColumn("_key", F.to_json(F.struct(F.col(cluster).alias("c"))))  # a null cluster is one, too
    dealt = named.withColumn("_part", parts).repartition(n, "_key", "_part")
    names = named.select(cluster, "_key").distinct().withColumn("_part", parts).repartition(n, "_key", "_part")
    return dealt.join(_drawn(names, cluster, ["_key", "_part"], n_draws, seed).hint("shuffle_hash"), ["_key", "_part"]).select(*cells.columns, "_rep", "_times")


def _drawn(dealt: DataFrame, cluster: str, columns: list[str], n_draws: int, seed: int) -> DataFrame:
    """``columns`` of rows of (cluster, _part) with the replicates of their part and how often those take the cluster."""
    word = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_four").cast("string"), F.col(cluster).cast("string")))
    each = -(-(-(-n_draws // WORDS) + 1) // PARTS)  # -1 stands before the fours
    four = F.explode(F.sequence(F.col("_part") * each - 1, F.col("_part") * each + each - 2))
    rows = dealt.withColumn("_four", four).withColumn("_word", F.when(F.col("_four") >= 0, word))

    def times(i: int) -> str:
        part = f"substring(_word, {1 + 8 * i}, 8)"
        return "CASE " + " ".join(f"WHEN {part} < '{x}' THEN {k}" for k, x in enumerate(STEPS)) + f" ELSE {len(STEPS)} END"

    # the first digest's place is taken by the cells as they are
    picks = ", ".join(f"struct(IF(_four < 0, {-1 if i == 0 else n_draws}, _four * {WORDS} + {i}) AS _rep, IF(_four < 0, 1, {times(i)}) AS _times)" for i in range(WORDS))
    return rows.select(*columns, F.expr(f"inline(array({picks}))")).where((F.col("_times") > 0) & (F.col("_rep") < n_draws))


def intervals(stats: DataFrame, by: list[str], measures: list[str], carry: tuple[str, ...] = (), level: float = 0.95) -> DataFrame:
    """(by, measure, estimate, ci_low, ci_high, carry) from a row of measures a replicate; -1 gives the estimate.

    Ends are linear percentiles over the replicates; null replicates are left out.
    """
    tail = (1 - level) / 2
    ends = lambda m: F.percentile(F.when(F.col("_rep") >= 0, F.col(m)), F.array(F.lit(tail), F.lit(1 - tail)))
    own = lambda m: F.max(F.when(F.col("_rep") == -1, F.col(m)))
    wide = stats.groupBy(*by).agg(*(own(m).alias(f"_o_{m}") for m in (*measures, *carry)), *(ends(m).alias(f"_e_{m}") for m in measures))
    long = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"_o_{m}").alias("estimate"), F.col(f"_e_{m}")[0].alias("ci_low"), F.col(f"_e_{m}")[1].alias("ci_high")) for m in measures)))
    return wide.select(*by, long, *(F.col(f"_o_{c}").alias(c) for c in carry))


def bootstrap(rows: DataFrame, by: list[str], cluster: str, sums: dict[str, Column], statistics: dict[str, Column], keys: tuple[str, ...] = (), n_draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, measure, estimate, ci_low, ci_high, n_clusters) of any statistics of sums, resampling whole clusters.

    ``sums`` names sums over rows, apart for each value of ``keys`` (bins, say); each of ``statistics`` aggregates them
    over the keys. All are taken from one set of draws: rows become one row of sums a cluster (and key), a replicate
    weighs those, and its statistics are one row.
    """
    cells = rows.groupBy(*by, cluster, *keys).agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    # a cluster's first cell counts it, so the clusters are summed with the rest
    first = F.row_number().over(W.partitionBy(*by, cluster).orderBy(*keys)) == 1 if keys else F.lit(True)
    cells = cells.withColumn("_clusters", first.cast("long"))
    per = replicates(cells, cluster, [*by, *keys], [*sums, "_clusters"], n_draws, seed)
    stats = per.groupBy(*by, "_rep").agg(*(c.alias(k) for k, c in statistics.items()), F.sum("_clusters").cast("long").alias("n_clusters"))
    return intervals(stats, by, list(statistics), ("n_clusters",))


def means(values: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """(sums, statistics) for ``bootstrap`` of the mean of each value, over the rows in which it is not null."""
    sums = {f"_s_{k}": v.cast("double") for k, v in values.items()} | {f"_c_{k}": F.when(v.isNotNull(), 1) for k, v in values.items()}
    return sums, {k: F.try_divide(F.sum(f"_s_{k}"), F.sum(f"_c_{k}")) for k in values}


def bootstrap_mean(rows: DataFrame, by: list[str], cluster: str, value: Column, n_draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, estimate, ci_low, ci_high, n_clusters) of the mean of ``value``, resampling whole clusters."""
    return bootstrap(rows, by, cluster, *means({"mean": value}), n_draws=n_draws, seed=seed).drop("measure")


def bootstrap_ece(df: DataFrame, by: str = "arm", cluster: str = "family", bins: int = 10, n_draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """The expected calibration error with its interval; bins as in ``selective.reliability``."""
    rows = selective.confident(selective.guard_confidence(df)).withColumn("_bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)))
    sums = {"_m": F.lit(1), "_s": F.col("confidence"), "_h": F.col("correct").cast("int")}
    gap = F.sum(F.abs(F.col("_s") - F.col("_h"))) / F.sum("_m")
    return bootstrap(rows, [by], cluster, sums, {"ece": gap}, ("_bin",), n_draws, seed).drop("measure")


def bootstrap_selective(df: DataFrame, by: str = "arm", cluster: str = "family", targets: tuple[float, ...] = selective.TARGETS, n_draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, measure, estimate, ci_low, ci_high) of aurc, e_aurc and accuracy_at_<percent> for each coverage target.

    A replicate is a weighting of (cluster, confidence) cells, summed to tie groups and ordered from the highest
    confidence down; all measures are read off one pass over its groups. A replicate without rows has none and is left
    out. Rows without a confidence, and groups without any with one, have no part.
    """
    cells = selective.confident(df).groupBy(by, cluster, "confidence").agg(F.count("*").alias("_m"), F.count_if("correct").alias("_h"))
    drawn = replicates(cells, cluster, [by, "confidence"], ["_m", "_h"], n_draws, seed)
    ties = drawn.select(by, "_rep", "confidence", F.col("_m").cast("long").alias("size"), F.col("_h").cast("long").alias("hits"))
    whole = W.partitionBy(by, "_rep")
    above = whole.orderBy(F.desc("confidence")).rowsBetween(W.unboundedPreceding, -1)
    ties = ties.withColumns({"before_n": F.coalesce(F.sum("size").over(above), F.lit(0)), "before_hits": F.coalesce(F.sum("hits").over(above), F.lit(0)), "_all": F.sum("size").over(whole)})
    upto, good = F.col("before_n") + F.col("size"), F.col("before_hits") + F.col("hits")
    reached = lambda t: F.min_by(F.when(upto / F.col("_all") >= t - 1e-12, good / upto), F.when(upto / F.col("_all") >= t - 1e-12, upto))
    names = [f"accuracy_at_{round(100 * t)}" for t in targets]
    rep = ties.groupBy(by, "_rep").agg(F.sum(selective.area_part()).alias("_area"), F.sum("size").alias("_n"), F.sum("hits").alias("_hits"), *(reached(t).alias(m) for m, t in zip(names, targets, strict=True)))
    area = F.col("_area") / F.col("_n")
    stats = rep.select(by, "_rep", area.alias("aurc"), (area - selective.least_area(F.col("_n"), F.col("_hits"))).alias("e_aurc"), *names)
    return intervals(stats, [by], ["aurc", "e_aurc", *names])


def bootstrap_aurc(df: DataFrame, by: str = "arm", cluster: str = "family", n_draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(by, ci_low, ci_high) of the area under the risk-coverage curve, resampling clusters."""
    return bootstrap_selective(df, by, cluster, (), n_draws, seed).where("measure = 'aurc'").select(by, "ci_low", "ci_high")


def summarize_selective(df: DataFrame, by: str = "arm", cluster: str = "family", targets: tuple[float, ...] = selective.TARGETS, n_draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """One row a group: what answering the most confident first gives, with intervals.

    (by, n_items, n_with_confidence, n_distinct_confidences, accuracy_full_coverage, aurc, aurc_ci_low, aurc_ci_high,
    aurc_random, aurc_optimal, e_aurc with its interval, and for each target accuracy, achieved coverage and interval).
    A group without any confidence keeps its row; its measures are null.
    """
    names = [f"accuracy_at_{round(100 * t)}" for t in targets]
    counts = df.groupBy(by).agg(
        F.count("*").alias("n_items"), F.count(F.nanvl("confidence", F.lit(None).cast("double"))).alias("n_with_confidence"),
        F.count_distinct(F.nanvl("confidence", F.lit(None).cast("double"))).alias("n_distinct_confidences"), F.avg(F.col("correct").cast("double")).alias("accuracy_full_coverage"),
    )
    areas = selective.aurc(df, by).drop("n")
    points = selective.at_coverage(df, targets, by)
    at = lambda c, t: F.max(F.when(F.abs(F.col("target") - t) < 1e-9, F.col(c)))
    wide = points.groupBy(by).agg(*(at("selective_accuracy", t).alias(m) for m, t in zip(names, targets, strict=True)), *(at("coverage", t).alias(f"coverage_at_{m[12:]}") for m, t in zip(names, targets, strict=True)))
    ends = bootstrap_selective(df, by, cluster, targets, n_draws, seed)
    pick = lambda m, e: F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}")
    ends = ends.groupBy(by).agg(*(pick(m, e) for m in ("aurc", "e_aurc", *names) for e in ("ci_low", "ci_high")))
    return counts.join(areas, by, "left").join(wide, by, "left").join(ends, by, "left")


def compare_arms(scores: DataFrame, alpha: float = 0.05, repeat: int = 0, n_draws: int = DRAWS, seed: int = SEED, unequal: str = "raise") -> DataFrame:
    """(arm_a, arm_b, n, difference, ci_low, ci_high, a_only, b_only, p_value, p_holm, significant) for every a < b.

    Arms must have answered the same factual items in the repeat. Where they have not, reading the result raises with
    some of the missing items before anything is compared; ``unequal="pair"`` compares each pair on the items it shares.
    """
    if unequal not in ("raise", "pair"):
        raise ValueError(f"unequal item sets can raise or pair, not {unequal!r}")
    one = scores.where((F.col("repeat") == repeat) & (F.col("item_type") == "factual"))
    one = same_items_or_raise(one) if unequal == "raise" else one
    rows = one.groupBy("item_id", "family").agg(F.sort_array(F.collect_list(F.struct("arm", "correct"))).alias("_a"))
    pairs = rows.select("family", F.posexplode("_a").alias("_i", "_x"), "_a").select("family", "_x", F.explode(F.expr("slice(_a, _i + 2, size(_a))")).alias("_y"))
    gap = pairs.select("family", F.col("_x.arm").alias("arm_a"), F.col("_y.arm").alias("arm_b"), (F.col("_x.correct").cast("int") - F.col("_y.correct").cast("int")).alias("_d"))
    by = ["arm_a", "arm_b"]
    ends = bootstrap_mean(gap, by, "family", F.col("_d"), n_draws, seed).withColumnRenamed("estimate", "difference").drop("n_clusters")
    tests = holm(mcnemar(one, repeat), "p_value", "arm_a", "arm_b").select(*by, "n", "a_only", "b_only", "p_value", "p_holm")
    return tests.join(ends, by).withColumn("significant", F.col("p_holm") < alpha)


#: Missing items that an error names, for each arm.
NAMED = 5


def same_items_or_raise(rows: DataFrame, item: str = "item_id") -> DataFrame:
    """``rows``, if every arm in them has the same items; reading them raises with some items that arms lack otherwise.

    The audit is part of the plan: each item's arms are counted against all arms, what is missing is summed to one row
    (a few items an arm), and the rows meet that row before anything else is done with them.
    """
    arms = rows.select("arm").distinct().agg(F.sort_array(F.collect_list("arm")).alias("_arms"))  # arms are few
    have = rows.groupBy(item).agg(F.collect_set("arm").alias("_have"))
    lacks = have.join(F.broadcast(arms)).select(F.col(item).cast("string").alias("_item"), F.explode(F.array_except("_arms", "_have")).alias("_arm"))
    few = lacks.withColumn("_r", F.row_number().over(W.partitionBy("_arm").orderBy("_item"))).where(F.col("_r") <= NAMED)
    said = few.groupBy("_arm").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    line = F.format_string("arm %s lacks items such as %s", F.col("_arm"), F.array_join("_items", ", "))
    audit = said.agg(F.sort_array(F.collect_list(line)).alias("_said"))
    message = F.concat(F.lit("arms can be compared on the same items only: "), F.array_join("_said", "; "))
    checked = audit.select(F.when(F.size("_said") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("_same"))
    return rows.join(F.broadcast(checked)).where("_same").drop("_same")


def shared_items(scores: DataFrame, item: str = "item_id") -> DataFrame:
    """The rows of items that every arm has in the same repeat."""
    arms = scores.agg(F.count_distinct("arm").alias("_arms"))
    full = scores.groupBy(item, "repeat").agg(F.count_distinct("arm").alias("_n")).join(F.broadcast(arms)).where("_n = _arms")
    return scores.join(full.select(item, "repeat"), [item, "repeat"], "left_semi")


def _tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for a binomial of n and p: the regularised incomplete beta at p of (k, n - k + 1)."""
    if k <= 0 or p >= 1:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    a, b = k, n - k + 1
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(p) + b * math.log1p(-p))
    return front * _fraction(a, b, p) / a if p < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - p) / b


def _fraction(a: int, b: int, x: float) -> float:
    """Continued fraction of the incomplete beta, evaluated from the front with ratios c and d of its convergents."""
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    value = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return value


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def clopper_pearson(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Exact 95% interval of k in n by bisection on the binomial tails; for aggregated rows, which are few."""

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        return (low + high) / 2

    out = []
    for a, m in zip(k, n, strict=True):
        low = 0.0 if a == 0 else solve(lambda p: _tail(a, m, p) - 0.025)
        high = 1.0 if a == m else solve(lambda p: 0.025 - (1 - _tail(a + 1, m, p)))
        out.append((low, high))
    return pd.DataFrame(out, columns=["low", "high"])
