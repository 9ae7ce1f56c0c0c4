"""Selective prediction and calibration over (group, confidence, correct); null and NaN confidences are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.prefix import running

EULER_GAMMA = 0.5772156649015329
#: Buckets of confidence in which running sums are taken, a unit of confidence.
BUCKETS = 1024
#: Shares of the rows that a summary reports the accuracy at.
TARGETS = (0.25, 0.5, 0.75)


def confident(df: DataFrame) -> DataFrame:
    return df.where(F.col("confidence").isNotNull() & ~F.isnan("confidence"))


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; 0 for n = 0. Summed up to 32, by its asymptotic series (error below 1e-15) from there on."""
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / i)
    x = n.cast("double")
    series = F.log(x) + EULER_GAMMA + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return F.when(n <= 0, 0.0).when(n <= 32, small).otherwise(series)


def _falling(df: DataFrame, by: str, order: str, ties: list[str], **sums: Column) -> DataFrame:
    """Running sums from the highest confidence down."""
    return running(df, [by], F.floor(F.col(order) * BUCKETS), [F.desc(order), *map(F.col, ties)], sums, descending=True)


def _total(df: DataFrame, by: str, value: Column) -> DataFrame:
    """``df`` with _all, the group's sum of value: an aggregate joined back, of one row a group."""
    totals = df.groupBy(F.col(by).alias("_g")).agg(F.sum(value).alias("_all"))
    return df.join(F.broadcast(totals), F.col(by).eqNullSafe(F.col("_g"))).drop("_g")  # arms are few


def tie_groups(df: DataFrame, by: str = "arm") -> DataFrame:
    """(by, confidence, size, hits, before_n, before_hits): one row a distinct confidence, with what ranks above it.

    Ties are summed before anything is ordered, so the windows see distinct confidences only.
    """
    groups = confident(df).groupBy(by, "confidence").agg(F.count("*").alias("size"), F.count_if("correct").alias("hits"))
    run = _falling(groups, by, "confidence", [], before_n=F.col("size"), before_hits=F.col("hits"))
    return run.withColumns({"before_n": F.col("before_n") - F.col("size"), "before_hits": F.col("before_hits") - F.col("hits")})


def curve_points(df: DataFrame, by: str = "arm") -> DataFrame:
    """(by, threshold, n_answered, coverage, selective_accuracy, selective_risk): tie-aware, a point a confidence."""
    total = F.col("_all")
    n, h = F.col("before_n") + F.col("size"), F.col("before_hits") + F.col("hits")
    return _total(tie_groups(df, by), by, F.col("size")).select(by, F.col("confidence").alias("threshold"), n.alias("n_answered"), (n / total).alias("coverage"), (h / n).alias("selective_accuracy"), (1 - h / n).alias("selective_risk"))


def curve_rows(df: DataFrame, by: str = "arm", ties: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """(by, ties, rank, coverage, selective_accuracy): a point a row, equal confidences in the order of ``ties``."""
    rows = confident(df).select(by, *ties, "confidence", F.col("correct").cast("int").alias("_y"))
    run = _total(_falling(rows, by, "confidence", list(ties), rank=F.lit(1), _h=F.col("_y")), by, F.lit(1))
    return run.select(by, *ties, "rank", (F.col("rank") / F.col("_all")).alias("coverage"), (F.col("_h") / F.col("rank")).alias("selective_accuracy"))


def area_part() -> Column:
    """What a tie group adds to the area, ties at the expectation of a random order.

    A group of m rows with hit rate r below B rows with H hits adds m (1 - r) - (H - r B)(Har(B + m) - Har(B)).
    """
    m, b, h0 = F.col("size"), F.col("before_n"), F.col("before_hits")
    r = F.col("hits") / m
    return m * (1 - r) - (h0 - r * b) * (harmonic(b + m) - harmonic(b))


def least_area(n: Column, hits: Column) -> Column:
    """The area where all hits rank first."""
    return ((n - hits) - hits * (harmonic(n) - harmonic(hits))) / n


def aurc(df: DataFrame, by: str = "arm") -> DataFrame:
    """(by, n, aurc, aurc_random, aurc_optimal, e_aurc)."""
    sums = tie_groups(df, by).groupBy(by).agg(F.sum(area_part()).alias("_area"), F.sum("size").alias("n"), F.sum("hits").alias("_hits"))
    n, h, best = F.col("n"), F.col("_hits"), least_area(F.col("n"), F.col("_hits"))
    return sums.select(by, "n", (F.col("_area") / n).alias("aurc"), (1 - h / n).alias("aurc_random"), best.alias("aurc_optimal"), (F.col("_area") / n - best).alias("e_aurc"))


def at_coverage(df: DataFrame, targets: tuple[float, ...] = TARGETS, by: str = "arm") -> DataFrame:
    """(by, target, coverage, selective_accuracy) of the first point that covers each target."""
    if not all(0 < t <= 1 for t in targets):
        raise ValueError("targets lie in (0, 1]")
    points = curve_points(df, by).withColumn("target", F.explode(F.array(*map(F.lit, targets))))
    reached = points.where(F.col("coverage") >= F.col("target") - 1e-12)
    first = F.min_by(F.struct("coverage", "selective_accuracy"), "n_answered")
    return reached.groupBy(by, "target").agg(first.alias("_p")).select(by, "target", "_p.coverage", "_p.selective_accuracy")


def threshold_curve(df: DataFrame, by: str = "arm") -> DataFrame:
    """(by, threshold, n_answered, n_pass, coverage, complete_pairs, fractured_pairs, both_pass_pairs) for every threshold.

    A pair is complete where both members answer, fractured where one does: its confidences' least and greatest are
    the thresholds at which it becomes so, and running sums over thresholds count them.
    """
    rows = confident(df)
    at = rows.groupBy(by, F.col("confidence").alias("threshold")).agg(F.count("*").alias("_n"), F.count_if("correct").alias("_p"))
    pair = rows.groupBy(by, "pair_id").agg(F.count("*").alias("_k"), F.min("confidence").alias("_lo"), F.max("confidence").alias("_hi"), F.bool_and("correct").alias("_ok")).where("_k = 2")
    steps = pair.select(by, F.explode(F.array(F.struct(F.col("_lo").alias("t"), F.lit(1).alias("c"), F.lit(0).alias("o"), F.col("_ok").cast("int").alias("b")), F.struct(F.col("_hi").alias("t"), F.lit(0).alias("c"), F.lit(1).alias("o"), F.lit(0).alias("b")))).alias("s"))
    moves = steps.groupBy(by, F.col("s.t").alias("threshold")).agg(F.sum("s.c").alias("_c"), F.sum("s.o").alias("_o"), F.sum("s.b").alias("_b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = _total(at.join(moves, [by, "threshold"], "left"), by, F.col("_n"))
    out = _falling(out, by, "threshold", [], n_answered=F.col("_n"), n_pass=F.col("_p"), complete_pairs=zero("_c"), _touched=zero("_o"), both_pass_pairs=zero("_b"))
    return out.select(by, "threshold", "n_answered", "n_pass", (F.col("n_answered") / F.col("_all")).alias("coverage"), "complete_pairs", (F.col("_touched") - F.col("complete_pairs")).alias("fractured_pairs"), "both_pass_pairs")


def guard_confidence(df: DataFrame) -> DataFrame:
    """``df``; a confidence outside [0, 1] raises when the rows are read."""
    ok = F.col("confidence").isNull() | F.col("confidence").between(0, 1)
    return df.withColumn("confidence", F.when(ok, F.col("confidence")).otherwise(F.raise_error(F.lit("confidence outside [0, 1]")).cast("double")))


def brier(df: DataFrame, by: str = "arm") -> DataFrame:
    """(by, n, brier, brier_constant, mean_confidence)."""
    y = F.col("correct").cast("double")
    p = F.avg(y)
    return confident(guard_confidence(df)).groupBy(by).agg(F.count("*").alias("n"), F.avg((F.col("confidence") - y) * (F.col("confidence") - y)).alias("brier"), (p * (1 - p)).alias("brier_constant"), F.avg("confidence").alias("mean_confidence"))


def reliability(df: DataFrame, bins: int = 10, by: str = "arm") -> DataFrame:
    """(by, bin, low, high, n, mean_confidence, accuracy) with empty bins kept."""
    spark = df.sparkSession
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("long")
    full = confident(guard_confidence(df)).groupBy(by, at.alias("bin")).agg(F.count("*").alias("_n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    grid = df.select(by).distinct().crossJoin(F.broadcast(spark.range(bins).withColumnRenamed("id", "bin")))  # groups x bins
    out = grid.join(full, [by, "bin"], "left")
    return out.select(by, "bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("_n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


def ece(df: DataFrame, bins: int = 10, by: str = "arm") -> DataFrame:
    """(by, ece): the gaps between confidence and accuracy, weighted by the bins' sizes."""
    gap = F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return reliability(df, bins, by).groupBy(by).agg((F.sum(gap) / F.sum("n")).alias("ece"))
