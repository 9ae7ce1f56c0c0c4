"""Rater agreement and item analysis, from explicit sums so that no variance of zero raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cohen(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, agreement, expected, kappa) of two raters' labels; kappa is null where expected agreement is 1.

    One count by (label, label), from which both raters' totals follow: rows are never paired.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_c"))
    total = cells.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("_c")).otherwise(0)).alias("_same"))
    left = cells.groupBy(*by, F.col("_a").alias("_l")).agg(F.sum("_c").alias("_x"))
    right = cells.groupBy(*by, F.col("_b").alias("_l")).agg(F.sum("_c").alias("_y"))
    chance = left.join(right, [*by, "_l"]).groupBy(*by).agg(F.sum(F.col("_x").cast("double") * F.col("_y")).alias("_e"))
    both = total.join(chance, by, "left") if by else total.crossJoin(chance)
    n = F.col("n").cast("double")
    pe = F.coalesce("_e", F.lit(0.0)) / (n * n)
    po = F.col("_same") / n
    return both.select(*by, "n", po.alias("agreement"), pe.alias("expected"), F.when(pe < 1, F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def disagreements(human: DataFrame, automatic: DataFrame, on: str = "rating_id") -> DataFrame:
    """(on, human, automatic) of the ratings that both sides (on, label) have and that differ; the human's is the primary one."""
    both = human.select(on, F.col("label").alias("human")).join(automatic.select(on, F.col("label").alias("automatic")), on)
    return both.where("human <> automatic")


def fleiss(df: DataFrame, item: str = "item_id", label: str = "correct") -> DataFrame:
    """(n_items, n_raters, mean_agreement, expected, kappa) over items rated by all raters; null where expected is 1."""
    cells = df.groupBy(item, label).agg(F.count("*").alias("_c"))
    items = cells.groupBy(item).agg(F.sum("_c").alias("_r"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
    most = items.agg(F.max("_r").alias("n_raters"))
    full = items.join(F.broadcast(most), F.col("_r") == F.col("n_raters"))  # one row
    r = F.col("n_raters").cast("double")
    main = full.groupBy("n_raters").agg(F.count("*").alias("n_items"), F.avg(F.try_divide(F.col("_q") - r, r * (r - 1))).alias("mean_agreement"))
    shares = cells.join(full.select(item), item, "left_semi").groupBy(label).agg(F.sum("_c").alias("_t"))
    expected = shares.agg(F.sum(F.col("_t").cast("double") * F.col("_t")).alias("_tt"), F.sum("_t").alias("_s")).select((F.col("_tt") / (F.col("_s").cast("double") * F.col("_s"))).alias("expected"))
    pe = F.col("expected")
    return main.crossJoin(F.broadcast(expected)).select("n_items", "n_raters", "mean_agreement", "expected", F.when(pe < 1, F.try_divide(F.col("mean_agreement") - pe, 1 - pe)).alias("kappa"))


def difficulty(df: DataFrame) -> DataFrame:
    """(item_id, n_raters, n_correct, difficulty): difficulty is the share of arms that are right."""
    k = F.count_if("correct")
    return df.groupBy("item_id").agg(F.count("*").alias("n_raters"), k.alias("n_correct"), (k / F.count("*")).alias("difficulty"))


def point_biserial(df: DataFrame) -> DataFrame:
    """(arm, n, discrimination): correlation of an arm's correctness with the other arms' score on the item.

    The rest-score leaves the arm out. Null where either side does not vary.
    """
    sums = df.groupBy("item_id").agg(F.count_if("correct").alias("_s"))
    both = df.join(sums, "item_id")
    x = F.col("correct").cast("double")
    y = F.col("_s") - x
    held = both.groupBy("arm").agg(F.count("*").alias("n"), F.sum(x).alias("_x"), F.sum(y).alias("_y"), F.sum(x * y).alias("_xy"), F.sum(x * x).alias("_xx"), F.sum(y * y).alias("_yy"))
    vx, vy = F.col("n") * F.col("_xx") - F.col("_x") * F.col("_x"), F.col("n") * F.col("_yy") - F.col("_y") * F.col("_y")
    return held.select("arm", "n", F.when((vx > 0) & (vy > 0), (F.col("n") * F.col("_xy") - F.col("_x") * F.col("_y")) / F.sqrt(vx * vy)).alias("discrimination"))
