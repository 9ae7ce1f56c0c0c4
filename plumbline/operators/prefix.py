"""Running sums and ranks over groups of any size.

A window over a whole group sorts it in one task. Here a coarse bucket of the order splits the group: windows run
within (group, bucket), and what lies in earlier buckets comes from a table of sums, one row a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, by: list[str], bucket: Column, order: list[Column], sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """``df`` with the inclusive running sums over each group; ``bucket`` must be monotone in ``order``.

    Null group keys are groups; no group keys make one group. Ties in the order are summed one row after another.
    """
    held = df.withColumn("_rbucket", bucket).withColumns({f"_v_{k}": c for k, c in sums.items()})
    totals = held.groupBy(*by, "_rbucket").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    step = F.col("_rbucket").desc() if descending else F.col("_rbucket").asc()
    earlier = W.partitionBy(*by).orderBy(step).rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0)
    offsets = totals.select(*(F.col(c).alias(f"_k_{c}") for c in by), F.col("_rbucket").alias("_rkey"), *(F.coalesce(F.sum(f"_t_{k}").over(earlier), none).alias(f"_o_{k}") for k in sums))
    within = W.partitionBy(*by, "_rbucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    run = held.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(within) for k in sums})
    same = F.col("_rbucket").eqNullSafe(F.col("_rkey"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return run.join(offsets, same).select(*df.columns, *((F.col(f"_r_{k}") + F.col(f"_o_{k}")).alias(k) for k in sums))


def hex_bucket(digest: Column) -> Column:
    """One of 4096 buckets in the order of a hex digest."""
    return F.substring(digest, 1, 3)
