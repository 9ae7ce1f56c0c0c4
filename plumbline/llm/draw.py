"""Samples drawn by a hash threshold: each row decides alone, so no task sorts or gathers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The hash has so many values; a share of them is computed as a whole number in Python, so no product can overflow.
SPACE = 1 << 40


def share(rows: int, total: int) -> int:
    """How many of the SPACE hash values draw about ``rows`` of ``total`` rows."""
    return min(SPACE, -(-rows * SPACE // total)) if total > 0 else SPACE


def drawn(df: DataFrame, rows: int, total: int, *key: Column) -> DataFrame:
    """About ``rows`` of the ``total`` rows of ``df``, those whose hash of ``key`` is below the share; all if there are no more."""
    return df if total <= rows else df.where(F.pmod(F.xxhash64(*key), F.lit(SPACE)) < F.lit(share(rows, total)))
