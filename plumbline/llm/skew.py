"""Joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with a thousandth of the rows or more is hot; there are at most a thousand of them, whatever the input.
HOT_KEYS = 1000


def join_counted(rows: DataFrame, lookup: DataFrame, key: str, count: str = "_n") -> DataFrame:
    """Inner join of ``rows`` with ``lookup``, in which ``key`` is unique and ``count`` says how many rows have it.

    Hot keys are broadcast, so their rows stay where they are; the others are shuffled. ``count`` is not returned.
    """
    total = lookup.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_KEYS >= F.lit(total)
    few, many = lookup.where(hot).drop(count), lookup.where(~hot).drop(count)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rest.join(many, key))
