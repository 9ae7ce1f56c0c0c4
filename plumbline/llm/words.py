"""Word columns shared by the native operators: maximal runs of anything but the six ASCII spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def n_words(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.size(words(text)).cast("long")
