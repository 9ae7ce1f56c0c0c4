"""Arrow batches of texts: how many rows they have, and functions of texts that hold few of them as Python objects."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of a batch at most where ``bound`` was called; Spark's own bound is 10,000, tens of MB of text in the JVM and again in Python.
ROWS = 1000
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Values that a worker holds as Python objects at once.
AT_ONCE = 128


def bound(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have ROWS rows at most; a smaller bound of the caller's stays.

    Spark reads the setting when a plan runs, so it is not put back. It changes no result.
    """
    own = int(spark.conf.get(SETTING))
    if own <= 0 or own > ROWS:
        spark.conf.set(SETTING, str(ROWS))


def each(f: Callable[..., Any], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``f`` of every row of the columns, null as None, AT_ONCE rows at a time."""
    made = [pa.array([f(*row) for row in zip(*(c.slice(k, AT_ONCE).to_pylist() for c in columns), strict=True)], kind) for k in range(0, len(columns[0]), AT_ONCE)]
    return pa.concat_arrays(made) if made else pa.array([], kind)
