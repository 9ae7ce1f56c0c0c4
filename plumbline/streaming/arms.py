"""Arm summaries over a stream of events. An extension: the batch operators have no streaming counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, arm, n, n_correct) in event-time windows; rows later than the watermark are dropped, state stays bounded."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("arm"), (k < 40).alias("correct"))
    out = rows.withWatermark("ts", late).groupBy(F.window("ts", window).alias("_w"), "arm").agg(F.count("*").alias("n"), F.count_if("correct").alias("n_correct"))
    return out.select(F.col("_w.start").alias("start"), "arm", "n", "n_correct")
