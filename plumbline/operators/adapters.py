"""Systems under test as transformations of items into responses.

Built-in ones are column expressions. An external system is a Python function on a batch, run in ``mapInPandas``; an
exception becomes the error of its row, and a reply to another item than was asked raises.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = "item_id {id}, text string, citations array<string>, confidence double, latency_s double, error string"


def _row(items: DataFrame, text, citations=None, confidence=None) -> DataFrame:
    return items.select(
        "item_id", text.alias("text"), (F.array().cast("array<string>") if citations is None else citations).alias("citations"), F.lit(None if confidence is None else confidence).cast("double").alias("confidence"),
        F.lit(None).cast("double").alias("latency_s"), F.lit(None).cast("string").alias("error"),
    )


def static(items: DataFrame, text: str, confidence: float | None = None) -> DataFrame:
    """The same words for every item."""
    return _row(items, F.lit(text), confidence=confidence)


def oracle(items: DataFrame) -> DataFrame:
    """The reference answer with its clause."""
    return _row(items, F.concat(F.col("correct_answer"), F.lit(" See "), F.col("clause"), F.lit(".")), F.array("clause"), 1.0)


def random_floor(items: DataFrame, clauses: DataFrame, seed: int = 20260907, repeat: int = 0) -> DataFrame:
    """Answer, adjacent answer or refusal, and a clause of the pool, by a hash of seed, repeat and id: order plays no part."""
    pool = clauses.agg(F.sort_array(F.collect_set("clause")).alias("_pool"))  # clauses of a corpus are few
    word = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{repeat}|{salt}"), F.col("item_id").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = items.crossJoin(F.broadcast(pool)).withColumns({"_u": word("kind") % 100, "_k": (word("clause") % F.size("_pool")).cast("int")})
    text = F.when(F.col("_u") < 44, F.col("correct_answer")).when(F.col("_u") < 88, F.col("adjacent_answer")).otherwise("I don't know.")
    return _row(rows, text, F.array(F.get("_pool", F.col("_k"))), None)


def retrieved(items: DataFrame, top: DataFrame, passages: DataFrame) -> DataFrame:
    """The best passage quoted with its clause, the score rounded to 4 as confidence; top (query_id, doc_id, score) of rank 1."""
    from plumbline.operators.corpus import answered_from

    rows = items.join(top.select(F.col("query_id").alias("item_id"), "doc_id", "score"), "item_id").join(passages, "doc_id")
    out = _row(rows.withColumn("_c", F.round("score", 4)), answered_from(F.col("standard"), F.col("clause"), F.col("title"), F.col("anchor")), F.array("clause"))
    return out.drop("confidence").join(rows.select("item_id", F.round("score", 4).alias("confidence")), "item_id").select("item_id", "text", "citations", "confidence", "latency_s", "error")


def wait(tried: int, told: str | float | None = None, first: float = 1.0, most: float = 32.0) -> float:
    """Seconds until the next try: what the other side tells if that is a number, else doubling; never above ``most``."""
    try:
        return min(float(told), most)
    except (TypeError, ValueError):
        return min(first * 2**tried, most)


def external(items: DataFrame, ask: Callable[[dict], dict], tries: int = 1, first_wait: float = 1.0, most_wait: float = 32.0) -> DataFrame:
    """Responses of ``ask(item) -> {item_id, text, citations, confidence}``, with latency; waits double between tries.

    An exception with ``retry_after`` (seconds) says itself how long to wait.
    Rows are asked one after another within a task, tasks side by side; nothing is gathered on the driver.
    """
    schema = RESPONSE.format(id=dict(items.dtypes)["item_id"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for item in f.to_dict("records"):
                began, reply, error = time.perf_counter(), {}, None
                for n in range(tries):
                    try:
                        reply, error = ask(item), None
                        break
                    except Exception as e:  # the system's failure is its row's outcome
                        error = f"{type(e).__name__}: {e}"
                        if n + 1 < tries:
                            time.sleep(max(0.0, wait(n, getattr(e, "retry_after", None), first_wait, most_wait)))
                if reply.get("item_id", item["item_id"]) != item["item_id"]:
                    raise ValueError(f"asked {item['item_id']}, answered {reply['item_id']}")
                out.append((item["item_id"], reply.get("text", ""), list(reply.get("citations", [])), reply.get("confidence"), time.perf_counter() - began, error))
            yield pd.DataFrame(out, columns=["item_id", "text", "citations", "confidence", "latency_s", "error"])

    return items.mapInPandas(run, schema)


def repeats(items: DataFrame, make: Callable[[int], Callable[[DataFrame], DataFrame]], n: int) -> DataFrame:
    """Responses of n repeats, each by its own adapter; fewer than one raises."""
    if n < 1:
        raise ValueError("at least one repeat")
    out = make(0)(items).withColumn("repeat", F.lit(0))
    for k in range(1, n):
        out = out.unionByName(make(k)(items).withColumn("repeat", F.lit(k)))
    return out
