"""Writers of runs, samples and result tables, and the Markdown forms of small results."""

from __future__ import annotations

import re

import platform

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import __version__
from plumbline.sources.corpus import RUN


def safe_name(name: str, mock: bool = False) -> str:
    """A file name part: runs of other characters become one dash; mock runs say so."""
    return ("mock__" if mock else "") + (re.sub(r"[^A-Za-z0-9._-]+", "-", name).strip("-") or "run")


def write_scores(scores: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The fact table as Parquet, partitioned so that reading an arm or a repeat reads no other."""
    clean = F.concat(F.when(F.col("is_mock"), "mock__").otherwise(""), F.regexp_replace(F.regexp_replace("adapter", r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", ""))
    scores.withColumn("adapter_file", clean).write.mode(mode).partitionBy("adapter_file", "repeat").parquet(path)


def environment() -> dict[str, str]:
    """What a run was made with."""
    return {"python": platform.python_version(), "platform": platform.platform(), "pyspark": pyspark.__version__}


def write_runs(scored: DataFrame, path: str, digest: str, config: dict[str, str], seed: int | None = None, mode: str = "errorifexists") -> None:
    """Runs as JSON that ``read_runs`` reads back: one record for each (adapter, arm, repeat) of ``scored``.

    scored: rows of ``score_full`` with adapter, arm, repeat and is_mock; columns of the record that it lacks are null.
    A run's responses and scores, which are as many as its corpus has items, are gathered into its record. Records are
    files in folders by adapter and repeat, mock ones under a name that says so.
    """
    kinds = scored.sparkSession.createDataFrame([], RUN).schema
    have = {"concept_coverage": F.col("coverage")} | {c: F.col(c) for c in scored.columns}

    def record(field: str):
        fields = kinds[field].dataType.elementType.fields
        return F.struct(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    rows = scored.select("adapter", "arm", "repeat", "is_mock", record("responses").alias("_r"), record("scores").alias("_s"))
    by_id = lambda a, b: F.when(a["item_id"] < b["item_id"], -1).when(a["item_id"] > b["item_id"], 1).otherwise(0)
    gathered = lambda c: F.array_sort(F.collect_list(c), by_id)
    runs = rows.groupBy("adapter", "arm", "repeat").agg(F.bool_or("is_mock").alias("is_mock_demonstration"), F.count("*").cast("int").alias("n_items"), gathered("_r").alias("responses"), gathered("_s").alias("scores"))
    told = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    clean = F.regexp_replace(F.regexp_replace("adapter", r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    out = runs.select(
        F.lit("run").alias("schema"), F.lit(__version__).alias("library_version"), F.struct(F.col("adapter").alias("name"), "arm").alias("adapter"), F.lit(digest).alias("corpus_digest"), "n_items", F.col("repeat").cast("int").alias("_repeat"),
        F.lit(seed).cast("long").alias("seed"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_utc"), "is_mock_demonstration", "responses", "scores", told(config).alias("scoring_config"), told(environment()).alias("environment"),
        F.concat(F.when(F.col("is_mock_demonstration"), "mock__").otherwise(""), clean).alias("adapter_file"), F.col("repeat").cast("int").alias("repeat"), F.col("repeat").cast("int").alias("repeat_file"),
    ).drop("_repeat")
    out.write.mode(mode).partitionBy("adapter_file", "repeat_file").json(path)


def write_sample(sheet: DataFrame, key: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The blinded sheet and its key as separate tables."""
    for df, name in ((sheet, "sheet"), (key, "key")):
        df.write.mode(mode).option("header", True).csv(f"{path}/{name}")


def write_audit(answers: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The audit records of ``retrieval.answers`` as JSON lines, one an answer; answers without a record are left out."""
    answers.where("audit IS NOT NULL").select("audit").write.mode(mode).text(path)


def differs(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of one side that the other lacks, repeats counted: empty where an artifact is up to date."""
    fresh = fresh.select(*stored.columns)
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(stored, fresh, "stored").unionByName(only(fresh, stored, "fresh"))


def markdown(table: DataFrame, places: int = 3, limit: int = 1000) -> str:
    """A report table as Markdown; a larger one raises, since it is no report."""
    rows = table.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    show = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [table.columns, ["---"] * len(table.columns), *([show(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def summary(scores: DataFrame, table: DataFrame, banner: str | None = None) -> str:
    """Text of a report; scores of mock runs without a banner raise."""
    if banner is None and scores.agg(F.max("is_mock")).first()[0]:
        raise ValueError("mock rows need a banner")
    return "\n\n".join(filter(None, [banner, markdown(table)]))


def wide(table: DataFrame, by: str, name: str, value: str, names: list[str]) -> DataFrame:
    """A long table with a column for each named row kind."""
    return table.groupBy(by).pivot(name, names).agg(F.first(value))
