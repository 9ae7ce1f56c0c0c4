"""A pipeline from raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import batches, mixing, near_copies, packing, quality_rules, secrets
from plumbline.llm.scratch import kept_alone
from plumbline.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base thresholds nor a rule of the cascade rejects, as they are."""
    judged = quality_rules.judge(docs.select(F.struct("*").alias("_doc"), "text"))
    return judged.where("kept").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id: by vantage-point trees on fingerprints, and by whole sets.

    Texts link at two differing bits or fewer, or where they share 0.8 or more of their five-word shingles.
    """
    batches.bound(spark)
    return near_copies.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with a mark in place of each secret; n_chars follows the text."""
    batches.bound(spark)
    clean = docs.withColumn("text", secrets.redacted("text"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times or not at all."""
    return mixing.repeat(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens; repeated documents are packed each for itself."""
    batches.bound(spark)
    return packing.op3_query(docs)


STAGES = [("quality_rules", quality), ("simhash", near_dedup), ("secrets", without_secrets), ("mixing", mixed), ("packing", packed)]

#: Fingerprints, redaction and tokens have no SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage has read is dropped once its result is there."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        made = kept_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if held:
            held.drop()
        docs, held = made.df, made
    return STAGES[-1][1](spark, docs, sf_dir)
