"""Readers of corpus, quarantine, run and result files, with explicit schemas and guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.corpus import violations
from plumbline.operators.significance import same_items_or_raise

SCHEMA_VERSION = "1.0"
EXCLUDED = "EXCLUDED_FROM_SCORING"

ITEM = """struct<id: string, item_type: string, pair_id: string, pair_role: string, family: string, risk_tier: string, question: string, correct_answer: string,
answer_key: struct<required_concepts: array<array<string>>, forbidden_concepts: array<array<string>>, numeric_facts: array<struct<label: string, value: double, unit: string, tolerance_abs: double>>>,
adjacent_wrong: struct<label: string, answer: string, signature_terms: array<string>, why_dangerous: string>,
source: struct<standard: string, clause: string, section_title: string, url: string, access: string, anchor_text: string, value_from: string>,
cross_reference: array<struct<standard: string, clause: string, access: string, corroboration: string>>,
verification: struct<status: string, method: string, source_edition_date: string>, abstention_acceptable: boolean, notes: string>"""
CORPUS = f"schema_version string, domain string, domain_title string, source_family string, sourcing_note string, items array<{ITEM}>"
QUARANTINE = "schema_version string, status string, purpose string, policy string, items array<struct<id: string, intended_domain: string, draft_question: string, why_excluded: string>>"
RUN = """schema string, library_version string, adapter struct<name: string, arm: string>, corpus_digest string, n_items int, repeat int, seed long, started_utc string, duration_s double, is_mock_demonstration boolean,
responses array<struct<item_id: string, text: string, citations: array<string>, confidence: double, latency_s: double, error: string, metadata: map<string, string>, provenance: string>>,
scores array<struct<item_id: string, domain: string, family: string, item_type: string, risk_tier: string, pair_id: string, outcome: string, concept_coverage: double, numeric_coverage: double, abstained: boolean, citation_grade: string, confidence: double, unscorable_reason: string>>, scoring_config map<string, string>, environment map<string, string>"""


class CorpusError(ValueError):
    """A corpus, quarantine or run file that breaks a rule."""


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_items(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row an item of all ``*.json`` files: domain and file beside the item's fields, default tier medium.

    Key phrases are trimmed and lower-cased. Strict: a wrong version, an empty file or a broken rule raises.
    """
    files = _json(spark, path, CORPUS).withColumn("file", F.col("_metadata.file_name"))
    if strict:
        bad = files.where((F.coalesce("schema_version", F.lit("")) != SCHEMA_VERSION) | (F.trim(F.coalesce("domain", F.lit(""))) == "") | (F.coalesce(F.size("items"), F.lit(0)) <= 0)).select("file").take(3)
        if bad:
            raise CorpusError(f"version, domain or items missing in {[r[0] for r in bad]}")
    items = files.select("domain", "file", F.explode("items").alias("_i")).select("domain", "file", "_i.*")
    clean = lambda groups: F.transform(groups, lambda g: F.transform(g, lambda p: F.lower(F.trim(p))))
    key = F.col("answer_key")
    items = items.withColumn("answer_key", key.withField("required_concepts", clean(key["required_concepts"])).withField("forbidden_concepts", clean(key["forbidden_concepts"]))).withColumn("risk_tier", F.coalesce("risk_tier", F.lit("medium")))
    if strict and (found := violations(items).take(5)):
        raise CorpusError("; ".join(f"{r.rule} {r.item_id} {r.detail}" for r in found))
    return items


def keys(items: DataFrame) -> DataFrame:
    """Items in the shape that scoring takes."""
    numeric = F.transform(F.coalesce("answer_key.numeric_facts", F.array().cast("array<struct<label: string, value: double, unit: string, tolerance_abs: double>>")), lambda n: F.struct(n["value"].alias("value"), F.coalesce(n["tolerance_abs"], F.lit(0.0)).alias("tolerance")))
    none = F.array().cast("array<array<string>>")
    return items.select(F.col("id").alias("item_id"), F.coalesce("answer_key.required_concepts", none).alias("required"), F.coalesce("answer_key.forbidden_concepts", none).alias("forbidden"), numeric.alias("numeric"), F.coalesce("adjacent_wrong.signature_terms", F.array().cast("array<string>")).alias("adjacent"))


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Draft items that must not be scored; a file without the guard status raises. Scoring has no way in from here."""
    files = _json(spark, path, QUARANTINE)
    if not files.where(F.coalesce("status", F.lit("")) != EXCLUDED).isEmpty():
        raise CorpusError(f"quarantine status is not {EXCLUDED}")
    return files.select(F.explode("items").alias("_i")).select("_i.*")


def read_runs(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """One row a run; a digest other than the corpus's raises."""
    runs = _json(spark, path, RUN)
    if digest is not None and (bad := runs.where(~F.col("corpus_digest").eqNullSafe(digest)).select("adapter.name").take(3)):
        raise CorpusError(f"runs on another corpus: {[r[0] for r in bad]}")
    return runs


def run_scores(runs: DataFrame) -> DataFrame:
    """The fact table of scored responses: one row a run and item, with the flags that reports use."""
    rows = runs.select(F.col("adapter.name").alias("adapter"), F.col("adapter.arm").alias("arm"), "repeat", F.coalesce("is_mock_demonstration", F.lit(False)).alias("is_mock"), F.explode("scores").alias("_s"))
    return rows.select("adapter", "arm", "repeat", "is_mock", "_s.*").withColumns({k: F.col("outcome") == v for k, v in (("correct", "correct"), ("adjacent", "adjacent_substitution"), ("abstained_flag", "abstained"))})


def read_arms(spark: SparkSession, paths: dict[str, str], digest: str | None = None) -> DataFrame:
    """Scores of the factual items of several arms (name -> run file), ready to be compared item by item.

    Each file holds one run with factual items, or this raises. Reading the rows raises where the arms' items differ.
    """
    arms = []
    for name, path in paths.items():
        runs = read_runs(spark, path, digest)
        if (n := runs.count()) != 1:
            raise CorpusError(f"{path}: expected one run, found {n}")
        scores = run_scores(runs).where("item_type = 'factual'").withColumn("arm", F.lit(name))
        if scores.isEmpty():
            raise CorpusError(f"{path}: no factual items")
        arms.append(scores)
    if not arms:
        raise CorpusError("no arms to load")
    return same_items_or_raise(reduce(DataFrame.unionByName, arms))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored CSV result by its header, with an explicit schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def cell(table: DataFrame, column: str, **where) -> object:
    """The one value of a column where all conditions hold; none or many raise."""
    for k, v in where.items():
        table = table.where(F.col(k) == v)
    rows = table.select(column).take(2)
    if len(rows) != 1:
        raise CorpusError(f"{'no' if not rows else 'more than one'} row where {where}")
    return rows[0][0]
