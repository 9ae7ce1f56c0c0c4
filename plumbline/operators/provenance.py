"""A record of which items were verified against which section text, brought up to date by reading only what changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import scratch
from plumbline.functions.citations import section_of
from plumbline.operators.corpus import FIELD, verify

RECORD = "item_id {id}, clause string, title string, section string, item_digest string, section_digest string, anchor_present boolean, markers_missing array<string>, anchor_local boolean, ok boolean, error string"


def _present(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Items with the section that they cite, a digest of clause and anchor, and the section's digest by the manifest."""
    where = section_of(F.col("clause"))
    digest = F.sha2(F.concat_ws(FIELD, F.coalesce("clause", F.lit("")), F.coalesce("anchor", F.lit(""))), 256)
    rows = items.select("item_id", "clause", "anchor", where["title"].alias("title"), where["section"].alias("section"), digest.alias("item_digest"))
    return rows.join(manifest.select("title", "section", F.col("digest").alias("section_digest")), ["title", "section"], "left")


def reverify(items: DataFrame, manifest: DataFrame, read: Callable[[DataFrame], DataFrame], record: DataFrame | None = None) -> DataFrame:
    """The record of all items (item_id, clause, anchor), taken over from ``record`` where nothing has changed.

    manifest: (title, section, digest), one row a section, without its text. ``read`` gives (title, section, text) of the
    sections it is asked for, (title, section) without repeats; it is not called if nothing is to be read. An item is
    checked again if it is new, if its clause or anchor has changed, or if its section has, came or went; items that are
    gone leave the record. error: unparsed (no section in the clause) or no_section (none in the manifest, or no text).
    """
    now = _present(items, manifest)
    state = ["item_id", "item_digest", "section_digest"]
    if record is None:
        record = items.sparkSession.createDataFrame([], RECORD.format(id=dict(items.dtypes)["item_id"]))
    same = lambda a, b: (a["item_id"] == b["item_id"]) & (a["item_digest"] == b["item_digest"]) & a["section_digest"].eqNullSafe(b["section_digest"])
    old, new = record.alias("o"), now.select(state).alias("n")
    kept = old.join(new, same({c: F.col(f"o.{c}") for c in state}, {c: F.col(f"n.{c}") for c in state}), "left_semi")
    known = record.select(state).alias("k")
    stale = scratch.saved(now.alias("w").join(known, same({c: F.col(f"w.{c}") for c in state}, {c: F.col(f"k.{c}") for c in state}), "left_anti"), "stale")
    if stale.isEmpty():
        return kept
    readable = stale.where(F.col("section_digest").isNotNull())
    facts = ["anchor_present", "markers_missing", "anchor_local", "ok"]
    blank = {"anchor_present": F.lit(False), "markers_missing": F.array().cast("array<string>"), "anchor_local": F.lit(None).cast("boolean"), "ok": F.lit(False)}
    error = F.when(F.col("section").isNull(), "unparsed").otherwise("no_section")
    done = stale.where(F.col("section_digest").isNull()).withColumns(blank).withColumn("error", error)
    wanted = readable.select("title", "section").distinct()
    if not readable.isEmpty():
        texts = scratch.saved(read(wanted).where(F.col("text").isNotNull()), "sections")
        got = readable.join(texts.select("title", "section", F.lit(True).alias("_got")), ["title", "section"], "left")
        checked = got.join(verify(readable.select("item_id", "clause", "anchor"), texts), "item_id")
        checked = checked.withColumn("error", F.when(F.col("_got").isNull(), "no_section"))
        done = done.unionByName(checked.select(done.columns))
    return kept.unionByName(done.select("item_id", "clause", "title", "section", "item_digest", "section_digest", *facts, "error"))


def totals(record: DataFrame) -> DataFrame:
    """One row: n_items, n_checked (all but unparsed), n_ok, n_failed, n_unparsed, n_warnings, n_sections, n_section_errors.

    A warning is an anchor that was found outside the cited paragraph; it fails nothing. An empty record counts zeros.
    """
    lost, unparsed = F.coalesce(F.col("error") == "no_section", F.lit(False)), F.coalesce(F.col("error") == "unparsed", F.lit(False))
    by_section = record.groupBy("title", "section").agg(
        F.count("*").alias("_n"), F.count_if("ok").alias("_ok"), F.count_if(unparsed).alias("_unparsed"), F.count_if(F.col("anchor_local") == F.lit(False)).alias("_warned"), F.count_if(lost).alias("_lost")
    )
    summed = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    named = F.col("section").isNotNull()
    return by_section.agg(
        summed("_n").alias("n_items"), summed(F.col("_n") - F.col("_unparsed")).alias("n_checked"), summed("_ok").alias("n_ok"), summed(F.col("_n") - F.col("_unparsed") - F.col("_ok")).alias("n_failed"),
        summed("_unparsed").alias("n_unparsed"), summed("_warned").alias("n_warnings"), F.count_if(named & (F.col("_lost") == 0)).alias("n_sections"), F.count_if(named & (F.col("_lost") > 0)).alias("n_section_errors"),
    )


def warnings(record: DataFrame) -> DataFrame:
    """(item_id, clause) of anchors that were found, but not behind a marker that the clause cites."""
    return record.where(F.col("anchor_local") == F.lit(False)).select("item_id", "clause")
