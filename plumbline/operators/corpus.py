"""Rules, digests and summaries of an answer-key corpus, as DataFrames so that findings can be queried."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.citations import anchor_local, citations, section_of
from plumbline.functions.text import flat_markup

FIELD, RECORD = "\u001f", "\u001e"


def violations(items: DataFrame) -> DataFrame:
    """(rule, item_id, detail) of every broken rule over corpus items; empty when the corpus is sound.

    Row rules are one pass; ids and pairs are two small aggregations. Lists may be null.
    """
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    groups = F.coalesce("answer_key.required_concepts", F.array())
    rules: dict[str, tuple[Column, Column]] = {
        "missing_field": (blank("id") | blank("question") | blank("correct_answer") | blank("family"), F.lit("id, question, correct_answer, family")),
        "item_type": (~F.coalesce(F.col("item_type").isin("factual", "category_error"), F.lit(False)), F.col("item_type")),
        "no_required_concepts": (F.size(groups) == 0, F.lit("required_concepts")),
        "empty_group": (F.exists(groups, lambda g: F.coalesce(F.size(g), F.lit(0)) <= 0), F.lit("required_concepts")),
        "blank_anchor": (blank("source.anchor_text"), F.lit("anchor_text")),
        "not_verified": (F.coalesce("verification.status", F.lit("")) != "verified", F.col("verification.status")),
        "category_error_must_allow_abstention": ((F.col("item_type") == "category_error") & ~F.coalesce("abstention_acceptable", F.lit(False)), F.lit("abstention_acceptable")),
        "half_pair": (F.col("pair_id").isNull() != F.col("pair_role").isNull(), F.col("pair_id")),
        "pair_role": (F.coalesce(~F.col("pair_role").isin("a", "b"), F.lit(False)), F.col("pair_role")),
        "unparsed_clause": (F.size(citations(F.col("source.clause"))) == 0, F.col("source.clause")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("rule"), detail.cast("string").alias("detail"))) for n, (bad, detail) in rules.items()]), lambda x: x.isNotNull())
    rows = items.select(F.col("id").alias("item_id"), F.explode(found).alias("_f")).select("_f.rule", "item_id", "_f.detail")
    again = items.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.lit("duplicate_id").alias("rule"), F.col("id").alias("item_id"), F.col("_n").cast("string").alias("detail"))
    pairs = items.where("pair_id IS NOT NULL").groupBy("pair_id").agg(F.sort_array(F.collect_list("pair_role")).alias("_r")).where(F.concat_ws(",", "_r") != "a,b")
    return rows.unionByName(again).unionByName(pairs.select(F.lit("pair_roles").alias("rule"), F.lit(None).cast("string").alias("item_id"), F.concat_ws(":", "pair_id", F.concat_ws(",", "_r")).alias("detail")))


def digest(items: DataFrame, columns: list[str]) -> DataFrame:
    """(n_items, digest): a SHA-256 tree over the items, fields and records apart by separators, nulls as empty.

    Items are hashed where they are and equal ones counted; hashes meet by their first five digits, those groups by
    three, and those by none, so no task holds more than a group. The order of the input plays no part; an empty corpus gives no row.
    """
    text = F.concat_ws(FIELD, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    level = items.groupBy(F.sha2(text, 256).alias("_p")).agg(F.count("*").alias("_n"))
    level = level.select("_p", "_n", F.concat_ws(":", "_p", F.col("_n").cast("string")).alias("_d"))
    for digits in (5, 3, 0):
        lines = F.transform(F.sort_array(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"])
        level = level.groupBy(F.substring("_p", 1, digits).alias("_p")).agg(F.sum("_n").alias("_n"), F.sha2(F.concat_ws(RECORD, lines), 256).alias("_d"))
    return level.select(F.col("_n").alias("n_items"), F.col("_d").alias("digest"))


def recheck(items: DataFrame, report: DataFrame) -> DataFrame:
    """(item_id, problem): items that a stored verification lacks, or whose clause differs from it, or that it failed."""
    both = items.select("item_id", "clause").join(report.select("item_id", F.col("clause").alias("_c"), "ok"), "item_id", "left")
    problem = F.when(F.col("_c").isNull() & F.col("ok").isNull(), "not_in_report").when(~F.col("_c").eqNullSafe(F.col("clause")), "clause_differs").when(~F.coalesce("ok", F.lit(False)), "failed")
    return both.select("item_id", problem.alias("problem")).where("problem IS NOT NULL")


def verify(items: DataFrame, sections: DataFrame) -> DataFrame:
    """Items (item_id, clause, anchor) against section texts (title, section, text): markers missing, anchor found and local.

    An anchor is found in the text's plain form: tags out, quotes and dashes plain, entities read. A blank or null
    anchor is never found. Each section is joined once for all the items that cite it.
    """
    cited = items.select("item_id", "anchor", *[v.alias(k) for k, v in section_of(F.col("clause")).items()])
    rows = cited.join(sections.select("title", "section", F.col("text").alias("_t")), ["title", "section"], "left")
    flat = F.regexp_replace(F.regexp_replace(F.coalesce("_t", F.lit("")), "<[^>]+>", " "), r"(?U)\s+", " ")  # markers keep their case
    needle = flat_markup(F.col("anchor"))
    has = (F.trim(F.coalesce("anchor", F.lit(""))) != "") & F.contains(flat_markup(F.col("_t")), needle)
    there = F.array_distinct(F.regexp_extract_all(flat, F.lit(r"(\((?:[a-z]{1,2}|[0-9]{1,2}|[ivxlc]{1,5}|[A-Z]{1,2})\))"), F.lit(1)))
    missing = F.array_except("path", there)
    out = rows.select("item_id", F.coalesce(has, F.lit(False)).alias("anchor_present"), missing.alias("markers_missing"), anchor_local(F.col("_t"), F.col("anchor"), F.col("markers")).alias("anchor_local"))
    return out.withColumn("ok", F.col("anchor_present") & (F.size("markers_missing") == 0))


def domain_stats(items: DataFrame) -> DataFrame:
    """(domain, n_items, n_pairs, mean_question_words, n_parts): a pair counts where its role a is."""
    part = F.nullif(F.regexp_extract("clause", r"(\d+)\.", 1), F.lit(""))
    words = F.size(F.filter(F.split("question", r"\s+"), lambda w: w != ""))
    return items.groupBy("domain").agg(F.count("*").alias("n_items"), F.count_if(F.col("pair_role") == "a").alias("n_pairs"), F.avg(words).alias("mean_question_words"), F.count_distinct(part).alias("n_parts"))


def select(items: DataFrame, domains: list[str] | None = None, ids: list | None = None, item_type: str | None = None) -> DataFrame:
    """Items that meet all given conditions; an empty list is no condition."""
    tests = [F.col(c).isin(v) for c, v in (("domain", domains), ("item_id", ids)) if v] + ([F.col("item_type") == item_type] if item_type else [])
    return items.where(reduce(lambda a, b: a & b, tests)) if tests else items


def labels(items: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column (domain, family, id) in order."""
    return items.select(column).distinct().orderBy(column)


def one(items: DataFrame, item_id) -> DataFrame:
    """The item of an id; raises if there is none."""
    found = items.where(F.col("item_id") == item_id)
    if found.isEmpty():
        raise KeyError(item_id)
    return found


def unsourced_numbers(prose: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, number) of numeric tokens of prose (doc_id, text) that no source (text) prints."""
    numeric = lambda df: F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\d+(?:,\d{3})*(?:\.\d+)?)"), F.lit(1)))).alias("number")
    return prose.select("doc_id", numeric(prose)).join(sources.select(numeric(sources)).distinct(), "number", "left_anti").select("doc_id", "number")


def prints_as(value: Column, printed: Column, decimals: Column, scale: float = 1.0) -> Column:
    """Whether a value equals what is printed at the printed precision, after scaling (percent, points)."""
    return F.abs(printed - F.round(value * scale * F.pow(F.lit(10.0), decimals)) / F.pow(F.lit(10.0), decimals)) < 1e-9


def documents(items: DataFrame) -> DataFrame:
    """(doc_id, text): what a retriever indexes of items (id, source), which is the source's names and its excerpt only."""
    parts = [F.coalesce(f"source.{c}", F.lit("")) for c in ("standard", "clause", "section_title", "anchor_text")]
    return items.select(F.col("id").alias("doc_id"), F.concat_ws(" ", *parts).alias("text"))


def export(items: DataFrame) -> DataFrame:
    """(id, json): each item's record as JSON for other tools, nulls left out."""
    return items.select("id", F.to_json(F.struct(*items.columns)).alias("json"))


def answered_from(standard: Column, clause: Column, title: Column, anchor: Column, wrapped: bool = True) -> Column:
    """A retriever's response that quotes an excerpt: with its citation around it, or bare."""
    return F.format_string("%s (%s, %s) states: %s See %s.", standard, clause, title, anchor, clause) if wrapped else anchor


#: Fixed value: where the citation of a wrapped excerpt ends.
STATES = ") states: "


def source_parts(wrapped: Column, anchor: Column) -> Column:
    """(prefix, suffix) of a wrapped excerpt around its anchor; null if either is null.

    The anchor stands behind the end of the citation, since a title may hold its words as well. A wrapper that does not
    hold its anchor there raises.
    """
    at = F.locate(STATES, wrapped)
    start = at + len(STATES)
    fits = (at > 0) & (F.substr(wrapped, start, F.length(anchor)) == anchor)
    trimmed = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    parts = F.struct(trimmed(F.left(wrapped, start - 1)).alias("prefix"), trimmed(F.substr(wrapped, start + F.length(anchor))).alias("suffix"))
    wrong = F.raise_error(F.concat(F.lit("no such excerpt in its wrapper: "), F.left(anchor, F.lit(80)))).cast("struct<prefix: string, suffix: string>")
    return F.when(wrapped.isNotNull() & anchor.isNotNull(), F.when(fits, parts).otherwise(wrong))
