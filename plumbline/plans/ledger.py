"""Queries on ledgers of printed numbers and on records of verification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ledger, provenance
from plumbline.plans.texts import ORACLES as TEXTS_SQL
from plumbline.plans.texts import verifiable
from plumbline.session import table


def _claims(s, d):
    """A table of (lang, source), a JSON file and a text file of each document, and claims on them that are partly wrong."""
    i, n = F.col("doc_id"), F.col("_n")
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_t"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).withColumn("_n", F.length("_t"))
    lines = F.split("_t", "\n")
    blank = lambda x: F.trim(x) == ""
    entry = lambda x: F.struct(F.when(~blank(x), "text").alias("kind"), F.length(x).alias("chars"))
    name = lambda end: F.concat(F.lit("doc-"), i.cast("string"), F.lit(end))
    as_json = F.to_json(F.struct(F.struct(n.alias("chars")).alias("source"), F.transform(lines, entry).alias("lines")))
    as_text = F.concat("_t", F.lit("\n["), n.cast("string"), F.lit(" chars] level 0.95"))
    files = docs.select(F.explode(F.array(F.struct(name(".json").alias("file"), as_json.alias("text")), F.struct(name(".txt").alias("file"), as_text.alias("text")))).alias("_f")).select("_f.*")
    cells = docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("_n").alias("chars")).withColumn("mean", F.col("chars") / F.col("n"))
    tables = cells.select(F.lit("cells.csv").alias("file"), F.create_map(*[x for c in ("lang", "source", "n", "mean") for x in (F.lit(c), F.col(c).cast("string"))]).alias("row"))
    totals = docs.agg(F.count("*").alias("n_docs"), F.count_distinct("lang").alias("n_langs"))  # one row
    counts = totals.select(F.explode(F.create_map(F.lit("n_docs"), F.col("n_docs"), F.lit("n_langs"), F.col("n_langs"))).alias("name", "value"))

    def claim(ident, printed, source, *parts):
        text = lambda x: x.cast("string") if not isinstance(x, str) else F.lit(x)
        return F.struct(F.concat(*map(text, ident)).alias("claim_id"), text(printed).alias("printed"), text(source).alias("source"), F.concat_ws("::", *map(text, parts)).alias("locator"))

    of_docs = F.array(
        claim(("J", i), n + F.when(i % 5 == 0, 1).otherwise(0), name(".json"), "json", name(".json"), "source.chars"),
        claim(("L", i), F.size(F.filter(lines, lambda x: ~blank(x))), F.when(i % 6 == 0, "other.json").when(i % 6 == 1, name(".txt")).otherwise(name(".json")), "jsonlen", name(".json"), "lines?kind=text"),
        claim(("B", i), F.size(F.filter(lines, blank)), name(".json"), "jsonlen", name(".json"), "lines?kind="),
        claim(("F", i), F.length(lines[0]), name(".json"), "json", name(".json"), "lines.0.chars"),
        claim(("G", i), F.concat(n.cast("string"), F.lit(" chars")), name(".txt"), "grep", name(".txt"), F.concat(F.lit("["), n.cast("string"), F.when(i % 7 == 0, " bytes]").otherwise(" chars]"))),
        claim(("P", i), F.when(i % 3 == 0, "95%").when(i % 3 == 1, "5%").otherwise("90%"), name(".txt"), "grep100", name(".txt"), "level 0.95"),
    )
    key, at = F.concat_ws("-", "lang", "source"), F.concat(F.lit("lang="), F.col("lang"), F.lit("&source="), F.col("source"))
    of_cells = F.array(claim(("N-", key), F.col("n"), "cells.csv", "csv", "cells.csv", at, "n"), claim(("X-", key), F.col("chars"), "cells.csv", "csvn", "cells.csv", at, "n*mean"))
    of_langs = F.array(claim(("A-", F.col("lang")), F.col("n"), "cells.csv", "csv", "cells.csv", F.concat(F.lit("lang="), F.col("lang")), "n"))
    of_all = F.array(
        claim(("D1",), F.col("n_docs"), "cells.csv", "corpus", "n_docs"), claim(("D2",), F.col("n_langs") + 1, "cells.csv", "corpus", "n_langs"), claim(("K1",), F.format_string("%.4f", F.pow(F.lit(0.025), 1 / F.col("n_docs"))), "cells.csv", "cp", "lo", "D1", "D1"),
        claim(("K2",), "0.5", "cells.csv", "cp", "hi", "D1", "D9"), claim(("E",), F.col("n_docs"), "cells.csv", "corpus", "n_docs"), claim(("E",), F.col("n_docs"), "cells.csv", "unknown", "n_docs"),
    )
    made = [df.select(F.explode(c).alias("_c")).select("_c.*") for df, c in ((docs, of_docs), (cells, of_cells), (cells.groupBy("lang").agg(F.sum("n").alias("n")), of_langs), (totals, of_all))]
    return reduce(DataFrame.unionByName, made), tables, files, counts


def _ledger(s, d):
    rows = ledger.check(ledger.resolve(*_claims(s, d)))
    return rows.select("claim_id", "kind", F.round("value", 6).alias("value"), F.concat_ws(",", "problems").alias("problems"))


def _coverage(s, d):
    claims = table(s, d, "documents").select(F.concat(F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit(" pts")).alias("printed"))
    return ledger.coverage(table(s, d, "documents").select("doc_id", "text"), claims)


def _record(s, d):
    """A record of an older corpus, in which every fifth anchor was another, brought up to date."""
    items, sections = verifiable(s, d)
    i = F.col("item_id")
    lone = items.where(i % 10 < 2).select((-1 - i).alias("item_id"), F.when(i % 10 == 0, "no clause").otherwise(F.concat(F.lit("29 CFR 1926."), i.cast("string"))).alias("clause"), F.lit("x").alias("anchor"))
    now = items.unionByName(lone)
    before = now.withColumn("anchor", F.when(i % 5 == 0, "an older anchor").otherwise(F.col("anchor")))
    manifest = sections.select("title", "section", F.md5("text").alias("digest"))
    read = lambda keys: sections.join(keys, ["title", "section"], "left_semi")
    first = provenance.reverify(before, manifest, read)
    return provenance.reverify(now, manifest, read, first)


QUERIES = {
    "claim_ledger": _ledger,
    "number_coverage": _coverage,
    "verify_report": lambda s, d: provenance.totals(_record(s, d)),
}

ORACLES = {
    "claim_ledger": r"""WITH t AS (SELECT doc_id AS i, coalesce(text, '') AS x, coalesce(lang, '') AS lang, coalesce(source, '') AS source, length(coalesce(text, '')) AS n FROM documents),
d AS (SELECT *, str_split(x, chr(10)) AS ls FROM t),
m AS (SELECT *, len(list_filter(ls, lambda y: trim(y) <> '')) AS nt, len(list_filter(ls, lambda y: trim(y) = '')) AS nb FROM d),
g AS (SELECT lang, source, count(*) AS n, sum(n) AS chars FROM d GROUP BY ALL), a AS (SELECT lang, sum(n) AS n, count(*) AS rows FROM g GROUP BY ALL), c AS (SELECT count(*) AS n, count(DISTINCT lang) AS l FROM d)
SELECT 'J' || i AS claim_id, 'json' AS kind, n::DOUBLE AS value, CASE WHEN i % 5 = 0 THEN 'printed_differs' ELSE '' END AS problems FROM m
UNION ALL SELECT 'L' || i, 'jsonlen', CASE WHEN i % 6 <> 0 THEN nt::DOUBLE END, CASE i % 6 WHEN 0 THEN 'missing_source' WHEN 1 THEN 'source_differs' ELSE '' END FROM m
UNION ALL SELECT 'B' || i, 'jsonlen', nb::DOUBLE, '' FROM m
UNION ALL SELECT 'F' || i, 'json', length(ls[1])::DOUBLE, '' FROM m
UNION ALL SELECT 'G' || i, 'grep', NULL, CASE WHEN i % 7 = 0 THEN 'unresolved' ELSE '' END FROM m
UNION ALL SELECT 'P' || i, 'grep100', NULL, CASE WHEN i % 3 = 2 THEN 'printed_differs' ELSE '' END FROM m
UNION ALL SELECT 'N-' || lang || '-' || source, 'csv', n::DOUBLE, '' FROM g
UNION ALL SELECT 'X-' || lang || '-' || source, 'csvn', chars::DOUBLE, '' FROM g
UNION ALL SELECT 'A-' || lang, 'csv', CASE WHEN rows = 1 THEN n::DOUBLE END, CASE WHEN rows = 1 THEN '' ELSE 'unresolved' END FROM a
UNION ALL SELECT 'D1', 'corpus', n::DOUBLE, '' FROM c
UNION ALL SELECT 'D2', 'corpus', l::DOUBLE, 'printed_differs' FROM c
UNION ALL SELECT 'K1', 'cp', round(pow(0.025, 1.0 / n), 6), '' FROM c
UNION ALL SELECT 'K2', 'cp', NULL, 'unresolved' FROM c
UNION ALL SELECT 'E', 'corpus', n::DOUBLE, 'duplicate_id' FROM c
UNION ALL SELECT 'E', 'unknown', NULL, 'duplicate_id,unresolved' FROM c""",
    "number_coverage": r"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)```.*?```', ' ', 'g'), '(?m)^#+ .*$', ' ', 'g'), '(?m)^\d+\. ', ' ', 'g'),
  '\b\d{4}-\d{2}-\d{2}\b', ' ', 'g'), '\b(19|20)\d{2}\b', ' ', 'g'), '\b(Table|Section|Sections|Appendix|Figure)\s+\d+\w*', ' ', 'g') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(x, '(?:^|[^A-Za-z\d.])(\d+(?:\.\d+)?)', 1)) AS number FROM p), n AS (SELECT number, count(*) AS n_docs FROM s GROUP BY ALL),
c AS (SELECT coalesce(n_chars, 0)::VARCHAR AS number, count(*) AS n_claims FROM documents GROUP BY ALL)
SELECT number, coalesce(n_docs, 0) AS n_docs, coalesce(n_claims, 0) AS n_claims, CASE WHEN n_claims IS NULL AND number NOT IN ('0', '1') THEN 'unsourced' WHEN n_docs IS NULL THEN 'unused' END AS problem FROM n FULL JOIN c USING (number)""",
    "verify_report": f"""WITH v AS ({TEXTS_SQL["verify_sources"]}), e AS (SELECT count(*) FILTER (doc_id % 10 = 0) AS unparsed, count(*) FILTER (doc_id % 10 = 1) AS missing FROM documents)
SELECT count(*) + any_value(unparsed) + any_value(missing) AS n_items, count(*) + any_value(missing) AS n_checked, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) + any_value(missing) AS n_failed, any_value(unparsed) AS n_unparsed,
  count(*) FILTER (NOT anchor_local) AS n_warnings, count(DISTINCT item_id) AS n_sections, any_value(missing) AS n_section_errors FROM v, e""",
}
