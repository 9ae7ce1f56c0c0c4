"""A ledger of printed numbers: each claim names its source and a locator, which is resolved and compared as printed.

Claims are (claim_id, printed, source, locator); a locator's parts stand between ``::``:

=========  ==========================  =====================================================================
kind       parts                       value
=========  ==========================  =====================================================================
csv        file, a=x&b=y, column       the column of the one row where all conditions hold
csvn       file, a=x&b=y, c*d          the product of two of its columns, as a whole number
json       file, dotted.path           the number at the path; whole numbers in it are places of a list
jsonlen    file, path or path?key=x    how many entries the list has, or has with that value ('' also: without key)
corpus     name                        a count of the corpus
grep       file, literal               the literal must stand in the file; it must hold all printed numbers
grep100    file, literal               as grep, for 100 times a decimal of the literal, or what that lacks to 100
cp         lo or hi, id, id            bound of the exact 95% interval of one claim's value in another's
=========  ==========================  =====================================================================
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import scratch
from plumbline.operators.significance import clopper_pearson

#: How a number and a printed value look.
NUMBER = r"((?<![A-Za-z\d.])\d+(?:\.\d+)?)"
PRINTED = r"^([+-]?\d+(?:\.(\d+))?)(%| pts)?$"

#: What prose holds that is no claim. Code, headings, list markers, dates, years, numbered parts.
NO_CLAIM = [
    r"(?s)```.*?```",
    r"(?m)^#+ .*$",
    r"(?m)^\d+\. ",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b(19|20)\d{2}\b",
    r"\b(Table|Section|Sections|Appendix|Figure)\s+\d+\w*",
]
#: Numbers that need no source.
TRIVIAL = ["0", "1"]

IN_CELLS, IN_TEXTS = ["csv", "csvn"], ["json", "jsonlen", "grep", "grep100"]


def numbers(text: Column) -> Column:
    """All numeric tokens of a text, as they are printed; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(1))


def prose_numbers(text: Column) -> Column:
    """Numeric tokens of prose, without what is no claim."""
    return numbers(reduce(lambda t, pattern: F.regexp_replace(t, pattern, " "), NO_CLAIM, F.coalesce(text, F.lit(""))))


def matches(printed: Column, value: Column) -> Column:
    """Whether a value is printed right at the printed precision; percents and points are hundredths, ties go to even."""
    shown = F.trim(printed)
    scale = F.pow(F.lit(10.0), F.length(F.regexp_extract(shown, PRINTED, 2)))
    scaled = value * F.when(F.regexp_extract(shown, PRINTED, 3) != "", 100.0).otherwise(1.0)
    told = F.nullif(F.regexp_extract(shown, PRINTED, 1), F.lit("")).try_cast("double")
    return F.coalesce(F.abs(told - F.bround(scaled * scale) / scale) < 1e-9, F.lit(False))


def _holds(printed: Column, literal: Column) -> Column:
    """Whether a literal has all printed numbers."""
    return F.forall(numbers(printed), lambda t: F.array_contains(numbers(literal), t))


def _holds_hundredths(printed: Column, literal: Column) -> Column:
    """Whether each printed number, in its shortest form, is 100 times a decimal x of the literal, or 100 times 1 - x."""
    decimals = F.transform(F.filter(numbers(literal), lambda t: F.contains(t, F.lit("."))), lambda t: t.cast("double"))
    near = lambda t, x: F.abs(t.cast("double") - F.round(x * 100, 6)) < 1e-9
    short = lambda t: ~F.rlike(t, F.lit(r"\.\d*0$|^0\d"))
    return F.forall(numbers(printed), lambda t: short(t) & F.exists(decimals, lambda x: near(t, x) | near(t, 1 - x)))


def _parsed(claims: DataFrame) -> DataFrame:
    parts = F.split(F.coalesce("locator", F.lit("")), "::")
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    return claims.select("claim_id", "printed", "source", "locator", part(0).alias("kind"), part(1).alias("file"), part(2).alias("where"), part(3).alias("column"))


def _from_cells(claims: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows are counted by the values of just those columns that some claim on their file asks for, before they meet claims.

    So a value that many rows share is one row of the join, whatever the claims on it; a row is used only if it is alone.
    """
    conditions = F.transform(F.array_sort(F.filter(F.split("where", "&"), lambda p: p != "")), lambda p: F.split(p, "=", 2))
    keyed = claims.withColumns({"_keys": F.transform(conditions, lambda c: c[0]), "_values": F.transform(conditions, lambda c: F.coalesce(F.get(c, F.lit(1)), F.lit("")))})
    asked = keyed.select("file", "_keys").distinct()
    rows = tables.join(asked, "file").withColumn("_values", F.transform("_keys", lambda k: F.try_element_at("row", k)))
    alone = rows.groupBy("file", "_keys", "_values").agg(F.count("*").alias("_n"), F.first("row").alias("_row")).where("_n = 1")
    hit = keyed.join(alone, ["file", "_keys", "_values"], "left")
    number = lambda name: F.try_element_at("_row", name).try_cast("double")
    product = number(F.substring_index("column", "*", 1)) * number(F.substring_index("column", "*", -1))
    return hit.withColumn("value", F.when(F.col("kind") == "csv", number(F.col("column"))).otherwise(F.bround(product))).withColumn("literal", F.lit(None).cast("string")).select(*claims.columns, "value", "literal")


def _from_texts(claims: DataFrame, files: DataFrame) -> DataFrame:
    """Each claim meets its file's text once and keeps a number or a literal of it, not the text."""
    hit = claims.join(files.select("file", F.col("text").alias("_t")), "file", "left")
    ask = F.split("where", r"\?", 2)
    path, rule = F.get(ask, F.lit(0)), F.split(F.get(ask, F.lit(1)), "=", 2)
    places = F.regexp_replace(F.concat(F.lit("."), path), r"\.(\d+)(?=\.|$)", "[$1]")
    got = F.call_function("get_json_object", F.col("_t"), F.concat(F.lit("$"), places))
    entries = F.from_json(got, "array<map<string, string>>")
    wanted = F.coalesce(F.get(rule, F.lit(1)), F.lit(""))
    of = lambda m: F.coalesce(F.try_element_at(m, F.get(rule, F.lit(0))), F.lit(""))
    length = F.when(F.size(ask) == 1, F.json_array_length(got)).when(entries.isNotNull(), F.size(F.filter(entries, lambda m: of(m) == wanted)))
    value = F.when(F.col("kind") == "json", got.try_cast("double")).when(F.col("kind") == "jsonlen", length.cast("double"))
    literal = F.when(F.col("kind").startswith("grep") & F.contains("_t", F.col("where")), F.col("where"))
    return hit.withColumns({"value": value, "literal": literal}).select(*claims.columns, "value", "literal")


def resolve(claims: DataFrame, tables: DataFrame, files: DataFrame, counts: DataFrame) -> DataFrame:
    """Claims with kind, value and literal, both null where the locator leads to nothing or to more than one row.

    tables: (file, row), row a map of a table row's columns to text. files: (file, text), one row a file. counts:
    (name, value) of the corpus. A claim of kind cp reads claims of other kinds, by ids that stand for one row each.
    A source of which there is no row in tables or files is missing, and its claim is not resolved.
    """
    paths = tables.select("file").union(files.select("file")).distinct().withColumnRenamed("file", "source")
    rows = scratch.saved(_parsed(claims).join(paths.withColumn("has_source", F.lit(True)), "source", "left"), "claims")
    there, none = rows.where("has_source"), F.lit(None)
    cells = _from_cells(there.where(F.col("kind").isin(IN_CELLS)), tables)
    texts = _from_texts(there.where(F.col("kind").isin(IN_TEXTS)), files)
    of_corpus = there.where("kind = 'corpus'").join(counts.select(F.col("name").alias("file"), F.col("value").cast("double")), "file", "left").withColumn("literal", none.cast("string"))
    known = scratch.saved(cells.unionByName(texts).unionByName(of_corpus), "resolved")
    single = known.groupBy("claim_id").agg(F.count("*").alias("_n"), F.max("value").alias("_v")).where("_n = 1").drop("_n")
    bounds = there.where("kind = 'cp'")
    for at, name in (("where", "_k"), ("column", "_m")):
        bounds = bounds.join(single.select(F.col("claim_id").alias(at), F.col("_v").cast("long").alias(name)), at, "left")
    sound = F.coalesce((F.col("_k") >= 0) & (F.col("_k") <= F.col("_m")) & (F.col("_m") > 0), F.lit(False))
    bounds = bounds.withColumn("_sound", sound).withColumns({"_k": F.when(F.col("_sound"), F.col("_k")).otherwise(0), "_m": F.when(F.col("_sound"), F.col("_m")).otherwise(1)})
    bounds = bounds.withColumn("_ci", clopper_pearson("_k", "_m"))
    bound = F.when(F.col("_sound"), F.when(F.col("file") == "lo", F.col("_ci.low")).when(F.col("file") == "hi", F.col("_ci.high")))
    bounds = bounds.withColumns({"value": bound, "literal": none.cast("string")}).select(known.columns)
    done = [*IN_CELLS, *IN_TEXTS, "corpus", "cp"]
    rest = rows.where(F.col("has_source").isNull() | ~F.col("kind").isin(done)).withColumns({"value": none.cast("double"), "literal": none.cast("string")})
    out = known.unionByName(bounds).unionByName(rest)
    return out.select("claim_id", "printed", "source", "locator", "kind", F.coalesce("has_source", F.lit(False)).alias("has_source"), "value", "literal")


def check(resolved: DataFrame) -> DataFrame:
    """Resolved claims with their problems, an empty array where there are none, in this order:

    duplicate_id (on every row of the id), missing_source, unresolved, printed_differs, source_differs (the locator
    reads another file than the source). A missing source or an unresolved locator ends the list.
    """
    again = resolved.groupBy("claim_id").agg(F.count("*").alias("_n")).where("_n > 1")
    rows = resolved.join(again, "claim_id", "left")
    held = F.when(F.col("kind") == "grep", _holds(F.col("printed"), F.col("literal"))).when(F.col("kind") == "grep100", _holds_hundredths(F.col("printed"), F.col("literal"))).otherwise(matches(F.col("printed"), F.col("value")))
    nothing = F.col("value").isNull() & F.col("literal").isNull()
    other = F.col("kind").isin([*IN_CELLS, *IN_TEXTS]) & ~F.contains("locator", F.col("source"))
    found = F.array(
        F.when(F.col("_n").isNotNull(), F.lit("duplicate_id")), F.when(~F.col("has_source"), F.lit("missing_source")), F.when(F.col("has_source") & nothing, F.lit("unresolved")),
        F.when(F.col("has_source") & ~nothing & ~held, F.lit("printed_differs")), F.when(F.col("has_source") & ~nothing & other, F.lit("source_differs")),
    )
    return rows.withColumn("problems", F.array_compact(found)).drop("_n", "has_source")


def coverage(prose: DataFrame, claims: DataFrame) -> DataFrame:
    """(number, n_docs, n_claims, problem) of all numbers of prose (doc_id, text) and of claims (printed), both ways.

    ``unsourced`` numbers stand in prose and no claim prints them, trivial ones apart; ``unused`` ones are printed by
    claims only; the rest have a null problem. Numbers are compared as printed.
    """
    each = lambda df, tokens, name: df.select(F.explode(F.array_distinct(tokens)).alias("number")).groupBy("number").agg(F.count("*").alias(name))
    both = each(prose, prose_numbers(F.col("text")), "n_docs").join(each(claims, numbers(F.col("printed")), "n_claims"), "number", "full_outer").na.fill(0, ["n_docs", "n_claims"])
    lone = (F.col("n_claims") == 0) & ~F.col("number").isin(TRIVIAL)
    return both.withColumn("problem", F.when(lone, "unsourced").when(F.col("n_docs") == 0, "unused"))
