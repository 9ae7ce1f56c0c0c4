"""Which of many phrases occur in which of many texts, without trying every phrase on every text.

A phrase is looked for only in texts that hold its longest run of letters and digits. Inside a phrase such a run is a
whole run of the text too; one that ends the phrase is the beginning of one, since phrases match the beginnings of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = r"([a-z0-9]+)"
#: How much of a phrase's last run is looked up, the rest being left to the pattern.
BEGINNING = 6


def folded(phrase: Column) -> Column:
    """A phrase in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(phrase), r"\s+", " "))


def key(phrase: Column) -> Column:
    """What a text must hold for the phrase to occur in it: a whole run, the beginning of one, or '' (nothing to look up)."""
    plain = folded(phrase)
    runs = F.regexp_extract_all(plain, F.lit(RUN), F.lit(1))
    opens = plain.rlike("[a-z0-9]$")
    # the longest run; of equals a whole one, then the first
    named = F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (~opens | (i < F.size(runs) - 1)).alias("whole"), (-i).alias("at"), r.alias("run")))
    best = F.array_max(named)
    return F.when(F.size(runs) == 0, "").otherwise(F.when(best["whole"], F.concat(F.lit("="), best["run"])).otherwise(F.concat(F.lit("^"), F.left(best["run"], F.lit(BEGINNING)))))


def keys_of(normal: Column) -> Column:
    """All keys that a normal text meets, each once."""
    runs = F.array_distinct(F.regexp_extract_all(normal, F.lit(RUN), F.lit(1)))
    begins = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.least(F.length(r), F.lit(BEGINNING))), lambda k: F.concat(F.lit("^"), F.left(r, k)))))
    return F.concat(F.array(F.lit("")), F.transform(runs, lambda r: F.concat(F.lit("="), r)), F.array_distinct(begins))


def occurrences(texts: DataFrame, ids: list[str], phrases: DataFrame, pattern, asserted_pattern) -> DataFrame:
    """(*ids, phrase, asserted) of every phrase that occurs in a normal text; a blank or null phrase never does.

    texts: ids and normal, one row an id; read twice, so let it be a table. phrases: (phrase), repeats do not matter.
    ``pattern`` and ``asserted_pattern`` give a phrase's patterns as columns. Pairs of an id and a phrase meet the text
    once, and only for the phrases whose key the text holds; texts themselves are not multiplied.
    """
    some = phrases.select("phrase").where(F.trim(F.coalesce("phrase", F.lit(""))) != "").distinct()
    looked = some.withColumn("_k", key(F.col("phrase")))
    held = texts.select(*ids, F.explode(keys_of(F.col("normal"))).alias("_k"))
    near = held.join(looked, "_k").drop("_k")
    rows = near.join(texts.select(*ids, "normal"), ids).withColumns({"_m": pattern(F.col("phrase")), "_a": asserted_pattern(F.col("phrase"))})
    hit = rows.where(F.rlike("normal", F.col("_m")))
    return hit.select(*ids, "phrase", F.rlike("normal", F.col("_a")).alias("asserted"))
