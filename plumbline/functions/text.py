"""Text columns: normal form, phrases with boundaries, contrast, numbers, tokens. All JVM-side but the NFKC step."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters replaced before anything is compared.
CHARACTERS = {
    "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ",
    "°": " degrees ", "º": " degrees ", "⁄": "/", "﻿": "", "­": "", "§": " section ",
}
#: Cues that turn a mention after them into a contrast.
CONTRAST_CUES = [
    "unlike", "not a", "not an", "is not", "are not", "does not", "do not", "cannot", "no such", "rather than", "instead of", "as opposed to", "whereas", "in contrast", "by contrast",
    "differs from", "different from", "would be wrong", "incorrect to", "there is no", "has no", "have no", "without a", "never",
]
CONTRAST_WINDOW = 70
#: Cues of a response that declines, and cues that it commits to an answer after all.
ABSTENTION_CUES = [
    "i don't know", "i do not know", "i cannot answer", "i can't answer", "i am unable to answer", "i'm unable to answer", "unable to determine", "cannot determine", "cannot confirm",
    "unable to confirm", "not able to verify", "cannot verify", "i do not have access", "i don't have access", "no verified source", "would need to check", "you should consult",
    "consult the standard", "refer to the standard directly", "declin", "insufficient information", "not enough information", "i am not able to provide", "i'm not able to provide",
]
COMMITMENT_CUES = ["but the", "but it is", "however, the", "that said, the", "the answer is", "the requirement is", "the interval is", "the correct answer", "typically", "generally it is", "in most cases it is"]
LEAST_ANSWER = 3

#: Every Unicode space that a normal form collapses; Java's \s alone is ASCII.
SPACE = r"(?U)\s+"
TOKEN = r"([a-z0-9]+(?:\.[0-9]+)*)"
DIGITS = r"(?U)(?<![\w.])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"


#: Texts that a worker holds as Python strings at once.
ROWS_AT_ONCE = 128


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    """NFKC, a few texts of the batch at a time."""
    made = []
    for k in range(0, len(texts), ROWS_AT_ONCE):
        own = texts.slice(k, ROWS_AT_ONCE).to_pylist()
        made.append(pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in own], texts.type))
    return pa.concat_arrays(made) if made else texts


def fold(text: Column) -> Column:
    """Normal form of text that is NFKC already: characters replaced, lower case, single spaces; null is empty."""
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), CHARACTERS.items(), F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.lower(out), SPACE, " "))


def normalized(df: DataFrame, text: str, into: str = "normal") -> DataFrame:
    """``df`` with the normal form of a column. Only rows with a character beyond ASCII pass through Python for NFKC."""
    wide = F.coalesce(F.col(text).rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = df.where(~wide).withColumn(into, fold(F.col(text)))
    return plain.unionByName(df.where(wide).withColumn(into, fold(_nfkc(F.col(text)))))


def phrase_pattern(phrase: str) -> str:
    """Java pattern of a phrase: no letter or digit before it, and none after a closing digit; letters prefix-match."""
    words = " ".join(phrase.lower().split()).split(" ")
    return r"(?<![a-z0-9])" + r"\s+".join(re.escape(w) for w in words) + (r"(?![0-9])" if words[-1][-1:].isdigit() else "")


def contains(text: Column, phrase: str) -> Column:
    """Whether a phrase occurs in normal text; a blank phrase never does."""
    return text.rlike(phrase_pattern(phrase)) if phrase.strip() else F.lit(False)


def phrase_spans(text: Column, phrase: str) -> Column:
    """[(start, end)] of a phrase's occurrences in normal text, from 0, ends exclusive; a blank phrase or null text has none."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    if not phrase.strip():
        return none
    pattern = phrase_pattern(phrase)
    # the text between and the occurrences alternate, so running lengths are the spans
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(held: Column, pair: Column) -> Column:
        begin = held["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        return F.struct(end.alias("at"), F.concat(held["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("spans"))

    pairs = F.transform(found, lambda hit, i: F.struct(F.get(between, i).alias("gap"), hit.alias("hit")))
    return F.coalesce(F.aggregate(pairs, start, step, lambda held: held["spans"]), none)


def contains_any(text: Column, phrases: list[str]) -> Column:
    """One pattern for all phrases, compiled once a task."""
    some = [phrase_pattern(p) for p in phrases if p.strip()]
    return text.rlike("|".join(some)) if some else F.lit(False)


def asserted(text: Column, phrase: str, cues: list[str] | None = None, window: int = CONTRAST_WINDOW) -> Column:
    """Whether a phrase occurs with no cue wholly inside the window before it.

    The cheap boundary match comes first, so the bounded lookbehind runs on hits only.
    """
    if not phrase.strip():
        return F.lit(False)
    cues = [c for c in (CONTRAST_CUES if cues is None else cues) if len(c) <= window]
    behind = "|".join(f"{re.escape(c)}.{{0,{window - len(c)}}}" for c in cues)
    plain = phrase_pattern(phrase)
    return F.when(text.rlike(plain), text.rlike(f"(?<!{behind}){plain}") if cues else F.lit(True)).otherwise(F.lit(False))


def any_asserted(text: Column, phrases: list[str], cues: list[str] | None = None) -> Column:
    """Sorted array of the phrases that are asserted."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(asserted(text, p, cues), F.lit(p)) for p in phrases]), lambda x: x.isNotNull())))


#: Names of the whole numbers below twenty and of the tens, and the hundreds that are read.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
HUNDREDS = {"1 hundred": 100.0, "2 hundred": 200.0, "3 hundred": 300.0, "5 hundred": 500.0, "one hundred": 100.0, "one hundred twenty": 120.0, "one hundred eighty": 180.0}


def spelled(n: int, join: str = "-") -> str:
    """A whole number below 100 in words; ``join`` stands between ten and unit."""
    ten, unit = divmod(n, 10)
    if n < len(SMALL):
        return SMALL[n]
    return TENS[ten - 2] + (join + SMALL[unit] if unit else "")


def number_words() -> dict[str, float]:
    """Spelled whole numbers 0-99 with hyphen or space, and the hundreds that are read; "two hundred" reads as 2."""
    return {spelled(n, join): float(n) for n in range(100) for join in "- "} | HUNDREDS


def numbers(text: Column) -> Column:
    """Array of all numbers in normal text: digits first, then spelled ones."""
    words = number_words()
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    pattern = r"(?U)(?<![\w-])(" + "|".join(sorted(map(re.escape, words), key=len, reverse=True)) + r")(?![\w-])"
    digits = F.transform(F.regexp_extract_all(text, F.lit(DIGITS), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    return F.concat(digits, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.element_at(table, x)))


def has_number(text: Column, target: float, tolerance: float = 0.0) -> Column:
    return F.exists(numbers(text), lambda v: F.abs(v - target) <= tolerance)


def number_variants(value: Column) -> Column:
    """Plain renderings of a number: with and without comma groups if whole, else without closing zeros."""
    whole = value == F.floor(value)
    plain = value.cast("decimal(38,0)").cast("string")
    fine = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")
    return F.when(whole, F.array_distinct(F.array(plain, F.format_number(value, 0)))).otherwise(F.array(fine))


def tokens(text: Column) -> Column:
    """Array of lower-case words and dotted numbers."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def abstention(normal: Column) -> tuple[Column, Column]:
    """(empty, abstained): too short to be an answer; a declining cue without a committing one."""
    empty = F.length(normal) < LEAST_ANSWER
    return empty, ~empty & contains_any(normal, ABSTENTION_CUES) & ~contains_any(normal, COMMITMENT_CUES)


def answer_parts(reply: Column) -> dict[str, Column]:
    """(answer, citation, declined) of a reply in ``ANSWER:`` and ``CITATION:`` lines; without them the whole is the answer."""
    raw = F.coalesce(reply, F.lit(""))
    line = lambda name: rf"(?is){name}\s*:\s*(.*?)(?:\n|$)"
    pick = lambda name: F.when(raw.rlike(line(name)), F.trim(F.regexp_extract(raw, line(name), 1)))
    answer, cited = F.coalesce(pick("answer"), F.trim(raw)), pick("citation")
    none = F.lower(cited).isin("none", "n/a", "none.", "n/a.") | (cited == "")
    declined = F.regexp_replace(F.lower(answer), r"\.+$", "").isin("i don't know", "i do not know", "unknown")
    return {"answer": answer, "citation": F.when(~none, cited), "declined": (answer != "") & declined}


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


#: What is made plain in section text, one after the other. A long dash stays as it is.
MARKUP = [
    ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("–", "-"), (" - ", "-"), ("−", "-"), ("\u00a0", " "),
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), (" - ", "-"), ("&#8217;", "'"),
]


def flat_markup(text: Column) -> Column:
    """Tags out, quotes and dashes plain, entities read, lower case, single spaces: for matching in section text."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    for bad, good in MARKUP:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.lower(F.trim(F.regexp_replace(out, SPACE, " ")))
