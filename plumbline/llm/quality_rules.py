"""Quality rules as a short-circuit cascade.

Every rule is a native boolean expression that says whether a document is rejected. A bounded sample of the rows past
the base thresholds gives each rule's cost (time to evaluate it there, repeatedly) and which rows it rejects; the
cascade then takes, again and again, the rule that rejects most of the rows still standing per second of cost. The cascade is one CASE expression:
Spark evaluates a branch only when all branches before it were false, so later (dear) rules run on survivors only.
The order never changes a verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.draw import drawn
from plumbline.llm.scratch import Table
from plumbline.llm.words import words

#: Rows from which cost and selectivity are estimated, about; they decide only the order of the rules.
SAMPLE_ROWS = 512
#: How often a job asks a rule about each of them, how many jobs are timed, and the least cost of a rule in seconds a row.
REPEATS, TIMES, LEAST_COST = 2, 2, 1e-5
#: Rejections per cost that differ by less count as equal, since clocks are not exact.
NEAR = 1.5

#: Base thresholds.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the text column and the base features to a boolean that is never null."""

    name: str
    rejects: Callable[[Column, dict[str, Column]], Column]


def _count(text: Column, drop: str) -> Column:
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


RULES = [
    Rule("symbol_ratio", lambda t, f: f["n_symbols"] * 10 > f["n_words"]),
    Rule("word_length", lambda t, f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 12 * f["n_words"])),
    Rule("duplicate_lines", lambda t, f: (f["n_dup_lines"] >= 3) & (f["n_dup_lines"] * 10 > 3 * F.size(_lines(t)))),
    Rule("few_letter_words", lambda t, f: F.regexp_count(t, F.lit(r"\p{L}[^\x20\x09-\x0D]*")) * 10 < 7 * f["n_words"]),
    Rule("shouting", lambda t, f: _count(t, r"\P{Lu}+") * 2 > _count(t, r"\P{L}+")),
    Rule("exclamations", lambda t, f: _count(t, "[^!?]+") * 10 > 3 * f["n_words"]),
    Rule("ellipsis_lines", lambda t, f: (t.contains("...") | t.contains("…")) & (F.size(F.filter(_lines(t), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))) * 10 > 3 * F.size(_lines(t)))),
]

#: Positions covered by a 3-word window that occurs twice or more: windows are sorted by hash, equal neighbours are
#: repeats, and their start positions, sorted, are summed as a union of intervals of three. The array(...)-transform
#: pairs bind a value once; an outer expression inside a lambda would be evaluated for each element.
REPEAT_WORDS = """
element_at(transform(array({words}), w ->
  element_at(transform(array(sort_array(transform(sequence(0, greatest(size(w) - 3, 0)), i ->
      named_struct('h', xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), 'p', i)))), s ->
    aggregate(
      sort_array(transform(filter(s, (x, k) -> size(w) > 3 AND (x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h)), x -> x.p)),
      named_struct('total', 0L, 'last', -3),
      (a, p) -> named_struct('total', a.total + least(3, p - a.last), 'last', p),
      a -> a.total)), 1)), 1)
"""


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with word_chars, n_symbols, n_dup_lines, n_repeat_words and n_words (long), all over whole texts.

    The 3-word windows are compared by 64-bit hash within one document. Null text counts as empty: all zero.
    Columns of those names in ``docs`` are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    held = docs.withColumn("_words", words(t)).withColumn("_lines", _lines(t))
    return held.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": _count(t, f"[^{SYMBOLS}]+"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.expr(REPEAT_WORDS.format(words="_words")),
        }
    ).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def _verdicts(text: str, rules: list[Rule]) -> list[Column]:
    t = F.coalesce(F.col(text), F.lit(""))
    named = {k: F.col(k) for k in FEATURES}
    return [F.coalesce(r.rejects(t, named), F.lit(False)).alias(r.name) for r in rules]


def sample(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows (text and base features) drawn by the hash of their place, so from all partitions alike.

    Only rows that pass the base are in it, as the cascade asks its rules about no others.
    """
    texts = drawn(docs, rows, docs.count(), F.monotonically_increasing_id(), F.lit("sample")).select(F.col(text).alias("text"))
    return features(texts).where(~base_failed())


def estimate(sampled: DataFrame, rules: list[Rule], text: str = "text") -> list[tuple[str, float, float]]:
    """(name, seconds a row, share of the sample that it rejects) in cascade order, best rejection per cost first.

    ``sampled`` holds the base features as columns, so a rule is charged with its own work only. A rule's cost is the
    least time of TIMES jobs, each of which asks it REPEATS times about every row, above that of a job that asks for
    the text's length; rules take turns, so that all meet the same state of the machine. Shares are conditional: each
    counts the rows that no earlier rule rejects. Of rules whose rejection per cost differs by less than NEAR times,
    and of those that reject nothing, the one named first goes first. An empty sample keeps the given order. The
    driver gets one row a rule.
    """
    columns = dict(zip([r.name for r in rules], _verdicts(text, rules), strict=True))
    held = Table(sampled.select(text, *FEATURES), "quality-sample")
    n = held.df.count()
    again = held.df.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("_again"))
    asked = {"": F.length(text) < F.col("_again")} | columns
    took = dict.fromkeys(asked, float("inf"))
    for _ in range(TIMES if n else 0):
        for name, column in asked.items():
            began = time.perf_counter()
            again.agg(F.count_if(column)).collect()
            took[name] = min(took[name], time.perf_counter() - began)
    cost = {r.name: max((took[r.name] - took[""]) / (n * REPEATS), LEAST_COST) if n else LEAST_COST for r in rules}
    left, order, standing = list(rules), [], F.lit(True)
    while left:
        counts = held.df.where(standing).agg(*[F.count_if(columns[r.name]).alias(r.name) for r in left]).first()
        worth = {r.name: counts[r.name] / cost[r.name] for r in left}
        best = next(r for r in left if worth[r.name] * NEAR >= max(worth.values()))
        order.append((best.name, cost[best.name], counts[best.name] / max(n, 1)))
        standing = standing & ~columns[best.name]
        left.remove(best)
        if not any(counts):
            order += [(r.name, cost[r.name], 0.0) for r in left]
            break
    held.drop()
    return order


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base features, base_failed, kept and rejected_by (base, the first rule that rejects, or null).

    Rows stay as they are: repeated rows and ids are judged each for itself; null or blank text fails the base
    (fewer than 50 words). An empty table gives an empty table. rejected_by names the first rule in this run's
    order, so it may differ between runs where several rules reject; kept never does.
    """
    rules = RULES if rules is None else rules
    featured = features(docs, text)
    by_name = {r.name: r for r in rules}
    ordered = [by_name[name] for name, _, _ in estimate(sample(docs, text, sample_rows), rules)]
    cascade = F.when(base_failed(), F.lit("base"))
    for rule, rejects in zip(ordered, _verdicts(text, ordered), strict=True):
        cascade = cascade.when(rejects, F.lit(rule.name))
    return featured.withColumn("base_failed", base_failed()).withColumn("rejected_by", cascade).withColumn("kept", F.col("rejected_by").isNull())


def op1_query(docs: DataFrame) -> DataFrame:
    out = judge(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) AS v(o) GROUP BY r),
f AS (SELECT doc_id, t, ws, ls, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.r = cov.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR (n_dup_lines >= 3 AND n_dup_lines * 10 > 3 * len(ls))
    OR len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) * 10 < 7 * n_words
    OR length(regexp_replace(t, '\P{Lu}+', '', 'g')) * 2 > length(regexp_replace(t, '\P{L}+', '', 'g'))
    OR length(regexp_replace(t, '[^!?]+', '', 'g')) * 10 > 3 * n_words
    OR len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$'))) * 10 > 3 * len(ls)) AS kept
FROM b
"""
