"""The ordered outcome classifier over (item, response) rows with nested answer keys.

Key phrases are data, so a phrase meets a text as a column-valued pattern: phrases of a key are compiled to patterns
once, when keys are loaded, and the dear asserted check runs on boundary hits only.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import scratch
from plumbline.functions import citations as C
from plumbline.functions import text as T
from plumbline.operators import phrases, reports


@dataclass(frozen=True)
class Config:
    """Thresholds of the outcome and the policy that weighs it; the defaults are fixed values."""

    coverage: float = 0.75
    full_numeric: bool = True
    few_terms: int = 2
    low_coverage: float = 0.5
    policy: str = "safety"

    def describe(self) -> dict[str, str]:
        """All settings, the policy's weights among them, as text to store beside scores; an unknown policy raises."""
        weights = reports.policy_weights(self.policy)
        return {k: str(v) for k, v in asdict(self).items()} | {f"weight_{k}": str(v) for k, v in weights.items()}


DEFAULT = Config()
#: Items up to which their keys and patterns are broadcast.
BROADCAST_ITEMS = 10_000

KEY = "required array<array<string>>, forbidden array<array<string>>, numeric array<struct<value: double, tolerance: double>>, adjacent array<string>"


def pattern_of(phrase: Column) -> Column:
    """``phrase_pattern`` as a column, for phrases that are data."""
    folded = phrases.folded(phrase)
    quoted = F.regexp_replace(F.regexp_replace(folded, r"([\\.\[\]{}()*+?^$|&~#-])", r"\\$1"), " ", r"\\s+")
    return F.concat(F.lit("(?<![a-z0-9])"), quoted, F.when(folded.rlike("[0-9]$"), "(?![0-9])").otherwise(""))


def asserted_pattern(phrase: Column, cues: list[str] | None = None, window: int = T.CONTRAST_WINDOW) -> Column:
    import re

    cues = [c for c in (T.CONTRAST_CUES if cues is None else cues) if len(c) <= window]
    behind = "|".join(f"{re.escape(c)}.{{0,{window - len(c)}}}" for c in cues)
    return F.concat(F.lit(f"(?<!{behind})" if cues else ""), pattern_of(phrase))


def compiled(items: DataFrame, cues: list[str] | None = None) -> DataFrame:
    """Items with a struct of patterns beside their key: one expression over items, which are few, not over responses."""
    deep = lambda c, f: F.transform(c, lambda g: F.transform(g, f))
    # An adapter that leaves items as they are would compile per response; here each phrase is compiled per item.
    return items.withColumns(
        {
            "_required": deep(F.col("required"), pattern_of),
            "_forbidden": F.transform(F.flatten("forbidden"), lambda p: F.struct(p.alias("p"), pattern_of(p).alias("m"), asserted_pattern(p, cues).alias("a"))),
            "_adjacent": F.transform("adjacent", lambda p: F.struct(p.alias("p"), pattern_of(p).alias("m"), asserted_pattern(p, cues).alias("a"))),
        }
    )


def _asserted(text: Column, terms: Column) -> Column:
    hit = F.filter(terms, lambda t: F.when(F.rlike(text, t["m"]), F.rlike(text, t["a"])).otherwise(F.lit(False)))
    return F.array_sort(F.array_distinct(F.transform(hit, lambda t: t["p"])))


def assessed(rows: DataFrame, normal: str = "normal") -> DataFrame:
    """``rows`` (compiled key, normal text) with coverage, forbidden and adjacent hits, numeric coverage and what is missed.

    coverage is 1 without required groups; numeric_coverage is null without numeric facts. missing_groups are the
    places of the unmet groups from 0, missing_numbers the values not found, contrasted the adjacent terms that are
    only mentioned as what does not hold.
    """
    t = F.col(normal)
    met = F.transform("_required", lambda g: F.exists(g, lambda p: F.rlike(t, p)))
    rows = rows.withColumns({"_met": met, "_numbers": T.numbers(t)})
    right = F.filter("numeric", lambda n: F.exists("_numbers", lambda v: F.abs(v - n["value"]) <= n["tolerance"]))
    return rows.withColumns(
        {
            "coverage": F.when(F.size("_met") == 0, 1.0).otherwise(F.size(F.filter("_met", lambda x: x)) / F.size("_met")),
            "missing_groups": F.filter(F.transform("_met", lambda x, k: F.when(~x, k)), lambda k: k.isNotNull()),
            "missing_numbers": F.transform(F.array_except("numeric", right), lambda n: n["value"]),
            "contrasted": F.array_sort(F.array_distinct(F.transform(F.filter("_adjacent", lambda a: F.rlike(t, a["m"]) & ~F.rlike(t, a["a"])), lambda a: a["p"]))),
            "numeric_coverage": F.when(F.size("numeric") > 0, F.size(right) / F.size("numeric")),
            "forbidden_asserted": _asserted(t, F.col("_forbidden")),
            "adjacent_hits": _asserted(t, F.col("_adjacent")),
        }
    ).drop("_met", "_numbers")


def decided(empty: Column, declined: Column, coverage: Column, n_forbidden: Column, n_adjacent: Column, numeric: Column, failed: Column, config: Config = DEFAULT) -> Column:
    """The ordered decision from its facts: error, empty, declined, correct, adjacent, other; numeric is null without facts."""
    full = F.coalesce(numeric, F.lit(1.0)) >= 1 if config.full_numeric else F.lit(True)
    right = (coverage >= config.coverage) & (n_forbidden == 0) & full
    adjacent = (n_adjacent >= config.few_terms) | ((n_adjacent >= 1) & (coverage < config.low_coverage))
    return F.when(failed | empty, "unscorable").when(declined, "abstained").when(right, "correct").when(adjacent, "adjacent_substitution").otherwise("other_incorrect")


def outcome(normal: str = "normal", error: str = "error", config: Config = DEFAULT) -> Column:
    """The decision over assessed rows."""
    empty, declined = T.abstention(F.col(normal))
    failed = F.coalesce(F.col(error), F.lit("")) != ""
    return decided(empty, declined, F.col("coverage"), F.size("forbidden_asserted"), F.size("adjacent_hits"), F.col("numeric_coverage"), failed, config)


def score(items: DataFrame, responses: DataFrame, text: str = "text", cues: list[str] | None = None, on: str = "item_id", config: Config = DEFAULT) -> DataFrame:
    """Responses (item_id, text, error) with their outcome and evidence; a response of no known item raises.

    Few items are broadcast, more are shuffled: a shuffle by few items would leave most tasks without a response. As
    patterns cost more than reading, responses are dealt out evenly first. Unscorable rows carry no evidence.
    """
    held = compiled(items, cues).withColumn("_known", F.lit(True))
    if items.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS:
        held = F.broadcast(held)
        responses = responses.repartition(int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = T.normalized(responses, text).join(held, on, "left")
    rows = rows.withColumn(on, F.when(F.col("_known"), F.col(on)).otherwise(F.raise_error(F.concat(F.lit("no such item: "), F.col(on).cast("string"))).cast(dict(responses.dtypes)[on])))
    rows = assessed(rows).withColumn("outcome", outcome(config=config))
    lost = F.col("outcome") == "unscorable"
    blank = {c: F.array().cast(rows.schema[c].dataType) for c in ("forbidden_asserted", "adjacent_hits", "contrasted", "missing_groups", "missing_numbers")}
    return rows.withColumns(
        {"coverage": F.when(lost, 0.0).otherwise(F.col("coverage")), "numeric_coverage": F.when(~lost, F.col("numeric_coverage"))} | {c: F.when(lost, none).otherwise(F.col(c)) for c, none in blank.items()}
    ).drop("_known", "_required", "_forbidden", "_adjacent", "normal")


def expected(clause: Column) -> Column:
    """The references that an item's own clause names."""
    return C.citations(clause)


def acceptable(clause: Column, cross_reference: Column) -> Column:
    """Those, and the references of the clauses that an item's cross references name (array of strings)."""
    others = F.flatten(F.transform(F.coalesce(cross_reference, F.array().cast("array<string>")), C.citations))
    return F.concat(expected(clause), others)


def score_full(items: DataFrame, responses: DataFrame, cues: list[str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """``score`` as a whole record: abstained, unscorable_reason, the citation's grade and flags, and the utility.

    Items carry clause, cross_reference (array of clauses) and abstention_acceptable beside their key. Citations are
    read from the text and from the response's list, if it has one. Unscorable rows cite nothing.
    """
    listed = F.concat_ws("\n", "citations") if "citations" in responses.columns else F.lit("")
    rows = score(items, responses.withColumn("_said", F.concat_ws("\n", "text", listed)), cues=cues, config=config)
    lost, error = F.col("outcome") == "unscorable", F.coalesce("error", F.lit(""))
    found = F.when(lost, F.filter(C.citations(F.lit("")), lambda x: F.lit(False))).otherwise(C.citations(F.col("_said")))
    rows = rows.withColumns({"_found": found, "_expected": expected(F.col("clause")), "_acceptable": acceptable(F.col("clause"), F.col("cross_reference"))})
    rows = rows.withColumns(C.grade(F.col("_found"), F.col("_expected"), F.col("_acceptable")))
    reason = F.when(lost & (error != ""), F.concat(F.lit("adapter_error: "), error)).when(lost, "empty_response")
    return rows.withColumns({"abstained": F.col("outcome") == "abstained", "unscorable_reason": reason, "utility": reports.utility(config.policy)}).drop("_said", "_found", "_expected", "_acceptable")


def _phrases_of(questions: DataFrame) -> DataFrame:
    """(item_id, role, place, phrase) of all phrases of keys; place is a required phrase's group."""
    none = F.array().cast("array<array<string>>")
    role = lambda name, c: questions.select("item_id", F.lit(name).alias("role"), F.lit(None).cast("int").alias("place"), F.explode(c).alias("phrase"))
    groups = questions.select("item_id", F.lit("required").alias("role"), F.posexplode(F.coalesce("required", none)).alias("place", "_g"))
    required = groups.select("item_id", "role", "place", F.explode("_g").alias("phrase"))
    return required.unionByName(role("forbidden", F.flatten(F.coalesce("forbidden", none)))).unionByName(role("adjacent", F.col("adjacent")))


def answer_space(questions: DataFrame, excerpts: DataFrame, cues: list[str] | None = None) -> DataFrame:
    """(item_id, form, excerpt_id, outcome, coverage): every question (ids unique) against every excerpt in both forms.

    The exhaustive product is the operator's meaning, but it is one of ids and facts: texts are normalised and written
    once, phrases are looked up in the texts that can hold them, and what a pair has of its key is joined to the product.
    """
    ids = ["excerpt_id", "form"]
    both = excerpts.select("excerpt_id", F.explode(F.array(F.struct(F.lit("wrapped").alias("form"), F.col("wrapped").alias("text")), F.struct(F.lit("bare").alias("form"), F.col("bare").alias("text")))).alias("_e")).select("excerpt_id", "_e.*")
    texts = scratch.saved(T.normalized(both, "text").drop("text"), "excerpts")
    uses = _phrases_of(questions)
    found = phrases.occurrences(texts, ids, uses, pattern_of, lambda p: asserted_pattern(p, cues))
    n = lambda role, c: F.size(F.collect_set(F.when(role, c)))  # noqa: E731  bounded by one key
    said = lambda name: (F.col("role") == name) & F.col("asserted")
    evidence = found.join(uses, "phrase").groupBy("item_id", *ids).agg(
        n(F.col("role") == "required", F.col("place")).alias("_met"), n(said("forbidden"), F.col("phrase")).alias("_forbidden"), n(said("adjacent"), F.col("phrase")).alias("_adjacent")
    )
    empty, declined = T.abstention(F.col("normal"))
    facts = texts.select(*ids, empty.alias("_empty"), declined.alias("_declined"), T.numbers(F.col("normal")).alias("_numbers"))
    right = F.filter("numeric", lambda x: F.exists("_numbers", lambda v: F.abs(v - x["value"]) <= x["tolerance"]))
    asked = questions.select("item_id", F.coalesce(F.size("required"), F.lit(0)).alias("_groups"), "numeric")
    product = asked.crossJoin(facts).select("item_id", *ids, "_groups", "_empty", "_declined", F.when(F.size("numeric") > 0, F.size(right) / F.size("numeric")).alias("_numeric"))
    rows = product.join(evidence, ["item_id", *ids], "left").na.fill(0, ["_met", "_forbidden", "_adjacent"])
    rows = rows.withColumn("coverage", F.when(F.col("_groups") <= 0, 1.0).otherwise(F.col("_met") / F.col("_groups")))
    result = decided(F.col("_empty"), F.col("_declined"), F.col("coverage"), F.col("_forbidden"), F.col("_adjacent"), F.col("_numeric"), F.lit(False))
    return rows.select("item_id", "form", "excerpt_id", result.alias("outcome"), "coverage")


def ceilings(space: DataFrame) -> DataFrame:
    """(form, n_items, n_attainable): items that some excerpt answers."""
    best = space.groupBy("form", "item_id").agg(F.bool_or(F.col("outcome") == "correct").alias("_ok"))
    return best.groupBy("form").agg(F.count("*").alias("n_items"), F.count_if("_ok").alias("n_attainable"))


def best_excerpts(space: DataFrame) -> DataFrame:
    """(item_id, form, coverage, excerpts): the largest coverage and all excerpts that reach it, in order."""
    by_level = space.groupBy("item_id", "form", "coverage").agg(F.sort_array(F.collect_list("excerpt_id")).alias("excerpts"))
    return by_level.groupBy("item_id", "form").agg(F.max(F.struct("coverage", "excerpts")).alias("_m")).select("item_id", "form", "_m.coverage", "_m.excerpts")


def failure_classes(space: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(item_id, failure) of retrieved (item_id, excerpt_id): passes, recoverable_by_reranking or no_excerpt_passes."""
    ok = space.where("form = 'wrapped'").select("item_id", "excerpt_id", (F.col("outcome") == "correct").alias("_ok"))
    own = ok.join(retrieved, ["item_id", "excerpt_id"]).select("item_id", F.col("_ok").alias("_own"))
    some = ok.groupBy("item_id").agg(F.bool_or("_ok").alias("_any"))
    label = F.when(F.col("_own"), "passes").when(F.col("_any"), "recoverable_by_reranking").otherwise("no_excerpt_passes")
    return some.join(own, "item_id", "left").select("item_id", label.alias("failure"))
