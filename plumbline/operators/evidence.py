"""Looking through evidence: named filters and search, JSON lookups, prompts, checks of stored baselines, mock systems."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named filters over rows with flags baseline, attainable, attainable_bare and own_passes.
FILTERS = {
    "all": lambda: F.lit(True),
    "baseline": lambda: F.col("baseline"),
    "recoverable": lambda: ~F.col("baseline") & F.col("attainable"),
    "unreachable": lambda: ~F.col("attainable"),
    "own-fails": lambda: ~F.col("own_passes"),
    "metadata": lambda: F.col("attainable") != F.col("attainable_bare"),
}


def search(rows: DataFrame, words: str, fields: list[str], name: str = "all") -> DataFrame:
    """Rows of a named filter whose fields together contain the words, without case, underscores read as spaces."""
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}; available: {', '.join(FILTERS)}")
    plain = F.replace(F.lower(F.concat_ws(" ", *fields)), F.lit("_"), F.lit(" "))
    return rows.where(FILTERS[name]() & F.contains(plain, F.lit(words.lower().strip().replace("_", " "))))


def dig(json: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text; null where there is none."""
    return F.get_json_object(json, "$." + path)


def count_where(json: Column, field: str, value: str) -> Column:
    """How many objects of a JSON array have the field equal to the value; '' counts absent fields too."""
    rows = F.coalesce(F.from_json(json, "array<map<string, string>>"), F.array().cast("array<map<string, string>>"))
    return F.size(F.filter(rows, lambda m: F.coalesce(F.try_element_at(m, F.lit(field)), F.lit("")) == value)).cast("long")


def prompt(question: Column, excerpt: Column | None = None) -> Column:
    """The question alone, or behind the excerpt that it is to be answered from; a null excerpt leaves it alone."""
    if excerpt is None:
        return question
    return F.when(excerpt.isNull(), question).otherwise(F.concat(F.lit("Excerpt:\n"), excerpt, F.lit("\n\nQuestion:\n"), question))


def short_hash(text: Column) -> Column:
    """Sixteen hex digits that identify a text without showing it."""
    return F.substring(F.sha2(text, 256), 1, 16)


def baseline_problems(stored: DataFrame, fresh: DataFrame, digest: str) -> DataFrame:
    """(problem, n) of a stored baseline (item_id, is_mock, digest, text, outcome) against fresh (item_id, text, outcome).

    Mock rows, another digest, duplicate ids, missing or unknown ids, drifted excerpts, drifted scores; sound ones count 0.
    """
    ids = stored.groupBy("item_id").agg(F.count("*").alias("_n"))
    both = stored.alias("s").join(fresh.alias("f"), "item_id", "full_outer")
    known, told = F.col("f.outcome").isNotNull(), F.col("s.outcome").isNotNull()
    row = both.agg(
        F.count_if(F.coalesce("is_mock", F.lit(False))).alias("mock"), F.count_if(told & (F.coalesce("digest", F.lit("")) != digest)).alias("digest"), F.count_if(known & ~told).alias("missing"),
        F.count_if(told & ~known).alias("unknown"), F.count_if(known & told & ~F.col("s.text").eqNullSafe(F.col("f.text"))).alias("excerpt_drift"), F.count_if(known & told & (F.col("s.outcome") != F.col("f.outcome"))).alias("score_drift"),
    )
    counted = row.crossJoin(ids.agg(F.count_if(F.col("_n") > 1).alias("duplicate")))  # one row each
    return counted.select(F.explode(F.create_map(*[x for c in counted.columns for x in (F.lit(c), F.col(c))])).alias("problem", "n"))


def require_baseline(stored: DataFrame, fresh: DataFrame, digest: str, config: dict[str, str] | None = None, stored_config: dict[str, str] | None = None) -> DataFrame:
    """``stored`` if nothing is wrong with it; a broken rule of ``baseline_problems`` or another scoring config raises."""
    if config != stored_config:
        raise ValueError("the stored run was scored under other settings")
    if found := baseline_problems(stored, fresh, digest).where("n > 0").collect():  # one row a rule
        raise ValueError("; ".join(f"{r.problem}: {r.n}" for r in found))
    return stored


@dataclass(frozen=True)
class Profile:
    """Chances of a mock system's branches, what is left being another answer, and its ranges of confidence."""

    correct: float
    adjacent: float
    abstain: float
    sure: tuple[float, float] = (0.4, 0.9)
    unsure: tuple[float, float] = (0.4, 0.9)


#: The profiles.
PROFILES = {
    "ungrounded": Profile(0.18, 0.60, 0.03, (0.72, 0.95), (0.62, 0.93)),
    "pseudo_grounded": Profile(0.44, 0.34, 0.04, (0.75, 0.97), (0.68, 0.95)),
    "grounded": Profile(0.80, 0.07, 0.07, (0.70, 0.96), (0.40, 0.75)),
    "abstainer": Profile(0.0, 0.0, 1.0, (0.0, 0.1), (0.0, 0.1)),
}


def mock(items: DataFrame, profile: Profile, seed: int = 20260903, repeat: int = 0) -> DataFrame:
    """(item_id, branch, text, confidence) by a hash of seed, repeat and id, whatever the order; rows are marked as mock.

    items: item_id, correct_answer, adjacent_answer; a null answer is told as an empty text. A right answer is as sure
    as the profile is when right, all others as it is when wrong.
    """
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}|{repeat}|{salt}"), F.col("item_id").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    u = draw("branch")
    a, b, c = profile.correct, profile.correct + profile.adjacent, profile.correct + profile.adjacent + profile.abstain
    branch = F.when(u < a, "correct").when(u < b, "adjacent").when(u < c, "abstain").otherwise("other")
    text = F.when(u < a, F.col("correct_answer")).when(u < b, F.col("adjacent_answer")).when(u < c, "I do not know.").otherwise("Another rule holds here.")
    within = lambda ends: ends[0] + draw("confidence") * (ends[1] - ends[0])
    confidence = F.when(u < a, within(profile.sure)).otherwise(within(profile.unsure))
    return items.select("item_id", branch.alias("branch"), F.coalesce(text, F.lit("")).alias("text"), confidence.alias("confidence"), F.lit(True).alias("is_mock"))
