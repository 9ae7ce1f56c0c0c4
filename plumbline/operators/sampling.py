"""Blinded stratified samples for human rating."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.prefix import hex_bucket, running

#: The outcomes that people rate; what cannot be scored is not rated.
RATED = ("adjacent_substitution", "correct", "other_incorrect", "abstained")
RUN = ["adapter", "arm", "repeat"]


def ratable(scores: DataFrame, responses: DataFrame, items: DataFrame, outcomes: tuple[str, ...] = RATED) -> DataFrame:
    """What a sample for rating is drawn from: scores of the given outcomes with their response and item.

    scores: adapter, arm, repeat, item_id, outcome; responses: the first four and text; items: item_id, question,
    correct_answer, clause, adjacent_label. A score without a response or an item is left out. Items join last, so the
    responses, which are large, meet the scores on the whole key and are shuffled once.
    """
    scored = scores.where(F.col("outcome").isin(list(outcomes))).select(*RUN, "item_id", F.col("outcome").alias("automatic_outcome"))
    said = scored.join(responses.select(*RUN, "item_id", F.col("text").alias("response_text")), [*RUN, "item_id"])
    known = items.select("item_id", "question", F.col("correct_answer").alias("reference_answer"), "clause", "adjacent_label")
    return said.join(known, "item_id").select(*RUN, "item_id", "automatic_outcome", "question", "response_text", "reference_answer", "clause", "adjacent_label")


def stratified(rows: DataFrame, stratum: str, key: list[str], share: float = 0.2, seed: int = 20260904) -> DataFrame:
    """``rows`` sampled: of each stratum of n rows max(1, round(n * share)), in hash order, with rating_id.

    Rounds half to even. Ids number the sample in another hash order, so they tell nothing of the stratum.
    """
    word = lambda salt: F.md5(F.concat_ws("|", F.lit(f"{seed}{salt}"), *[F.col(k).cast("string") for k in key]))
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.greatest(F.lit(1), F.bround(F.count("*") * share)).alias("_take"))
    hashed = rows.withColumn("_h", word(""))
    ranked = running(hashed, [stratum], hex_bucket(F.col("_h")), [F.col("_h"), *map(F.col, key)], {"_r": F.lit(1)})
    picked = ranked.join(F.broadcast(sizes), F.col(stratum).eqNullSafe(F.col("_s"))).where("_r <= _take").drop("_s", "_take", "_r", "_h")  # strata are few
    numbered = running(picked.withColumn("_h", word("id")), [], hex_bucket(F.col("_h")), [F.col("_h"), *map(F.col, key)], {"_r": F.lit(1)})
    return numbered.withColumn("rating_id", F.concat(F.lit("adj-"), F.lpad((F.col("_r") - 1).cast("string"), 4, "0"))).drop("_h", "_r")


def blinded(sample: DataFrame, shown: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sheet, key): what a rater sees, and the rest, joined by rating_id only."""
    return sample.select("rating_id", *shown), sample.drop(*shown)
