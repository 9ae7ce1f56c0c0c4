"""Report aggregates over scored observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import significance

#: Utility of each outcome by policy; abstained_acceptable is for items that may be declined.
POLICIES = {
    "safety": {"correct": 1.0, "abstained": 0.25, "abstained_acceptable": 0.9, "other_incorrect": -0.5, "adjacent_substitution": -1.0, "unscorable": 0.0},
    "accuracy": {"correct": 1.0, "abstained": 0.0, "abstained_acceptable": 0.0, "other_incorrect": 0.0, "adjacent_substitution": 0.0, "unscorable": 0.0},
}
#: Weights of the optional risk-weighted mean.
RISK_WEIGHTS = {"high": 1.0, "medium": 0.6, "low": 0.3}
#: z of a two-sided 95% interval.
Z95 = 1.959963984540054


def rate(flag: Column) -> Column:
    """Share of rows with the flag; null without rows."""
    return F.avg(flag.cast("double"))


def composition(scores: DataFrame, by: str, label: str = "outcome", with_type: bool = True) -> DataFrame:
    """(by, [item_type,] label, n, proportion): counts with their share in the group; null keys count too."""
    keys = [by, "item_type"] if with_type else [by]
    counts = scores.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return counts.withColumn("proportion", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def corpus_summary(scores: DataFrame) -> DataFrame:
    """(scope, label, n_items, n_factual, n_families, n_pairs) overall, by domain and by risk tier: one pass, one Expand."""
    items = scores.select("item_id", "domain", "family", "pair_id", "pair_role", "risk_tier", "item_type").distinct()
    scopes = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), v.alias("label")) for s, v in (("all", F.lit("all")), ("domain", F.col("domain")), ("risk_tier", F.col("risk_tier")))]))
    out = items.select("*", scopes.alias("_s")).groupBy("_s.scope", "_s.label")
    return out.agg(
        F.count("*").alias("n_items"), F.count_if(F.col("item_type") == "factual").alias("n_factual"),
        F.count_distinct("family").alias("n_families"), F.count_distinct(F.when(F.col("pair_role") == "a", F.col("pair_id"))).alias("n_pairs"),
    )


def policy_weights(policy: str) -> dict[str, float]:
    """The weights of a policy by outcome; a name that has none raises."""
    if policy not in POLICIES:
        raise ValueError(f"no policy is called {policy!r}, only {sorted(POLICIES)}")
    return POLICIES[policy]


def utility(policy: str = "safety") -> Column:
    """Utility of a row by outcome; an unknown policy raises."""
    weights = policy_weights(policy)
    out = F.when((F.col("outcome") == "abstained") & F.col("abstention_acceptable"), weights["abstained_acceptable"])
    for outcome, w in weights.items():
        out = out.when(F.col("outcome") == outcome, w)
    return out


def utility_table(scores: DataFrame, policies: list[str] | None = None) -> DataFrame:
    """(arm, policy, mean_utility, risk_weighted)."""
    risk = reduce(lambda c, kv: c.when(F.col("risk_tier") == kv[0], kv[1]), RISK_WEIGHTS.items(), F)
    parts = [scores.select("arm", F.lit(p).alias("policy"), utility(p).alias("_u"), risk.alias("_w")) for p in policies or sorted(POLICIES)]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy("arm", "policy").agg(F.avg("_u").alias("mean_utility"), (F.sum(F.col("_u") * F.col("_w")) / F.sum("_w")).alias("risk_weighted"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """(low, high) of the Wilson interval of k in n, clipped to [0, 1]; null where n is 0."""
    p, n = F.try_divide(k.cast("double"), n), n.cast("double")
    shrink = 1 + F.try_divide(F.lit(z * z), n)
    mid = F.try_divide(p + F.try_divide(F.lit(z * z), 2 * n), shrink)
    half = F.try_divide(z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)), shrink)
    clip = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    return clip(mid - half), clip(mid + half)


def pairs(scores: DataFrame) -> DataFrame:
    """(arm, repeat, pair_id, a_correct, b_correct) of pairs with both outcomes; an aggregate, not a self-join."""
    side = lambda r: F.max(F.when(F.col("pair_role") == r, F.col("correct")))
    return scores.groupBy("arm", "repeat", "pair_id").agg(side("a").alias("a_correct"), side("b").alias("b_correct")).where("a_correct IS NOT NULL AND b_correct IS NOT NULL")


def paired_accuracy(scores: DataFrame, by: tuple[str, ...] = ("arm",)) -> DataFrame:
    """(by, n_both, n_pairs, paired_accuracy): pairs with both members correct, of those with both outcomes."""
    both = F.count_if(F.col("a_correct") & F.col("b_correct"))
    return pairs(scores).groupBy(*by).agg(both.alias("n_both"), F.count("*").alias("n_pairs"), (both / F.count("*")).alias("paired_accuracy"))


def pair_partition(scores: DataFrame) -> DataFrame:
    """(arm, n_pairs, both_pass, one_pass, neither_pass)."""
    n = F.col("a_correct").cast("int") + F.col("b_correct").cast("int")
    return pairs(scores).groupBy("arm").agg(F.count("*").alias("n_pairs"), *(F.count_if(n == k).alias(name) for k, name in ((2, "both_pass"), (1, "one_pass"), (0, "neither_pass"))))


def arm_summary(scores: DataFrame) -> DataFrame:
    """One row an arm: accuracy with its Wilson interval, spread and paired accuracy across repeats, and rates.

    Unscorable rows count in the denominators; scorable_accuracy leaves them out.
    """
    fact, cat = F.col("item_type") == "factual", F.col("item_type") == "category_error"
    of = lambda kind, outcome: F.avg(F.when(kind, (F.col("outcome") == outcome).cast("double")))
    n, k = F.count_if(fact), F.count_if(fact & F.col("correct"))
    low, high = wilson(F.col("_k"), F.col("n_factual_obs"))
    main = scores.groupBy("arm").agg(
        F.count_distinct("repeat").alias("n_repeats"), n.alias("n_factual_obs"), k.alias("_k"),
        F.try_divide(k.cast("double"), n).alias("accuracy"),
        F.try_divide(k.cast("double"), F.count_if(fact & (F.col("outcome") != "unscorable"))).alias("scorable_accuracy"),
        of(fact, "adjacent_substitution").alias("adjacent_rate"), of(fact, "abstained").alias("abstention_rate"), of(cat, "abstained").alias("declined_rate"),
        rate(F.col("outcome") == "unscorable").alias("unscorable_rate"), rate(F.col("citation_grade") == "correct_clause").alias("correct_clause_rate"),
        rate(F.col("paywalled")).alias("fabricated_paywalled_rate"),
    )
    per_repeat = scores.where(fact).groupBy("arm", "repeat").agg(rate(F.col("correct")).alias("_a"))
    spread = per_repeat.groupBy("arm").agg((F.max("_a") - F.min("_a")).alias("accuracy_spread"))
    paired = paired_accuracy(scores.where(fact), ("arm", "repeat")).groupBy("arm").agg(F.avg("paired_accuracy").alias("paired_accuracy"))
    out = main.join(spread, "arm", "left").join(paired, "arm", "left")
    return out.withColumns({"wilson_low": low, "wilson_high": high}).drop("_k")


def summarize(scores: DataFrame, policy: str = "safety", cluster: str = "family", n_draws: int = significance.DRAWS, seed: int = significance.SEED) -> DataFrame:
    """``arm_summary`` with n_items, the mean utility of a policy, and cluster intervals of the headline rates.

    accuracy and adjacent are over factual rows, clause and utility over all. The four are sums of one row a cluster
    and share their draws: scores are read once for the intervals, whatever their number.
    """
    fact = F.col("item_type") == "factual"
    values = {
        "accuracy": F.when(fact, F.col("correct").cast("double")), "adjacent": F.when(fact, (F.col("outcome") == "adjacent_substitution").cast("double")),
        "clause": (F.col("citation_grade") == "correct_clause").cast("double"), "utility": utility(policy),
    }
    long = significance.bootstrap(scores, ["arm"], cluster, *significance.means(values), n_draws=n_draws, seed=seed)
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    ends = long.groupBy("arm").agg(*(pick(m, c).alias(f"{m}_{c}") for m in values for c in ("ci_low", "ci_high")), pick("utility", "estimate").alias("mean_utility"), F.max("n_clusters").alias("n_clusters"))
    items = scores.groupBy("arm").agg(F.count_distinct("item_id").alias("n_items"))
    return arm_summary(scores).join(ends, "arm").join(items, "arm").withColumn("utility_policy", F.lit(policy))


def subsets(scores: DataFrame) -> DataFrame:
    """Factual rows, once for each subset that has them: all, by domain, in a complete pair, not in one."""
    fact = scores.where("item_type = 'factual'")
    members = fact.groupBy("pair_id").agg(F.count_distinct("pair_role").alias("_roles"))
    paired = F.when(F.col("_roles") == 2, F.lit("minimal_pair_items")).otherwise(F.lit("unpaired_items"))
    return fact.join(members, "pair_id").withColumn("subset", F.explode(F.array(F.lit("all_factual"), F.concat(F.lit("domain:"), F.col("domain")), paired)))


def breakdown(scores: DataFrame) -> DataFrame:
    """(arm, subset, n_items, n_obs, accuracy), with pairs_both_correct as a subset of pairs."""
    main = subsets(scores).groupBy("arm", "subset").agg(F.count_distinct("item_id").alias("n_items"), F.count("*").alias("n_obs"), rate(F.col("correct")).alias("accuracy"))
    fact = pairs(scores.where("item_type = 'factual'")).withColumn("_both", F.col("a_correct") & F.col("b_correct"))
    both = fact.groupBy("arm").agg(F.count_distinct("pair_id").alias("n_items"), F.count("*").alias("n_obs"), rate(F.col("_both")).alias("accuracy"))
    return main.unionByName(both.withColumn("subset", F.lit("pairs_both_correct")))


def same_items(scores: DataFrame) -> DataFrame:
    """(arm_a, arm_b, only_a, only_b): (item, repeat) pairs that one arm has and the other lacks; all 0 where arms compare."""
    held = scores.select("arm", "item_id", "repeat").distinct()
    arms = held.groupBy("item_id", "repeat").agg(F.collect_set("arm").alias("_have"))  # arms are few
    names = held.select("arm").distinct()
    both = names.select(F.col("arm").alias("arm_a")).join(names.select(F.col("arm").alias("arm_b")), F.col("arm_a") < F.col("arm_b"))
    has = lambda c: F.array_contains("_have", F.col(c))
    out = arms.join(F.broadcast(both), has("arm_a") | has("arm_b"))
    return out.groupBy("arm_a", "arm_b").agg(F.count_if(has("arm_a") & ~has("arm_b")).alias("only_a"), F.count_if(has("arm_b") & ~has("arm_a")).alias("only_b"))


def gate(scores: DataFrame, least_accuracy: float = 0.3, least_precision: float = 0.4, most_abstained: float = 0.5) -> DataFrame:
    """(arm, accuracy, abstained, declined, precision_answered, passes): the release criteria on answered precision."""
    fact, cat = F.col("item_type") == "factual", F.col("item_type") == "category_error"
    answered = fact & ~F.col("outcome").isin("abstained", "unscorable")
    out = scores.groupBy("arm").agg(
        F.avg(F.when(fact, F.col("correct").cast("double"))).alias("accuracy"), F.avg(F.when(fact, (F.col("outcome") == "abstained").cast("double"))).alias("abstained"),
        F.avg(F.when(cat, (F.col("outcome") == "abstained").cast("double"))).alias("declined"), F.avg(F.when(answered, F.col("correct").cast("double"))).alias("precision_answered"),
    )
    ok = (F.col("accuracy") >= least_accuracy) & (F.col("precision_answered") >= least_precision) & (F.col("abstained") <= most_abstained)
    return out.withColumn("passes", F.coalesce(ok, F.lit(False)))
