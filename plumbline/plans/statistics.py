"""Queries over scored observations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import agreement, reports, sampling, selective, significance
from plumbline.plans.scores import SCORES_SQL, scores
from plumbline.session import table

DRAWS = significance.DRAWS
FACTUAL = "item_type = 'factual'"


def _rounded(df, *columns, places: int = 9):
    return df.withColumns({c: F.round(c, places) for c in columns})


def _first(s, d):
    return scores(s, d).where("repeat = 0")


def _arm_summary(s, d):
    df = reports.arm_summary(scores(s, d))
    return _rounded(df, *[c for c, t in df.dtypes if t == "double"])


def _bootstrap(s, d):
    df = significance.bootstrap_mean(scores(s, d).where(FACTUAL), ["arm"], "family", F.col("correct").cast("int"))
    return _rounded(df, "estimate", "ci_low", "ci_high", places=6)


def _breakdown_ci(s, d):
    rows = reports.subsets(scores(s, d))
    df = significance.bootstrap_mean(rows, ["arm", "subset"], "family", F.col("correct").cast("int"), DRAWS)
    return _rounded(df, "estimate", "ci_low", "ci_high", places=6)


def _ece_interval(s, d):
    df = significance.bootstrap_ece(scores(s, d), n_draws=DRAWS)
    return _rounded(df, "estimate", "ci_low", "ci_high", places=6)


def _disagreements(s, d):
    rated = _quality_rule(s, d).withColumnRenamed("doc_id", "rating_id")
    return agreement.disagreements(rated.select("rating_id", F.col("human").alias("label")), rated.select("rating_id", F.col("automatic").alias("label")))


def _quality_rule(s, d):
    labels = table(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("human"))
    rule = F.when(F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")) * 20 > F.length("text"), 0).otherwise(1)
    return labels.join(table(s, d, "documents").select("doc_id", rule.alias("automatic")), "doc_id")


QUERIES = {
    "corpus_summary": lambda s, d: reports.corpus_summary(scores(s, d)),
    "outcome_composition": lambda s, d: _rounded(reports.composition(scores(s, d), "arm"), "proportion"),
    "citation_table": lambda s, d: _rounded(reports.composition(scores(s, d), "arm", "citation_grade", False), "proportion"),
    "arm_summary": _arm_summary,
    "wilson_interval": lambda s, d: _rounded(reports.arm_summary(scores(s, d)).select("arm", "wilson_low", "wilson_high"), "wilson_low", "wilson_high"),
    "paired_accuracy": lambda s, d: _rounded(reports.paired_accuracy(scores(s, d).where(FACTUAL)), "paired_accuracy"),
    "paired_table": lambda s, d: reports.pairs(scores(s, d)),
    "pair_partition": lambda s, d: reports.pair_partition(_first(s, d)),
    "breakdown_subsets": lambda s, d: _rounded(reports.breakdown(scores(s, d)), "accuracy"),
    "breakdown_intervals": _breakdown_ci,
    "ece_interval": _ece_interval,
    "rating_disagreements": _disagreements,
    "repeat_sensitivity": lambda s, d: _rounded(significance.sensitivity(scores(s, d)), "p_first", "p_min", "p_max"),
    "utility_policy": lambda s, d: _rounded(reports.utility_table(scores(s, d)), "mean_utility", "risk_weighted"),
    "identical_item_sets": lambda s, d: reports.same_items(scores(s, d)),
    "release_gate": lambda s, d: _rounded(reports.gate(scores(s, d)), "accuracy", "abstained", "declined", "precision_answered"),
    "risk_coverage_rows": lambda s, d: _rounded(selective.curve_rows(scores(s, d), ties=("item_id", "repeat")), "coverage", "selective_accuracy"),
    "risk_coverage_points": lambda s, d: _rounded(selective.curve_points(scores(s, d)), "coverage", "selective_accuracy", "selective_risk"),
    "aurc": lambda s, d: _rounded(selective.aurc(scores(s, d)), "aurc", "aurc_random", "aurc_optimal", "e_aurc").withColumn("e_aurc", F.col("e_aurc") + 0.0),
    "selective_at_coverage": lambda s, d: _rounded(selective.at_coverage(scores(s, d)), "coverage", "selective_accuracy"),
    "threshold_curve": lambda s, d: _rounded(selective.threshold_curve(_first(s, d)), "coverage"),
    "brier": lambda s, d: _rounded(selective.brier(scores(s, d)), "brier", "brier_constant", "mean_confidence"),
    "reliability_table": lambda s, d: _rounded(selective.reliability(scores(s, d)), "low", "high", "mean_confidence", "accuracy"),
    "ece": lambda s, d: _rounded(selective.ece(scores(s, d)), "ece"),
    "mcnemar_exact": lambda s, d: _rounded(significance.mcnemar(scores(s, d)), "p_value"),
    "holm_adjust": lambda s, d: _rounded(significance.holm(significance.mcnemar(scores(s, d)), "p_value", "arm_a", "arm_b").select("arm_a", "arm_b", "p_value", "p_holm"), "p_value", "p_holm"),
    "arm_comparisons": lambda s, d: _rounded(significance.compare_arms(scores(s, d), unequal="pair"), "difference", "ci_low", "ci_high", "p_value", "p_holm", places=6),
    "bootstrap_accuracy": _bootstrap,
    "selective_intervals": lambda s, d: _rounded(significance.bootstrap_selective(scores(s, d)), "estimate", "ci_low", "ci_high", places=6).withColumns({c: F.col(c) + 0.0 for c in ("estimate", "ci_low", "ci_high")}),
    "guarded_comparison": lambda s, d: _rounded(significance.compare_arms(significance.shared_items(scores(s, d))), "difference", "ci_low", "ci_high", "p_value", "p_holm", places=6),
    "bootstrap_aurc": lambda s, d: _rounded(significance.bootstrap_aurc(scores(s, d), n_draws=DRAWS), "ci_low", "ci_high", places=6),
    "cohen_kappa": lambda s, d: _rounded(agreement.cohen(_quality_rule(s, d), "human", "automatic", []), "agreement", "expected", "kappa"),
    "multiclass_kappa": lambda s, d: _rounded(agreement.cohen(_first(s, d).withColumn("human", F.when(F.col("item_id") % 5 == 0, "other_incorrect").otherwise(F.col("outcome"))), "human", "outcome", ["arm"]), "agreement", "expected", "kappa"),
    "fleiss_kappa": lambda s, d: _rounded(agreement.fleiss(_first(s, d)), "mean_agreement", "expected", "kappa"),
    "item_difficulty": lambda s, d: _rounded(agreement.difficulty(_first(s, d)), "difficulty"),
    "point_biserial": lambda s, d: _rounded(agreement.point_biserial(_first(s, d)), "discrimination"),
    "clopper_pearson": lambda s, d: _rounded(
        scores(s, d).groupBy("arm").agg(F.count_if("correct").alias("k"), F.count("*").alias("n")).withColumn("_c", significance.clopper_pearson("k", "n")).select("arm", "k", "n", F.col("_c.low").alias("ci_low"), F.col("_c.high").alias("ci_high")), "ci_low", "ci_high"),
    "stratified_sample": lambda s, d: sampling.stratified(scores(s, d), "outcome", ["arm", "item_id", "repeat"]).select("rating_id", "arm", "item_id", "repeat", "outcome"),
}


def _ratable(s, d):
    """Every third item has no response, every fifth is unknown."""
    rows, i = scores(s, d).withColumn("adapter", F.col("arm")), F.col("item_id")
    said = rows.where(i % 3 != 0).select("adapter", "arm", "repeat", "item_id", F.concat_ws(" ", "arm", F.col("repeat").cast("string")).alias("text"))
    items = rows.where(i % 5 != 0).groupBy("item_id").agg(F.min("domain").alias("question")).withColumns({c: F.col("question") for c in ("correct_answer", "clause", "adjacent_label")})
    return sampling.ratable(rows, said, items).select("arm", "repeat", "item_id", "automatic_outcome", "question", "response_text")


QUERIES["ratable_rows"] = _ratable

W = f"WITH {SCORES_SQL}"
FIRST = f"{W}, f AS (SELECT * FROM scores WHERE repeat = 0)"
EVERY = f"{W}, f AS (SELECT * FROM scores)"
PAIRS = "pr AS (SELECT arm, repeat, pair_id, bool_or(correct) FILTER (pair_role = 'a') AS a_correct, bool_or(correct) FILTER (pair_role = 'b') AS b_correct FROM {src} GROUP BY ALL HAVING count(DISTINCT pair_role) = 2)"
WILSON = "(({k}::DOUBLE/{n} + 3.841458820694124/(2*{n}) {s} 1.959963984540054*sqrt(({k}::DOUBLE/{n})*(1-{k}::DOUBLE/{n})/{n} + 3.841458820694124/(4.0*{n}*{n})))/(1+3.841458820694124/{n}))"
HAR = "list_sum(list_transform(range(1, ({n})::BIGINT + 1), lambda i: 1.0 / i))"
TIES = """c AS (SELECT * FROM f WHERE confidence IS NOT NULL),
g AS (SELECT arm, confidence, count(*) AS m, count(*) FILTER (correct) AS h FROM c GROUP BY ALL),
t AS (SELECT *, coalesce(sum(m) OVER w, 0)::BIGINT AS b, coalesce(sum(h) OVER w, 0)::BIGINT AS bh, (sum(m) OVER (PARTITION BY arm))::BIGINT AS n
  FROM g WINDOW w AS (PARTITION BY arm ORDER BY confidence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
POINTS = f"{TIES}, p AS (SELECT arm, confidence AS threshold, b + m AS n_answered, (b + m)::DOUBLE / n AS coverage, (bh + h)::DOUBLE / (b + m) AS selective_accuracy FROM t)"
BINS = """c AS (SELECT *, least(floor(confidence * 10), 9)::BIGINT AS bin FROM f WHERE confidence IS NOT NULL),
r AS (SELECT a.arm, b.bin, count(c.arm) AS n, avg(confidence) AS mean_confidence, avg(correct::INT) AS accuracy
  FROM (SELECT DISTINCT arm FROM f) a CROSS JOIN (SELECT range AS bin FROM range(10)) b LEFT JOIN c ON c.arm = a.arm AND c.bin = b.bin GROUP BY ALL)"""
MC = """d AS (SELECT x.arm AS arm_a, y.arm AS arm_b, x.family, x.correct AS x, y.correct AS y FROM scores x JOIN scores y ON x.item_id = y.item_id AND x.arm < y.arm
  WHERE x.repeat = 0 AND y.repeat = 0 AND x.item_type = 'factual'),
k AS (SELECT arm_a, arm_b, count(*) FILTER (x AND y) AS both_right, count(*) FILTER (x AND NOT y) AS a_only, count(*) FILTER (NOT x AND y) AS b_only, count(*) FILTER (NOT x AND NOT y) AS neither, count(*) AS n FROM d GROUP BY ALL),
q AS (SELECT *, a_only + b_only AS t, least(a_only, b_only) AS l FROM k),
z AS (SELECT *, unnest(range(0, t + 1)) AS i FROM q),
b AS (SELECT *, exp(lgamma(t + 1) - lgamma(i + 1) - lgamma(t - i + 1) - t * ln(2)) AS pm, exp(lgamma(t + 1) - lgamma(l + 1) - lgamma(t - l + 1) - t * ln(2)) AS own FROM z),
mc AS (SELECT arm_a, arm_b, any_value(both_right) AS both_right, any_value(a_only) AS a_only, any_value(b_only) AS b_only, any_value(neither) AS neither, any_value(n) AS n,
  least(1.0, sum(pm) FILTER (pm <= own * (1 + 1e-9))) AS p_value FROM b GROUP BY ALL)"""
HOLM = """, hs AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p_value, arm_a, arm_b) + 1) * p_value) AS st FROM mc),
ho AS (SELECT *, max(st) OVER (ORDER BY p_value, arm_a, arm_b ROWS UNBOUNDED PRECEDING) AS p_holm FROM hs)"""


#: How often a replicate takes a cluster, by a word of its digest.
TIMES = "CASE " + " ".join(f"WHEN substr(w, 1 + 8 * i::INT, 8) < '{x}' THEN {k}" for k, x in enumerate(significance.STEPS)) + f" ELSE {len(significance.STEPS)} END"


def _draws(src: str) -> str:
    """The rows of src, once for each replicate that takes their family, with rep and times."""
    return f"""SELECT * FROM (SELECT *, four * 4 + i AS rep, {TIMES} AS times FROM (SELECT *, md5(concat_ws('|', '20260904', four::VARCHAR, family::VARCHAR)) AS w
  FROM {src} CROSS JOIN (SELECT range AS four FROM range({DRAWS // 4}))) CROSS JOIN (SELECT range AS i FROM range(4))) WHERE times > 0"""


def _boot(src: str, by: str) -> str:
    """CTEs for a bootstrap of the mean of v over (by, family) of src; bs has the result."""
    return f"""cl AS (SELECT {by}, family, sum(v)::DOUBLE AS s, count(v) AS c FROM {src} GROUP BY ALL),
gn AS (SELECT {by}, count(*) AS nc, sum(s) / sum(c) AS estimate FROM cl GROUP BY ALL),
st2 AS (SELECT {by}, rep, sum(s * times) / nullif(sum(c * times), 0) AS val FROM ({_draws('cl')}) GROUP BY ALL),
bs AS (SELECT {by}, quantile_cont(val, 0.025) AS ci_low, quantile_cont(val, 0.975) AS ci_high FROM st2 GROUP BY ALL)"""


SUBSETS = """mm AS (SELECT pair_id, count(DISTINCT pair_role) AS roles FROM scores WHERE item_type = 'factual' GROUP BY 1),
sb AS (SELECT s.*, unnest(['all_factual', 'domain:' || domain, CASE WHEN roles = 2 THEN 'minimal_pair_items' ELSE 'unpaired_items' END]) AS subset
  FROM scores s JOIN mm USING (pair_id) WHERE item_type = 'factual')"""
KAPPA = """cells AS (SELECT {by}, a, b, count(*) AS c FROM {src} GROUP BY ALL),
tot AS (SELECT {by}, sum(c)::BIGINT AS n, coalesce(sum(c) FILTER (a = b), 0)::DOUBLE / sum(c) AS agreement FROM cells GROUP BY ALL),
la AS (SELECT {by}, a AS l, sum(c)::DOUBLE AS x FROM cells GROUP BY ALL), lb AS (SELECT {by}, b AS l, sum(c)::DOUBLE AS y FROM cells GROUP BY ALL),
pe AS (SELECT {by}, sum(x * y) AS e FROM la JOIN lb USING ({by}, l) GROUP BY ALL),
ka AS (SELECT {by}, n, agreement, coalesce(e, 0) / (n::DOUBLE * n) AS expected FROM tot LEFT JOIN pe USING ({by}))
SELECT {out} n, round(agreement, 9) AS agreement, round(expected, 9) AS expected, round(CASE WHEN expected < 1 THEN (agreement - expected) / (1 - expected) END, 9) AS kappa FROM ka"""

#: The measures of every replicate; -1 takes each family once. Harmonic numbers are a table.
REPLICATES = f"""hn AS (SELECT i, sum(1.0::DOUBLE / i) OVER (ORDER BY i) AS har FROM (SELECT range AS i FROM range(1, 100000))), h0 AS (SELECT 0 AS i, 0.0::DOUBLE AS har UNION ALL SELECT * FROM hn),
ce AS (SELECT arm, family, confidence, count(*) AS m, count(*) FILTER (correct) AS h FROM f WHERE confidence IS NOT NULL GROUP BY ALL),
dd AS (SELECT arm, confidence, m, h, rep, times FROM ({_draws('ce')}) UNION ALL SELECT arm, confidence, m, h, -1, 1 FROM ce),
ti AS (SELECT arm, rep, confidence, sum(m * times)::BIGINT AS m, sum(h * times)::BIGINT AS h FROM dd GROUP BY ALL),
tb AS (SELECT *, coalesce(sum(m) OVER o, 0)::BIGINT AS b, coalesce(sum(h) OVER o, 0)::BIGINT AS bh, (sum(m) OVER (PARTITION BY arm, rep))::BIGINT AS n FROM ti WINDOW o AS (PARTITION BY arm, rep ORDER BY confidence DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pt AS (SELECT *, (b + m)::DOUBLE / n AS cov, (bh + h)::DOUBLE / (b + m) AS acc FROM tb),
v0 AS (SELECT arm, rep, sum(m) AS n, sum(pt.h) AS hits, sum(m * (1 - pt.h::DOUBLE / m) - (bh - pt.h::DOUBLE / m * b) * (y.har - x.har)) / sum(m) AS aurc,
  arg_min(acc, b) FILTER (cov >= 0.25 - 1e-12) AS at_25, arg_min(acc, b) FILTER (cov >= 0.5 - 1e-12) AS at_50, arg_min(acc, b) FILTER (cov >= 0.75 - 1e-12) AS at_75 FROM pt JOIN h0 x ON x.i = b JOIN h0 y ON y.i = b + m GROUP BY ALL),
v AS (SELECT v0.*, ((n - hits) - hits * (y.har - x.har)) / n AS best FROM v0 JOIN h0 x ON x.i = hits JOIN h0 y ON y.i = n)"""

#: The same tests within each repeat.
MCR = MC.replace("x.repeat = 0 AND y.repeat = 0", "x.repeat = y.repeat").replace("x.family, x.correct", "x.repeat, x.family, x.correct").replace("SELECT arm_a, arm_b, count(*)", "SELECT repeat, arm_a, arm_b, count(*)").replace("mc AS (SELECT arm_a", "mc AS (SELECT repeat, arm_a")

ORACLES = {
    "ece_interval": f"""{EVERY}, c AS (SELECT *, least(floor(confidence * 10), 9) AS bin FROM f WHERE confidence IS NOT NULL),
ce AS (SELECT arm, family, bin, count(*) AS m, sum(confidence) AS s, count(*) FILTER (correct) AS h FROM c GROUP BY ALL),
bi AS (SELECT arm, rep, bin, sum(m * times) AS m, abs(sum(s * times) - sum(h * times)) AS g FROM ({_draws('ce')}) GROUP BY ALL), v AS (SELECT arm, rep, sum(g) / sum(m) AS val FROM bi GROUP BY ALL),
wh AS (SELECT arm, sum(g) / sum(m) AS estimate FROM (SELECT arm, bin, sum(m) AS m, abs(sum(s) - sum(h)) AS g FROM ce GROUP BY ALL) GROUP BY ALL)
SELECT arm, (SELECT count(DISTINCT family) FROM ce WHERE ce.arm = v.arm) AS n_clusters, round(any_value(estimate), 6) AS estimate, round(quantile_cont(val, 0.025), 6) AS ci_low, round(quantile_cont(val, 0.975), 6) AS ci_high FROM v JOIN wh USING (arm) GROUP BY arm""",
    "rating_disagreements": "WITH r AS (SELECT doc_id AS rating_id, quality::INT AS human, CASE WHEN length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) * 20 > length(text) THEN 0 ELSE 1 END AS automatic FROM labels JOIN documents USING (doc_id)) SELECT * FROM r WHERE human <> automatic",
    "repeat_sensitivity": f"{W}, {MCR} SELECT arm_a, arm_b, count(*) AS n_repeats, round(max(p_value) FILTER (repeat = 0), 9) AS p_first, round(min(p_value), 9) AS p_min, round(max(p_value), 9) AS p_max FROM mc GROUP BY ALL",
    "clopper_pearson": f"""{W.replace('WITH', 'WITH RECURSIVE', 1)}, m AS (SELECT arm, count(*) FILTER (correct) AS k, count(*) AS n FROM scores GROUP BY ALL),
s AS (SELECT arm, k, n, unnest([0, 1]) AS side, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM m),
bi AS (SELECT * FROM s UNION ALL SELECT arm, k, n, side, CASE WHEN below THEN mid ELSE lo END, CASE WHEN below THEN hi ELSE mid END, step + 1
  FROM (SELECT *, CASE WHEN side = 0 THEN t < 0.025 ELSE t > 0.025 END AS below FROM (SELECT *, (lo + hi) / 2 AS mid,
    list_sum(list_transform(range(CASE WHEN side = 0 THEN k ELSE 0 END, CASE WHEN side = 0 THEN n ELSE k END + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln((lo + hi) / 2) + (n - j) * ln(1 - (lo + hi) / 2)))) AS t FROM bi WHERE step < 45))),
e AS (SELECT arm, k, n, max(CASE WHEN side = 0 THEN CASE WHEN k = 0 THEN 0 ELSE lo END END) AS lo, max(CASE WHEN side = 1 THEN CASE WHEN k = n THEN 1 ELSE lo END END) AS hi FROM bi WHERE step = 45 GROUP BY ALL)
SELECT arm, k, n, round(lo, 9) AS ci_low, round(hi, 9) AS ci_high FROM e""",
    "corpus_summary": f"""{W}, i AS (SELECT DISTINCT item_id, domain, family, pair_id, pair_role, risk_tier, item_type FROM scores),
u AS (SELECT 'all' AS scope, 'all' AS label, * FROM i UNION ALL SELECT 'domain', domain, * FROM i UNION ALL SELECT 'risk_tier', risk_tier, * FROM i)
SELECT scope, label, count(*) AS n_items, count(*) FILTER (item_type = 'factual') AS n_factual, count(DISTINCT family) AS n_families, count(DISTINCT pair_id) FILTER (pair_role = 'a') AS n_pairs FROM u GROUP BY ALL""",
    "outcome_composition": f"{W} , g AS (SELECT arm, item_type, outcome, count(*) AS n FROM scores GROUP BY ALL) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY arm, item_type), 9) AS proportion FROM g",
    "citation_table": f"{W} , g AS (SELECT arm, citation_grade, count(*) AS n FROM scores GROUP BY ALL) SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY arm), 9) AS proportion FROM g",
    "arm_summary": f"""{W}, {PAIRS.format(src="(SELECT * FROM scores WHERE item_type = 'factual')")},
pa AS (SELECT arm, repeat, avg((a_correct AND b_correct)::INT) AS a FROM pr GROUP BY ALL), pp AS (SELECT arm, avg(a) AS paired_accuracy FROM pa GROUP BY ALL),
rp AS (SELECT arm, repeat, avg(correct::INT) AS a FROM scores WHERE item_type = 'factual' GROUP BY ALL), sp AS (SELECT arm, max(a) - min(a) AS accuracy_spread FROM rp GROUP BY ALL),
m AS (SELECT arm, count(DISTINCT repeat) AS n_repeats, count(*) FILTER (item_type = 'factual') AS n, count(*) FILTER (item_type = 'factual' AND correct) AS k,
  count(*) FILTER (item_type = 'factual' AND outcome <> 'unscorable') AS ns,
  avg((outcome = 'adjacent_substitution')::INT) FILTER (item_type = 'factual') AS adjacent_rate, avg((outcome = 'abstained')::INT) FILTER (item_type = 'factual') AS abstention_rate,
  avg((outcome = 'abstained')::INT) FILTER (item_type = 'category_error') AS declined_rate, avg((outcome = 'unscorable')::INT) AS unscorable_rate,
  avg((citation_grade = 'correct_clause')::INT) AS correct_clause_rate, avg(paywalled::INT) AS fabricated_paywalled_rate FROM scores GROUP BY ALL)
SELECT arm, n_repeats, n AS n_factual_obs, round(k::DOUBLE / n, 9) AS accuracy, round(k::DOUBLE / ns, 9) AS scorable_accuracy, round(adjacent_rate, 9) AS adjacent_rate,
  round(abstention_rate, 9) AS abstention_rate, round(declined_rate, 9) AS declined_rate, round(unscorable_rate, 9) AS unscorable_rate, round(correct_clause_rate, 9) AS correct_clause_rate,
  round(fabricated_paywalled_rate, 9) AS fabricated_paywalled_rate, round(accuracy_spread, 9) AS accuracy_spread, round(paired_accuracy, 9) AS paired_accuracy,
  round({WILSON.format(k='k', n='n', s='-')}, 9) AS wilson_low, round({WILSON.format(k='k', n='n', s='+')}, 9) AS wilson_high FROM m LEFT JOIN sp USING (arm) LEFT JOIN pp USING (arm)""",
    "wilson_interval": f"""{W}, m AS (SELECT arm, count(*) AS n, count(*) FILTER (correct) AS k FROM scores WHERE item_type = 'factual' GROUP BY ALL)
SELECT arm, round({WILSON.format(k='k', n='n', s='-')}, 9) AS wilson_low, round({WILSON.format(k='k', n='n', s='+')}, 9) AS wilson_high FROM m""",
    "paired_accuracy": f"""{W}, {PAIRS.format(src="(SELECT * FROM scores WHERE item_type = 'factual')")}
SELECT arm, count(*) FILTER (a_correct AND b_correct) AS n_both, count(*) AS n_pairs, round(avg((a_correct AND b_correct)::INT), 9) AS paired_accuracy FROM pr GROUP BY ALL""",
    "paired_table": f"{W}, {PAIRS.format(src='scores')} SELECT * FROM pr",
    "pair_partition": f"""{FIRST}, {PAIRS.format(src='f')} SELECT arm, count(*) AS n_pairs, count(*) FILTER (a_correct AND b_correct) AS both_pass, count(*) FILTER (a_correct <> b_correct) AS one_pass,
  count(*) FILTER (NOT a_correct AND NOT b_correct) AS neither_pass FROM pr GROUP BY ALL""",
    "breakdown_subsets": f"""{W}, {SUBSETS}, {PAIRS.format(src="(SELECT * FROM scores WHERE item_type = 'factual')")}
SELECT arm, subset, count(DISTINCT item_id) AS n_items, count(*) AS n_obs, round(avg(correct::INT), 9) AS accuracy FROM sb GROUP BY ALL
UNION ALL SELECT arm, 'pairs_both_correct', count(DISTINCT pair_id), count(*), round(avg((a_correct AND b_correct)::INT), 9) FROM pr GROUP BY arm""",
    "breakdown_intervals": f"""{W}, {SUBSETS}, sv AS (SELECT *, correct::INT AS v FROM sb), {_boot('sv', 'arm, subset')}
SELECT arm, subset, nc AS n_clusters, round(estimate, 6) AS estimate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM gn JOIN bs USING (arm, subset)""",
    "utility_policy": f"""{W}, u AS (SELECT arm, 'safety' AS policy, CASE WHEN outcome = 'abstained' AND abstention_acceptable THEN 0.9 WHEN outcome = 'correct' THEN 1 WHEN outcome = 'abstained' THEN 0.25
  WHEN outcome = 'other_incorrect' THEN -0.5 WHEN outcome = 'adjacent_substitution' THEN -1 ELSE 0 END::DOUBLE AS u, CASE risk_tier WHEN 'high' THEN 1 WHEN 'medium' THEN 0.6 ELSE 0.3 END::DOUBLE AS w FROM scores
  UNION ALL SELECT arm, 'accuracy', correct::INT::DOUBLE, CASE risk_tier WHEN 'high' THEN 1 WHEN 'medium' THEN 0.6 ELSE 0.3 END::DOUBLE FROM scores)
SELECT arm, policy, round(avg(u), 9) AS mean_utility, round(sum(u * w) / sum(w), 9) AS risk_weighted FROM u GROUP BY ALL""",
    "identical_item_sets": f"""{W}, h AS (SELECT DISTINCT arm, item_id, repeat FROM scores), a AS (SELECT DISTINCT arm FROM h), p AS (SELECT x.arm AS arm_a, y.arm AS arm_b FROM a x JOIN a y ON x.arm < y.arm)
SELECT arm_a, arm_b, (SELECT count(*) FROM h x WHERE x.arm = arm_a AND NOT EXISTS (SELECT 1 FROM h y WHERE y.arm = arm_b AND y.item_id = x.item_id AND y.repeat = x.repeat)) AS only_a,
  (SELECT count(*) FROM h x WHERE x.arm = arm_b AND NOT EXISTS (SELECT 1 FROM h y WHERE y.arm = arm_a AND y.item_id = x.item_id AND y.repeat = x.repeat)) AS only_b FROM p""",
    "release_gate": f"""{W}, g AS (SELECT arm, avg(correct::INT) FILTER (item_type = 'factual') AS a, avg((outcome = 'abstained')::INT) FILTER (item_type = 'factual') AS b,
  avg((outcome = 'abstained')::INT) FILTER (item_type = 'category_error') AS c, avg(correct::INT) FILTER (item_type = 'factual' AND outcome NOT IN ('abstained', 'unscorable')) AS p FROM scores GROUP BY ALL)
SELECT arm, round(a, 9) AS accuracy, round(b, 9) AS abstained, round(c, 9) AS declined, round(p, 9) AS precision_answered, coalesce(a >= 0.3 AND p >= 0.4 AND b <= 0.5, false) AS passes FROM g""",
    "risk_coverage_rows": f"""{EVERY}, c AS (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY confidence DESC, item_id, repeat) AS rank FROM f WHERE confidence IS NOT NULL)
SELECT arm, item_id, repeat, rank, round(rank::DOUBLE / count(*) OVER (PARTITION BY arm), 9) AS coverage, round((sum(correct::INT) OVER (PARTITION BY arm ORDER BY rank))::DOUBLE / rank, 9) AS selective_accuracy FROM c""",
    "risk_coverage_points": f"{EVERY}, {POINTS} SELECT arm, threshold, n_answered, round(coverage, 9) AS coverage, round(selective_accuracy, 9) AS selective_accuracy, round(1 - selective_accuracy, 9) AS selective_risk FROM p",
    "aurc": f"""{EVERY}, {TIES}, x AS (SELECT arm, sum(m * (1 - h::DOUBLE / m) - (bh - h::DOUBLE / m * b) * (coalesce({HAR.format(n='b + m')}, 0) - coalesce({HAR.format(n='b')}, 0))) AS area, sum(m)::BIGINT AS n, sum(h)::BIGINT AS h FROM t GROUP BY ALL),
y AS (SELECT *, ((n - h) - h * (coalesce({HAR.format(n='n')}, 0) - coalesce({HAR.format(n='h')}, 0))) / n AS best FROM x)
SELECT arm, n, round(area / n, 9) AS aurc, round(1 - h::DOUBLE / n, 9) AS aurc_random, round(best, 9) AS aurc_optimal, round(area / n - best, 9) + 0.0 AS e_aurc FROM y""",
    "selective_at_coverage": f"""{EVERY}, {POINTS} SELECT arm, target::DOUBLE AS target, round(coverage, 9) AS coverage, round(selective_accuracy, 9) AS selective_accuracy
FROM p, (VALUES (0.25), (0.5), (0.75)) AS v(target) WHERE coverage >= target - 1e-12 QUALIFY row_number() OVER (PARTITION BY arm, target ORDER BY n_answered) = 1""",
    "threshold_curve": f"""{FIRST}, c AS (SELECT * FROM f WHERE confidence IS NOT NULL), th AS (SELECT DISTINCT arm, confidence AS threshold FROM c),
pr AS (SELECT arm, pair_id, min(confidence) AS lo, max(confidence) AS hi, bool_and(correct) AS ok FROM c GROUP BY ALL HAVING count(*) = 2)
SELECT arm, threshold, (SELECT count(*) FROM c WHERE c.arm = th.arm AND confidence >= threshold) AS n_answered, (SELECT count(*) FROM c WHERE c.arm = th.arm AND confidence >= threshold AND correct) AS n_pass,
  round((SELECT count(*) FROM c WHERE c.arm = th.arm AND confidence >= threshold)::DOUBLE / (SELECT count(*) FROM c WHERE c.arm = th.arm), 9) AS coverage,
  (SELECT count(*) FROM pr WHERE pr.arm = th.arm AND lo >= threshold) AS complete_pairs, (SELECT count(*) FROM pr WHERE pr.arm = th.arm AND hi >= threshold AND lo < threshold) AS fractured_pairs,
  (SELECT count(*) FROM pr WHERE pr.arm = th.arm AND lo >= threshold AND ok) AS both_pass_pairs FROM th""",
    "brier": f"""{EVERY} SELECT arm, count(*) AS n, round(avg((confidence - correct::INT) * (confidence - correct::INT)), 9) AS brier, round(avg(correct::INT) * (1 - avg(correct::INT)), 9) AS brier_constant,
  round(avg(confidence), 9) AS mean_confidence FROM f WHERE confidence IS NOT NULL GROUP BY ALL""",
    "reliability_table": f"{EVERY}, {BINS} SELECT arm, bin, round(bin / 10.0::DOUBLE, 9) AS low, round((bin + 1) / 10.0::DOUBLE, 9) AS high, n, round(mean_confidence, 9) AS mean_confidence, round(accuracy, 9) AS accuracy FROM r",
    "ece": f"{EVERY}, {BINS} SELECT arm, round(sum(n * abs(mean_confidence - accuracy)) / sum(n), 9) AS ece FROM r GROUP BY ALL",
    "mcnemar_exact": f'{W}, {MC} SELECT arm_a, arm_b, both_right, a_only, b_only, neither, n, round(p_value, 9) AS p_value FROM mc',
    "holm_adjust": f"{W}, {MC}{HOLM} SELECT arm_a, arm_b, round(p_value, 9) AS p_value, round(p_holm, 9) AS p_holm FROM ho",
    "arm_comparisons": f"""{W}, {MC}{HOLM}, sv AS (SELECT arm_a, arm_b, family, x::INT - y::INT AS v FROM d), {_boot('sv', 'arm_a, arm_b')}
SELECT arm_a, arm_b, n, a_only, b_only, round(p_value, 6) AS p_value, round(p_holm, 6) AS p_holm, round(estimate, 6) AS difference, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, p_holm < 0.05 AS significant
FROM ho JOIN gn USING (arm_a, arm_b) JOIN bs USING (arm_a, arm_b)""",
    "bootstrap_accuracy": f"""{W}, sv AS (SELECT arm, family, correct::INT AS v FROM scores WHERE item_type = 'factual'), {_boot('sv', 'arm')}
SELECT arm, nc AS n_clusters, round(estimate, 6) AS estimate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM gn JOIN bs USING (arm)""",
    "bootstrap_aurc": f"""{EVERY}, {REPLICATES} SELECT arm, round(quantile_cont(aurc, 0.025), 6) AS ci_low, round(quantile_cont(aurc, 0.975), 6) AS ci_high FROM v WHERE rep >= 0 GROUP BY arm""",
    "selective_intervals": f"""{EVERY}, {REPLICATES}, lo AS (SELECT arm, rep, unnest(['aurc', 'e_aurc', 'accuracy_at_25', 'accuracy_at_50', 'accuracy_at_75']) AS measure, unnest([aurc, aurc - best, at_25, at_50, at_75]) AS val FROM v)
SELECT arm, measure, round(max(val) FILTER (rep = -1), 6) + 0.0 AS estimate, round(quantile_cont(val, 0.025) FILTER (rep >= 0), 6) + 0.0 AS ci_low, round(quantile_cont(val, 0.975) FILTER (rep >= 0), 6) + 0.0 AS ci_high FROM lo GROUP BY ALL""",
    "guarded_comparison": f"""{W.replace('scores AS (', 'every_score AS (')}, ar AS (SELECT count(DISTINCT arm) AS n FROM every_score), sh AS (SELECT item_id, repeat FROM every_score GROUP BY ALL HAVING count(DISTINCT arm) = (SELECT n FROM ar)),
scores AS (SELECT * FROM every_score SEMI JOIN sh USING (item_id, repeat)), {MC}{HOLM}, sv AS (SELECT arm_a, arm_b, family, x::INT - y::INT AS v FROM d), {_boot('sv', 'arm_a, arm_b')}
SELECT arm_a, arm_b, n, a_only, b_only, round(p_value, 6) AS p_value, round(p_holm, 6) AS p_holm, round(estimate, 6) AS difference, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, p_holm < 0.05 AS significant
FROM ho JOIN gn USING (arm_a, arm_b) JOIN bs USING (arm_a, arm_b)""",
    "cohen_kappa": "WITH r AS (SELECT 1 AS one, quality::INT AS a, CASE WHEN length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) * 20 > length(text) THEN 0 ELSE 1 END AS b FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), " + KAPPA.format(by="one", src="r", out=""),
    "multiclass_kappa": f"{FIRST}, r AS (SELECT arm, CASE WHEN item_id % 5 = 0 THEN 'other_incorrect' ELSE outcome END AS a, outcome AS b FROM f), " + KAPPA.format(by="arm", src="r", out="arm,"),
    "fleiss_kappa": f"""{FIRST}, i AS (SELECT item_id, count(*) AS r, count(*) FILTER (correct) AS c FROM f GROUP BY ALL), m AS (SELECT * FROM i WHERE r = (SELECT max(r) FROM i)),
s AS (SELECT count(*) AS n_items, max(r) AS n_raters, avg((c * c + (r - c) * (r - c) - r)::DOUBLE / (r * (r - 1))) AS pa, sum(c)::DOUBLE / sum(r) AS p FROM m)
SELECT n_items, n_raters, round(pa, 9) AS mean_agreement, round(p * p + (1 - p) * (1 - p), 9) AS expected, round((pa - (p * p + (1 - p) * (1 - p))) / (1 - (p * p + (1 - p) * (1 - p))), 9) AS kappa FROM s""",
    "item_difficulty": f"{FIRST} SELECT item_id, count(*) AS n_raters, count(*) FILTER (correct) AS n_correct, round(avg(correct::INT), 9) AS difficulty FROM f GROUP BY ALL",
    "point_biserial": f"""{FIRST}, s AS (SELECT *, correct::INT AS x, (sum(correct::INT) OVER (PARTITION BY item_id)) - correct::INT AS y FROM f)
SELECT arm, count(*) AS n, round(CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 9) AS discrimination FROM s GROUP BY ALL""",
    "ratable_rows": f"{W} SELECT arm, repeat, item_id, outcome AS automatic_outcome, min(domain) OVER (PARTITION BY item_id) AS question, arm || ' ' || repeat AS response_text FROM scores WHERE item_id % 3 <> 0 AND item_id % 5 <> 0 QUALIFY outcome <> 'unscorable'",
    "stratified_sample": f"""{W}, h AS (SELECT *, md5(concat_ws('|', '20260904', arm, item_id::VARCHAR, repeat::VARCHAR)) AS h, md5(concat_ws('|', '20260904id', arm, item_id::VARCHAR, repeat::VARCHAR)) AS g FROM scores),
r AS (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY h, arm, item_id, repeat) AS r, count(*) OVER (PARTITION BY outcome) AS n FROM h), p AS (SELECT * FROM r WHERE r <= greatest(1, round_even(n * 0.2::DOUBLE, 0)))
SELECT 'adj-' || lpad((row_number() OVER (ORDER BY g, arm, item_id, repeat) - 1)::VARCHAR, 4, '0') AS rating_id, arm, item_id, repeat, outcome FROM p""",
}
