"""Queries on evidence operators and on the intervals of summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import evidence as E
from plumbline.operators import reports, selective, significance
from plumbline.operators import retrieval as R
from plumbline.plans.retrieval import BASE, PLUS, TOP, _index
from plumbline.plans.scores import SCORES_SQL, scores
from plumbline.plans.statistics import DRAWS, EVERY, HAR, POINTS, _boot
from plumbline.plans.statistics import ORACLES as STATISTICS_SQL
from plumbline.session import table


def _search(s, d):
    i = F.col("doc_id")
    rows = table(s, d, "documents").select("doc_id", "lang", "source", "text", (i % 3 == 0).alias("baseline"), (i % 2 == 0).alias("attainable"), (i % 5 < 2).alias("attainable_bare"), (i % 7 > 2).alias("own_passes"))
    return reduce(DataFrame.unionByName, [E.search(rows, "SRC1", ["doc_id", "lang", "source", "text"], n).groupBy(F.lit(n).alias("filter")).agg(F.count("*").alias("n")) for n in E.FILTERS])


def _json(s, d):
    talk = table(s, d, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("role"))).alias("_j"))
    return talk.select("conv_id", E.count_where(F.col("_j"), "role", "user").alias("n_user"), E.count_where(F.col("_j"), "name", "").alias("n_unnamed"))


def _dig(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.sum(E.dig(F.col("props"), "k").cast("long")).alias("total"), F.count(E.dig(F.col("props"), "a.b")).alias("n_deep"))


def _prompts(s, d):
    asked = table(s, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("_q"))
    docs = table(s, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("_e"))
    p = E.prompt(F.col("_q"), F.col("_e"))
    return asked.join(docs, "conv_id", "left").select("conv_id", "turn", E.short_hash(p).alias("prompt_hash"), F.length(p).cast("long").alias("n_chars"))


def _baseline(s, d):
    i = F.col("doc_id")
    docs = table(s, d, "documents").withColumn("lang", F.coalesce("lang", F.lit("none")))
    moved = lambda k: F.when(i % 10 == k, -k - 10 * i).otherwise(i).alias("item_id")  # noqa: E731  ids that the other side lacks
    fresh = docs.select(moved(1), "text", F.col("lang").alias("outcome"))
    stored = docs.select(moved(2), (i % 50 == 0).alias("is_mock"), F.when(i % 9 == 0, "old").otherwise(F.lit("d")).alias("digest"), F.when(i % 8 == 0, "x").otherwise(F.col("text")).alias("text"), F.when(i % 12 == 0, "xx").otherwise(F.col("lang")).alias("outcome"))
    return E.baseline_problems(stored, fresh, "d")


def _mock(s, d):
    items = table(s, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("correct_answer"), F.col("source").alias("adjacent_answer"))
    each = [E.mock(items, p, repeat=1).withColumn("profile", F.lit(k)) for k, p in E.PROFILES.items()]
    return reduce(DataFrame.unionByName, each).select("profile", "item_id", "branch", F.md5("text").alias("digest"), F.round("confidence", 9).alias("confidence"), "is_mock")


def _intervals(s, d):
    """Accuracy and adjacent rate over factual rows, clause rate and utility over all, from one set of draws."""
    fact = F.col("item_type") == "factual"
    values = {"accuracy": F.when(fact, F.col("correct").cast("double")), "adjacent": F.when(fact, (F.col("outcome") == "adjacent_substitution").cast("double")), "clause": (F.col("citation_grade") == "correct_clause").cast("double"), "utility": reports.utility()}
    out = significance.bootstrap(scores(s, d), ["arm"], "family", *significance.means(values)).withColumnRenamed("measure", "metric")
    return out.drop("n_clusters").withColumns({c: F.round(c, 6) for c in ("estimate", "ci_low", "ci_high")})


def _summary(s, d):
    out = reports.summarize(scores(s, d))
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


def _brier(s, d):
    gap = F.col("confidence") - F.col("correct").cast("double")
    out = significance.bootstrap_mean(selective.confident(scores(s, d)), ["arm"], "family", gap * gap, DRAWS)
    return out.withColumns({c: F.round(c, 6) for c in ("estimate", "ci_low", "ci_high")})


def _selective(s, d):
    rows = scores(s, d)
    points = selective.at_coverage(rows).groupBy("arm").pivot("target", [0.25, 0.5, 0.75]).agg(F.first("selective_accuracy"))
    points = points.toDF("arm", "at_25", "at_50", "at_75")
    distinct = selective.confident(rows).groupBy("arm").agg(F.count_distinct("confidence").alias("n_distinct"))
    out = selective.aurc(rows).select("arm", "n", "aurc").join(points, "arm").join(distinct, "arm")
    return out.withColumns({c: F.round(c, 9) for c in ("aurc", "at_25", "at_50", "at_75")})


def _self_match(s, d):
    index, queries, terms = _index(s, d)
    best = R.saved(R.best(index, terms, queries, "bm25plus", 1, every=False), "retrieval-hits")
    hits = best.join(queries.withColumnRenamed("text", "_q"), "query_id").join(R.of_hits(table(s, d, "documents").select("doc_id", "text"), best), "doc_id")
    return hits.agg(F.count("*").alias("n"), F.count_if(F.contains("text", "_q")).alias("n_self"))


QUERIES = {
    "evidence_search": _search,
    "json_count": _json,
    "json_path": _dig,
    "prompt_build": _prompts,
    "baseline_checks": _baseline,
    "mock_responses": _mock,
    "summary_intervals": _intervals,
    "summary_full": _summary,
    "brier_interval": _brier,
    "selective_summary": _selective,
    "self_match": _self_match,
}

#: Rounded sixth decimals of the two parts of a summary, joined.
SUMMARY = """SELECT a.* REPLACE ({rounded}), {ends}, mean_utility, (SELECT count(DISTINCT family) FROM fam WHERE fam.arm = a.arm) AS n_clusters, (SELECT count(DISTINCT item_id) FROM fam WHERE fam.arm = a.arm) AS n_items, 'safety' AS utility_policy
FROM ({summary}) a JOIN (SELECT arm, {picks}, max(estimate) FILTER (metric = 'utility') AS mean_utility FROM ({intervals}) GROUP BY arm) b USING (arm)"""
RATES = ["accuracy", "scorable_accuracy", "adjacent_rate", "abstention_rate", "declined_rate", "unscorable_rate", "correct_clause_rate", "fabricated_paywalled_rate", "accuracy_spread", "paired_accuracy", "wilson_low", "wilson_high"]

U = "('0x' || substr(md5(concat_ws('|', '20260903', '1', '{}', doc_id::VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
ORACLES = {
    "evidence_search": """WITH r AS (SELECT doc_id % 3 = 0 AS b, doc_id % 2 = 0 AS a, doc_id % 5 < 2 AS ab, doc_id % 7 > 2 AS o FROM documents WHERE contains(replace(lower(concat_ws(' ', doc_id::VARCHAR, lang, source, text)), '_', ' '), 'src1')),
f AS (SELECT unnest(['all', CASE WHEN b THEN 'baseline' END, CASE WHEN NOT b AND a THEN 'recoverable' END, CASE WHEN NOT a THEN 'unreachable' END, CASE WHEN NOT o THEN 'own-fails' END, CASE WHEN a <> ab THEN 'metadata' END]) AS filter FROM r)
SELECT filter, count(*) AS n FROM f WHERE filter IS NOT NULL GROUP BY ALL""",
    "json_count": "SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) AS n_unnamed FROM conversations GROUP BY ALL",
    "json_path": """SELECT event_type, sum(regexp_extract(props, '"k": *([0-9]+)', 1)::BIGINT)::BIGINT AS total, 0::BIGINT AS n_deep FROM events GROUP BY ALL""",
    "prompt_build": r"""WITH p AS (SELECT conv_id, turn, CASE WHEN d.text IS NULL THEN c.text ELSE 'Excerpt:' || chr(10) || d.text || chr(10) || chr(10) || 'Question:' || chr(10) || c.text END AS p
FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE role = 'user') SELECT conv_id, turn, left(sha256(p), 16) AS prompt_hash, length(p)::BIGINT AS n_chars FROM p""",
    "baseline_checks": """WITH d AS (SELECT doc_id AS i, doc_id % 10 NOT IN (1, 2) AS met, text FROM documents)
SELECT 'mock' AS problem, count(*) FILTER (i % 50 = 0) AS n FROM d UNION ALL SELECT 'digest', count(*) FILTER (i % 9 = 0) FROM d UNION ALL SELECT 'missing', count(*) FILTER (NOT met) FROM d UNION ALL SELECT 'unknown', count(*) FILTER (NOT met) FROM d
UNION ALL SELECT 'excerpt_drift', count(*) FILTER (met AND i % 8 = 0 AND text IS DISTINCT FROM 'x') FROM d UNION ALL SELECT 'score_drift', count(*) FILTER (met AND i % 12 = 0) FROM d UNION ALL SELECT 'duplicate', 0 FROM (SELECT 1)""",
    "mock_responses": f"""WITH p(profile, a, b, c, s0, s1, u0, u1) AS (VALUES {', '.join(f"('{k}', {p.correct}::DOUBLE, {p.correct}::DOUBLE + {p.adjacent}::DOUBLE, {p.correct}::DOUBLE + {p.adjacent}::DOUBLE + {p.abstain}::DOUBLE, {p.sure[0]}::DOUBLE, {p.sure[1]}::DOUBLE, {p.unsure[0]}::DOUBLE, {p.unsure[1]}::DOUBLE)" for k, p in E.PROFILES.items())}),
d AS (SELECT doc_id, text, source, {U.format('branch')} AS u, {U.format('confidence')} AS x FROM documents),
r AS (SELECT *, CASE WHEN u < a THEN 'correct' WHEN u < b THEN 'adjacent' WHEN u < c THEN 'abstain' ELSE 'other' END AS branch FROM d CROSS JOIN p)
SELECT profile, doc_id AS item_id, branch, md5(coalesce(CASE branch WHEN 'correct' THEN text WHEN 'adjacent' THEN source WHEN 'abstain' THEN 'I do not know.' ELSE 'Another rule holds here.' END, '')) AS digest,
  round(CASE WHEN branch = 'correct' THEN s0 + x * (s1 - s0) ELSE u0 + x * (u1 - u0) END, 9) AS confidence, true AS is_mock FROM r""",
    "summary_intervals": f"""WITH {SCORES_SQL}, sv AS (SELECT arm, family, 'accuracy' AS metric, correct::INT::DOUBLE AS v FROM scores WHERE item_type = 'factual' UNION ALL SELECT arm, family, 'adjacent', (outcome = 'adjacent_substitution')::INT FROM scores WHERE item_type = 'factual'
UNION ALL SELECT arm, family, 'clause', (citation_grade = 'correct_clause')::INT FROM scores UNION ALL SELECT arm, family, 'utility', CASE WHEN outcome = 'abstained' AND abstention_acceptable THEN 0.9 WHEN outcome = 'correct' THEN 1 WHEN outcome = 'abstained' THEN 0.25
  WHEN outcome = 'other_incorrect' THEN -0.5 WHEN outcome = 'adjacent_substitution' THEN -1 ELSE 0 END FROM scores), {_boot('sv', 'arm, metric')}
SELECT arm, metric, round(estimate, 6) AS estimate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM gn JOIN bs USING (arm, metric)""",
    "brier_interval": f"""{EVERY}, sv AS (SELECT arm, family, (confidence - correct::INT) * (confidence - correct::INT) AS v FROM f WHERE confidence IS NOT NULL), {_boot('sv', 'arm')}
SELECT arm, nc AS n_clusters, round(estimate, 6) AS estimate, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM gn JOIN bs USING (arm)""",
    "selective_summary": f"""{EVERY}, {POINTS}, x AS (SELECT arm, sum(m * (1 - h::DOUBLE / m) - (bh - h::DOUBLE / m * b) * (coalesce({HAR.format(n='b + m')}, 0) - coalesce({HAR.format(n='b')}, 0))) / sum(m) AS aurc, sum(m)::BIGINT AS n, count(*) AS n_distinct FROM t GROUP BY ALL),
a AS (SELECT arm, target, selective_accuracy AS s FROM p, (VALUES (0.25), (0.5), (0.75)) AS v(target) WHERE coverage >= target - 1e-12 QUALIFY row_number() OVER (PARTITION BY arm, target ORDER BY n_answered) = 1)
SELECT arm, n, round(aurc, 9) AS aurc, n_distinct, round((SELECT s FROM a WHERE a.arm = x.arm AND target = 0.25), 9) AS at_25, round((SELECT s FROM a WHERE a.arm = x.arm AND target = 0.5), 9) AS at_50, round((SELECT s FROM a WHERE a.arm = x.arm AND target = 0.75), 9) AS at_75 FROM x""",
    "self_match": f"{BASE}, {PLUS}, t AS ({TOP.format('p').replace('rank <= 3', 'rank = 1')}) SELECT count(*) AS n, count(*) FILTER (contains(d.text, b.text)) AS n_self FROM t JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id)",
}
ENDS = [(m, c) for m in ("accuracy", "adjacent", "clause", "utility") for c in ("ci_low", "ci_high")]
ORACLES["summary_full"] = f"WITH {SCORES_SQL}, fam AS (SELECT arm, family, item_id FROM scores) " + SUMMARY.format(
    rounded=", ".join(f"round({c}, 6) AS {c}" for c in RATES), ends=", ".join(f"{m}_{c}" for m, c in ENDS), picks=", ".join(f"max({c}) FILTER (metric = '{m}') AS {m}_{c}" for m, c in ENDS),
    summary=STATISTICS_SQL["arm_summary"], intervals=ORACLES["summary_intervals"],
)
