"""Retrieval queries: benchmark passages as queries against all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import retrieval as R
from plumbline.session import table


def _tables(s, d):
    docs = table(s, d, "documents").select("doc_id", "text")
    queries = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return docs, queries, R.query_terms(queries)


def _index(s, d):
    docs, queries, terms = _tables(s, d)
    return R.build(docs, terms), queries, terms


def _out(df):
    return df.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def _bm25(s, d):
    index, queries, terms = _index(s, d)
    return _out(R.best(index, terms, queries, "bm25"))


def _bm25plus(s, d):
    index, queries, terms = _index(s, d)
    return _out(R.best(index, terms, queries, "bm25plus"))


def _tfidf(s, d):
    index, queries, terms = _index(s, d)
    return _out(R.best(index, terms, queries, "tfidf"))


def _rrf(s, d):
    index, queries, terms = _index(s, d)
    fused = R.fused(index, terms, queries)
    order = R.W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first_rank")
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= R.TOP)
    return ranked.select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


def _covered(s, d):
    index, queries, terms = _index(s, d)
    return R.coverage(terms, index, R.best(index, terms, queries, "bm25plus", every=False))


def _coverage(s, d):
    return _covered(s, d).select("query_id", "doc_id", "rank", F.round("coverage", 6).alias("coverage"))


def _answers(s, d):
    queries = _tables(s, d)[1]
    passages = table(s, d, "documents").select("doc_id", F.col("lang").alias("standard"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("clause"), F.col("source").alias("title"), F.col("text").alias("anchor"))
    said = R.answers(_covered(s, d), queries.select("query_id", F.col("text").alias("query")), passages, "none")
    record = F.from_json("audit", "retrieved array<struct<id: string>>, threshold double, corpus_digest string, answer_sha256 string")
    told = said.withColumn("_a", record).withColumn("retrieved", F.array_join(F.transform("_a.retrieved", lambda h: h["id"]), ","))
    return told.select("query_id", "decision", "text", F.size("citations").alias("n_citations"), "confidence", "retrieved", "_a.threshold", "_a.corpus_digest", "_a.answer_sha256")


def _sweep(s, d):
    docs, queries, _ = _tables(s, d)
    hits = R.saved(_covered(s, d).where("rank = 1"), "retrieval-hits")
    rows = hits.join(queries.withColumnRenamed("text", "_q"), "query_id").join(R.of_hits(docs, hits), "doc_id")
    out = R.sweep(rows, F.contains("text", "_q"))
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision_answered")})


def _doc_freq(s, d):
    index, _, _ = _index(s, d)
    return index.df


def _tokenize(s, d):
    from plumbline.functions.text import token_estimate, tokens

    t = tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"), F.md5(F.array_join(t, " ")).alias("digest"), token_estimate(F.col("text")).alias("prompt_tokens"))


def _spans(s, d):
    """Events as spans of six to thirty-one hours, merged by user."""
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz))")
    e = table(s, d, "events").select("user_id", at.alias("start"), (at + (6 + F.col("event_id") % 6 * 5) * 3_600_000_000).alias("end"))
    return R.spans(e, "user_id")


QUERIES = {
    "tokenize": _tokenize,
    "doc_freq": _doc_freq,
    "bm25_topk": _bm25,
    "bm25plus_topk": _bm25plus,
    "tfidf_topk": _tfidf,
    "rrf_fusion": _rrf,
    "evidence_coverage": _coverage,
    "assistant_decision": lambda s, d: R.decide(_covered(s, d)),
    "assistant_answers": _answers,
    "threshold_sweep": _sweep,
    "span_merge": _spans,
}

TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:\.[0-9]+)*')"
BASE = f"""WITH dt AS (SELECT doc_id, {TOKENS} AS t FROM documents), st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM dt),
qe AS (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark), q AS (SELECT query_id, term, count(*) AS qf FROM qe GROUP BY ALL),
de AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM dt), tf AS (SELECT doc_id, dl, term, count(*) AS f FROM de GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), nm AS (SELECT 1.2 * (1 - 0.75 + 0.75 * dl / avgdl) AS norm, tf.* FROM tf, st)"""
PLUS = "p AS (SELECT query_id, doc_id, sum(qf * ln((n + 1) / df) * (2.2 * f / (f + norm) + 1.0)) AS score FROM q JOIN df USING (term) JOIN nm USING (term), st GROUP BY ALL)"
COS = """w AS (SELECT doc_id, term, (1 + ln(f)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), st),
qw AS (SELECT query_id, term, (1 + ln(qf)) * (ln((1 + n) / (1 + df)) + 1) AS v FROM q JOIN df USING (term), st),
wn AS (SELECT doc_id, sqrt(sum(w * w)) AS a FROM w GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(v * v)) AS b FROM qw GROUP BY ALL),
co AS (SELECT query_id, doc_id, sum(v * w) / (any_value(a) * any_value(b)) AS score FROM qw JOIN w USING (term) JOIN wn USING (doc_id) JOIN qn USING (query_id) GROUP BY ALL)"""
TOP = "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM {} QUALIFY rank <= 3"
#: Every document for every query; without a match the score is 0.
ALL = "{a} AS (SELECT item_id AS query_id, documents.doc_id AS doc_id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN {p} ON {p}.query_id = item_id AND {p}.doc_id = documents.doc_id)"
COVER = """h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM p QUALIFY rank <= 3),
we AS (SELECT query_id, term, coalesce(ln((n + 1) / df), ln(n + 1)) AS w FROM q LEFT JOIN df USING (term), st), wt AS (SELECT query_id, sum(w) AS t FROM we GROUP BY ALL),
cv AS (SELECT query_id, doc_id, rank, round(coalesce((SELECT sum(w) FROM we JOIN tf USING (term) WHERE we.query_id = h.query_id AND tf.doc_id = h.doc_id), 0) / t, 6) AS coverage FROM h JOIN wt USING (query_id))"""

ORACLES = {
    "tokenize": f"WITH t AS (SELECT doc_id, text, {TOKENS} AS t FROM documents) SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct, md5(array_to_string(t, ' ')) AS digest, greatest(1, length(coalesce(text, '')) // 4)::BIGINT AS prompt_tokens FROM t",
    "doc_freq": f"{BASE} SELECT term, df FROM df WHERE term IN (SELECT term FROM q)",
    "bm25_topk": f"""{BASE}, b AS (SELECT query_id, doc_id, sum(qf * ln((n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + norm)) AS score FROM q JOIN df USING (term) JOIN nm USING (term), st GROUP BY ALL),
al AS (SELECT item_id AS query_id, documents.doc_id AS doc_id, coalesce(score, 0) AS score FROM benchmark CROSS JOIN documents LEFT JOIN b ON b.query_id = item_id AND b.doc_id = documents.doc_id) """ + TOP.format("al"),
    "bm25plus_topk": f"{BASE}, {PLUS}, {ALL.format(a='al', p='p')} " + TOP.format("al"),
    "tfidf_topk": f"{BASE}, {COS}, {ALL.format(a='al', p='co')} " + TOP.format("al"),
    "rrf_fusion": f"""{BASE}, {PLUS}, {COS}, {ALL.format(a='a1', p='co')}, {ALL.format(a='a2', p='p')}, ra AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS a FROM a1),
rb AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS b FROM a2),
fu AS (SELECT query_id, doc_id, a, 1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b) AS score FROM ra JOIN rb USING (query_id, doc_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, a) AS rank, doc_id, round(score, 9) AS score FROM fu QUALIFY rank <= 3""",
    "evidence_coverage": f"{BASE}, {PLUS}, {COVER} SELECT query_id, doc_id, rank, coverage FROM cv",
    "assistant_decision": f"{BASE}, {PLUS}, {COVER} SELECT query_id, doc_id, coverage, CASE WHEN coverage >= 0.3 THEN 'answer' ELSE 'abstain' END AS decision FROM cv WHERE rank = 1",
    "assistant_answers": f"""{BASE}, {PLUS}, {COVER}, be AS (SELECT b.item_id AS query_id, coalesce(coverage, 0.0) AS confidence, coverage >= 0.3 AS yes, coalesce(lang, '') AS st, 'document ' || doc_id AS cl, coalesce(source, '') AS ti, coalesce(d.text, '') AS an
FROM benchmark b LEFT JOIN cv ON query_id = item_id AND rank = 1 LEFT JOIN documents d USING (doc_id)),
sa AS (SELECT query_id, confidence, coalesce(yes, false) AS yes, CASE WHEN yes THEN st || ' (' || cl || ', ' || ti || ') states: "' || an || '" [1] Source: ' || st || ', ' || cl || '.'
ELSE 'I cannot answer this from the governed corpus: the retrieved evidence is insufficient (evidence coverage ' || printf('%.2f', confidence) || ' < threshold 0.30). No source is cited.' END AS text FROM be)
SELECT query_id, CASE WHEN yes THEN 'answer' ELSE 'abstain' END AS decision, text, yes::INT AS n_citations, confidence, coalesce(retrieved, '') AS retrieved, 0.3::DOUBLE AS threshold, 'none' AS corpus_digest, sha256(text) AS answer_sha256
FROM sa LEFT JOIN (SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS retrieved FROM cv GROUP BY ALL) USING (query_id)""",
    "threshold_sweep": f"""{BASE}, {PLUS}, {COVER}, be AS (SELECT coverage, contains(d.text, b.text) AS ok FROM cv JOIN benchmark b ON b.item_id = query_id JOIN documents d USING (doc_id) WHERE rank = 1)
SELECT threshold::DOUBLE AS threshold, count(*) AS n, count(*) FILTER (coverage >= threshold) AS answered, round(avg((coverage >= threshold AND ok)::INT), 9) AS accuracy, round(avg(ok::INT) FILTER (coverage >= threshold), 9) AS precision_answered
FROM be, (VALUES (0.0), (0.2), (0.3), (0.4), (0.5), (0.6)) AS v(threshold) GROUP BY threshold""",
    "span_merge": """WITH e AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + (6 + event_id % 6 * 5) * 3600000000 AS e FROM events),
n AS (SELECT *, coalesce((s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS new FROM e),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT user_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY user_id, g""",
}
