import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import adapters
from plumbline.operators import retrieval as R
from plumbline.sources import sinks


def test_answers_and_audit(spark):
    hits = spark.createDataFrame([(1, "a", 1, 2.5, 0.4), (1, "b", 2, 1.0, 0.9), (2, "b", 1, 1.0, 0.2999994)], "query_id long, doc_id string, rank int, score double, coverage double")
    passages = spark.createDataFrame([("a", "S", "29 CFR 1.2(a)", "T", "every year"), ("b", "S", "29 CFR 1.3", None, "x")], "doc_id string, standard string, clause string, title string, anchor string")
    queries = spark.createDataFrame([(1, "how often"), (2, "why"), (3, "")], "query_id long, query string")
    got = {r.query_id: r for r in R.answers(hits, queries, passages, "d").collect()}
    assert [got[k].decision for k in (1, 2, 3)] == ["answer", "abstain", "abstain"]
    assert got[1].text == 'S (29 CFR 1.2(a), T) states: "every year" [1] Source: S, 29 CFR 1.2(a).' and got[1].citations == ["29 CFR 1.2(a)"]
    assert "coverage 0.30 < threshold 0.30" in got[2].text and got[2].citations == [] and got[3].confidence == 0.0
    audit = json.loads(got[1].audit)
    assert audit["retrieved"] == [{"id": "a", "cite": "29 CFR 1.2(a)", "score": 2.5, "coverage": 0.4}, {"id": "b", "cite": "29 CFR 1.3", "score": 1.0, "coverage": 0.9}]
    assert audit["answer_sha256"] == hashlib.sha256(got[1].text.encode()).hexdigest() and audit["corpus_digest"] == "d" and audit["top_coverage"] == 0.4
    assert json.loads(got[3].audit)["retrieved"] == []


def test_audit_is_written_as_lines(spark, tmp_path):
    rows = spark.createDataFrame([(1, '{"query": "a\\nb"}'), (2, None)], "query_id long, audit string")
    sinks.write_audit(rows, str(tmp_path / "audit"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "audit")).collect()] == [{"query": "a\nb"}]


def test_answers_of_empty_tables(spark):
    none = spark.createDataFrame([], "query_id long, doc_id string, rank int, score double, coverage double")
    passages = spark.createDataFrame([], "doc_id string, standard string, clause string, title string, anchor string")
    assert R.answers(none, spark.createDataFrame([], "query_id long, query string"), passages, "d").count() == 0


@pytest.mark.parametrize(("tried", "told", "seconds"), [(0, None, 1.0), (3, None, 8.0), (9, None, 32.0), (0, "5", 5.0), (0, "90", 32.0), (1, "soon", 2.0)])
def test_wait(tried, told, seconds):
    assert adapters.wait(tried, told) == seconds


@pytest.mark.parametrize("phrase", ["five years", "not", "5", " ", "zz"])
def test_phrase_spans(spark, phrase):
    texts = ["five years and five  years", "not notable, knot", "5 15 55 5", "", None, "five years" * 3, "\U0001f600 five years"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(s.start, s.end) for s in r.s] for r in rows.select("i", T.phrase_spans(F.col("t"), phrase).alias("s")).collect()}
    want = {i: [m.span() for m in re.finditer(T.phrase_pattern(phrase), t)] if t and phrase.strip() else [] for i, t in enumerate(texts)}
    assert got == want
