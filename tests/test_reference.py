"""Hand vectors and invariants of the evaluation operators."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbline.functions import citations as C
from plumbline.functions import text as T
from plumbline.operators import agreement, corpus, reports, retrieval, sampling, scoring, selective, significance
from plumbline.plans import texts


def arm(spark, confidence, correct, **more):
    rows = [("x", i, c, bool(k)) for i, (c, k) in enumerate(zip(confidence, correct, strict=True))]
    return spark.createDataFrame(rows, "arm string, item_id long, confidence double, correct boolean")


@pytest.mark.parametrize(("confidence", "correct", "area"), [([0.9, 0.8, 0.7, 0.1], [1, 1, 0, 0], 5 / 24), ([0.5] * 4, [1, 0, 0, 0], 0.75)])
def test_aurc(spark, confidence, correct, area):
    r = selective.aurc(arm(spark, confidence, correct)).first()
    assert abs(r.aurc - area) < 1e-12 and r.aurc >= r.aurc_optimal - 1e-12 and abs(r.e_aurc - (r.aurc - r.aurc_optimal)) < 1e-12


def test_tie_points_and_coverage(spark):
    df = arm(spark, [0.9, 0.5, 0.5, 0.1, None, float("nan")], [1, 1, 0, 0, 1, 1])
    got = [(r.n_answered, round(r.selective_accuracy, 6)) for r in selective.curve_points(df).orderBy("n_answered").collect()]
    assert got == [(1, 1.0), (3, 0.666667), (4, 0.5)]
    r = selective.at_coverage(arm(spark, [0.9, 0.5, 0.5, 0.5], [1, 0, 0, 1]), (0.5,)).first()
    assert (r.selective_accuracy, r.coverage) == (0.5, 1.0)
    with pytest.raises(ValueError):
        selective.at_coverage(df, (0.0,))


def test_harmonic(spark):
    rows = spark.range(0, 200).select("id", selective.harmonic(F.col("id")).alias("h")).collect()
    assert all(abs(r.h - sum(1 / i for i in range(1, r.id + 1))) < 1e-12 for r in rows)


def test_calibration(spark):
    assert abs(selective.brier(arm(spark, [0.9, 0.8, 0.3, 0.2], [1, 1, 0, 1])).first().brier - 0.195) < 1e-12
    assert abs(selective.ece(arm(spark, [0.85, 0.85, 0.15, 0.55], [1, 0, 0, 1])).first().ece - 0.325) < 1e-12
    bins = {r.bin: r.n for r in selective.reliability(arm(spark, [1.0, 0.0, 0.1, 0.5], [1] * 4)).collect()}
    assert {b for b, n in bins.items() if n} == {9, 0, 1, 5} and len(bins) == 10
    with pytest.raises(Exception, match="outside"):
        selective.brier(arm(spark, [1.5], [1])).collect()


def test_binomial_and_holm(spark):
    df = spark.createDataFrame([(0, 10), (0, 8), (5, 10), (0, 0), (900, 2000)], "k long, n long")
    got = {(r.k, r.n): r.p_value for r in significance.two_sided_p(df, "k", "n").collect()}
    assert abs(got[0, 10] - 2 * 0.5**10) < 1e-12 and abs(got[0, 8] - 1 / 128) < 1e-12 and got[5, 10] == got[0, 0] == 1
    assert abs(got[900, 2000] - 2 * sum(math.exp(math.lgamma(2001) - math.lgamma(i + 1) - math.lgamma(2001 - i) - 2000 * math.log(2)) for i in range(901))) < 1e-9
    p = spark.createDataFrame([(0, 0.04), (1, 0.01), (2, 0.03), (3, 0.02)], "i long, p_value double")
    assert [round(r.p_holm, 9) for r in significance.holm(p, "p_value", "i").orderBy("i").collect()] == [0.06, 0.04, 0.06, 0.06]


def test_clopper_pearson(spark):
    df = spark.createDataFrame([(0, 10), (10, 10), (5, 10)], "k long, n long").withColumn("c", significance.clopper_pearson("k", "n"))
    a, b, c = [r.c for r in df.collect()]
    assert (a.low, b.high) == (0, 1) and abs(a.high - 0.3084971) < 1e-7 and abs(b.low - 0.6915029) < 1e-7 and abs(c.low + c.high - 1) < 1e-9


def test_same_arms_give_zero_width_and_p_one(spark):
    rows = [(a, i, 0, "factual", i // 2, i % 3 == 0) for a in "ab" for i in range(12)]
    df = spark.createDataFrame(rows, "arm string, item_id long, repeat long, item_type string, family long, correct boolean")
    r = significance.compare_arms(df, n_draws=50).first()
    assert (r.difference, r.ci_low, r.ci_high, r.p_value, r.p_holm, r.significant) == (0, 0, 0, 1, 1, False)


def test_pairs_and_partition(spark):
    rows = [("x", 0, p, r, c) for p, a, b in ((0, True, False), (1, True, True), (2, False, False)) for r, c in (("a", a), ("b", b))] + [("x", 0, 3, "a", True)]
    df = spark.createDataFrame(rows, "arm string, repeat long, pair_id long, pair_role string, correct boolean")
    r = reports.pair_partition(df).first()
    assert (r.n_pairs, r.both_pass, r.one_pass, r.neither_pass) == (3, 1, 1, 1)
    assert reports.paired_accuracy(df).first().n_both == 1


def test_threshold_curve(spark):
    rows = [("x", 0, 0, 0.9, True), ("x", 1, 0, 0.5, False), ("x", 2, 1, 0.5, True)]
    df = spark.createDataFrame(rows, "arm string, item_id long, pair_id long, confidence double, correct boolean")
    got = [tuple(r)[2:] for r in selective.threshold_curve(df).orderBy(F.desc("threshold")).collect()]
    assert [(n, c, f, b) for n, _, _, c, f, b in got] == [(1, 0, 1, 0), (3, 1, 0, 0)]


def test_kappa_and_correlation(spark):
    schema = "a string, b string"
    same = agreement.cohen(spark.createDataFrame([("1", "1"), ("0", "0")], schema), "a", "b", []).first()
    flat = agreement.cohen(spark.createDataFrame([("1", "1"), ("1", "1")], schema), "a", "b", []).first()
    assert same.kappa == 1 and flat.kappa is None
    rows = [(a, i, c) for a, cs in (("x", [0, 0, 1, 1]), ("y", [0, 1, 1, 1]), ("z", [0, 0, 0, 0])) for i, c in enumerate(cs)]
    df = spark.createDataFrame([(a, i, bool(c)) for a, i, c in rows], "arm string, item_id long, correct boolean")
    got = {r.arm: r.discrimination for r in agreement.point_biserial(df).collect()}
    assert abs(got["x"] - 0.5773502691896258) < 1e-12 and got["z"] is None


def test_wilson_and_policy(spark):
    low, high = reports.wilson(F.lit(18), F.lit(63))
    r = spark.range(1).select(low.alias("l"), high.alias("h"), reports.wilson(F.lit(0), F.lit(0))[0].alias("n")).first()
    assert round(r.l, 4) == 0.1890 and round(r.h, 4) == 0.4070 and r.n is None
    with pytest.raises(ValueError):
        reports.utility("none such")


def test_rank_fusion_and_bm25(spark):
    ranks = lambda order: spark.createDataFrame([(0, d, -float(i)) for i, d in enumerate(order)], "query_id long, doc_id string, score double")
    three, one = spark.createDataFrame([(x,) for x in "abc"], "doc_id string"), spark.createDataFrame([(0,)], "query_id long")
    fused = {r.doc_id: r for r in retrieval.fuse(ranks("abc"), ranks("bac"), one, three).collect()}
    assert abs(fused["a"].score - (1 / 61 + 1 / 62)) < 1e-15 and sorted(fused, key=lambda d: (-fused[d].score, fused[d].first_rank)) == ["a", "b", "c"]
    docs = spark.createDataFrame([(1, "pressure valve"), (2, "pressure relief"), (3, "pressure"), (4, "other words")], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "Pressure pressure")], "query_id long, text string")
    terms = retrieval.query_terms(queries)
    index = retrieval.build(docs, terms)
    scored = retrieval.bm25(index, terms)
    assert all(r.score < 0 for r in scored.collect()) and scored.count() == 3
    top = retrieval.top_with_unmatched(scored, queries, index.docs, 1).first()
    assert (top.doc_id, top.score) == (4, 0)
    plus = {d: {r.doc_id: r.score for r in retrieval.bm25plus(index, terms, delta=d).collect()} for d in (0.0, 1.0)}
    assert abs(plus[1.0][1] - plus[0.0][1] - 2 * math.log(5 / 3)) < 1e-12


def test_rankings_go_on_with_the_least_ids_without_a_match(spark):
    docs = spark.createDataFrame([(i, "valve" if i in (1, 2, 3, 40) else "other") for i in range(1, 60)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "valve"), (1, "nothing here"), (2, "")], "query_id long, text string")
    terms = retrieval.query_terms(queries)
    index = retrieval.build(docs, terms)
    rows = lambda df: {q: [(r.doc_id, r.score > 0) for r in sorted(df.collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 1, 2)}
    for scored in (retrieval.bm25plus(index, terms), retrieval.tfidf(docs, terms)):
        got = rows(retrieval.top_with_unmatched(scored, queries, docs, 6))
        assert got[0] == [(1, True), (2, True), (3, True), (40, True), (4, False), (5, False)]
        assert got[1] == got[2] == [(i, False) for i in range(1, 7)]
    fused = retrieval.fuse(retrieval.tfidf(docs, terms), retrieval.bm25plus(index, terms), queries, docs, n=6)
    best = sorted((r for r in fused.collect() if r.query_id == 0), key=lambda r: (-r.score, r.first_rank))[:6]
    assert [r.doc_id for r in best] == [1, 2, 3, 40, 4, 5] and abs(best[4].score - 2 / 65) < 1e-12
    assert rows(retrieval.top_with_unmatched(retrieval.tfidf(docs.limit(0), terms), queries, docs.limit(0), 3)) == {0: [], 1: [], 2: []}


def test_binomials_of_any_size(spark):
    ns = [0, 1, 5, 20, 21, 50, 1000, 10**6]
    found = {r.n: r.f for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", significance.log_factorial(F.col("n")).alias("f")).collect()}
    assert all(abs(found[n] - math.lgamma(n + 1)) <= 1e-13 * max(1, found[n]) for n in ns)
    cases = [(0, 0), (0, 9), (3, 9), (40, 100), (480, 1000), (500, 1000), (0, 400), (49_000, 100_000)]
    exact = lambda k, n: min(1.0, float(sum(Fraction(math.comb(n, j), 2**n) for j in range(n + 1) if math.comb(n, j) <= math.comb(n, k))))
    got = significance.two_sided_p(spark.createDataFrame(cases, "k long, n long"), "k", "n").collect()
    assert all(abs(r.p_value - exact(r.k, r.n)) <= 1e-9 * exact(r.k, r.n) for r in got if r.n <= 1000) and len(got) == len(cases)
    assert 2.4e-10 < next(r.p_value for r in got if r.n == 100_000) < 2.6e-10
    skewed = significance.two_sided_p(spark.createDataFrame([(2, 30)], "k long, n long"), "k", "n", 0.2).first().p_value
    pm = [math.comb(30, j) * 0.2**j * 0.8 ** (30 - j) for j in range(31)]
    assert abs(skewed - sum(x for x in pm if x <= pm[2] * (1 + 1e-9))) < 1e-12


def test_disagreements(spark):
    side = lambda *rows: spark.createDataFrame(rows, "rating_id long, label string")
    rows = agreement.disagreements(side((1, "a"), (2, "b"), (3, "a")), side((1, "a"), (2, "c"), (4, "a"))).collect()
    assert [tuple(r) for r in rows] == [(2, "b", "c")]


def norm(spark, *texts):
    return T.normalized(spark.createDataFrame([(t,) for t in texts], "t string"), "t")


def test_text(spark):
    got = {r.t: r.normal for r in norm(spark, "  A B’s § 5° ﬁx­ ", "plain  TEXT", None, "").collect()}
    assert got == {"  A B’s § 5° ﬁx­ ": "a b's section 5 degrees fix", "plain  TEXT": "plain text", None: "", "": ""}
    df = norm(spark, "every 15 years, annually; it has no valve and never a disk. " + "x" * 80 + " disk two hundred twenty-four 10,000.5 24th 1910.147")
    t = F.col("normal")
    r = df.select(T.contains(t, "5 years").alias("a"), T.contains(t, "annual").alias("b"), T.contains(t, "nual").alias("c"), T.contains(t, " ").alias("d"), T.asserted(t, "valve").alias("e"), T.asserted(t, "disk").alias("f"), T.numbers(t).alias("n")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (False, True, False, False, False, True)
    assert r.n == [15.0, 10000.5, 24.0, 1910.147, 2.0, 24.0]
    v = spark.createDataFrame([(10000.0,), (1.3,), (7.0,)], "v double").select(T.number_variants(F.col("v")).alias("x")).collect()
    assert [x.x for x in v] == [["10000", "10,000"], ["1.3"], ["7"]]


def test_markup_and_number_words(spark):
    rows = [("a \u2013 b \u2212 c\u00a0d", "a-b-c d"), ("x\u2014y \u2014 z", "x\u2014y \u2014 z"), ("<p>\u201cIt\u2019s&amp;&#8217;</p>", "\"it's&'"), (None, "")]
    got = spark.createDataFrame(rows, "t string, want string").select(T.flat_markup(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got
    words = T.number_words()
    assert len(words) == 28 + 2 * 72 + 7 and words["ninety-nine"] == words["ninety nine"] == 99 and words["twenty"] == 20 and words["one hundred eighty"] == 180


def test_abstention_and_answer_parts(spark):
    df = norm(spark, "I don't know.", "I cannot confirm, but the interval is five years.", "x", "Five years.")
    got = {r.t: (r.e, r.a) for r in df.select("t", *[c.alias(k) for k, c in zip("ea", T.abstention(F.col("normal")), strict=True)]).collect()}
    assert list(got.values()).count((False, True)) == 1 and got["I don't know."] == (False, True) and got["x"] == (True, False)
    r = spark.createDataFrame([("Answer: five\nCITATION: None",), ("free words",), ("ANSWER: Unknown.",)], "r string").select(*[v.alias(k) for k, v in T.answer_parts(F.col("r")).items()]).collect()
    assert [tuple(x) for x in r] == [("five", None, False), ("free words", None, False), ("Unknown.", None, True)]


def cited(spark, text):
    return [C_text(r) for r in spark.createDataFrame([(text,)], "t string").select(C.citations(F.col("t")).alias("c")).first().c]


def C_text(r):
    return f"{r.family} {r.section}{''.join(f'({x})' for x in r.chain)}"


def test_addresses_are_no_sections(spark, tmp_path):
    assert cited(spark, "from 68.108.182.17, 54.12-13.5.6 and 54.12.1") == []
    assert cited(spark, "See 68.108. Or 54.12-13, 1910.147.") == ["40 cfr 68.108", "46 cfr 54.12-13", "29 cfr 1910.147"]
    rows = [(6, "ab 10.10.54.153 c"), (14, "10.10.54.153"), (22, None), (30, "")]  # the middle of the first two lies before 54
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert texts.QUERIES["parse_citations"](spark, str(tmp_path)).collect() == []
    assert [r.citation_grade for r in texts.QUERIES["grade_citations"](spark, str(tmp_path)).collect()] == ["none"] * 4


def test_citations(spark):
    assert cited(spark, "29 CFR 1910.147(c)(6)(I), 1910.147(c)(6)(i) and § 1926.50 (a); UG-127, nfpa 70E, API RP 520, iso 4126-1; 99.5(a)") == [
        "29 cfr 1910.147(c)(6)(i)", "29 cfr 1926.50(a)", "asme ug 127", "nfpa 70e", "api 520", "iso 4126-1",
    ]
    assert cited(spark, "129 CFR 1904.1") == ["29 cfr 1904.1"] and cited(spark, None) == []
    text = lambda s: C.citations(F.lit(s))
    g = lambda found, want, ok: tuple(spark.range(1).select(*[v.alias(k) for k, v in C.grade(text(found), text(want), text(ok)).items()]).first())
    assert g("29 CFR 1910.147(c)", "29 CFR 1910.147(c)", "29 CFR 1910.147(c)") == ("correct_clause", False, [])
    assert g("29 CFR 1910.147(d) NFPA 70", "29 CFR 1910.147(c)", "29 CFR 1910.147(c) and 40 CFR 68.79") == ("correct_section", False, ["NFPA 70"])
    assert g("40 CFR 68.79", "29 CFR 1910.147(c)", "29 CFR 1910.147(c) and 40 CFR 68.79") == ("wrong", True, [])
    assert g("none", "29 CFR 1910.147(c)", "29 CFR 1910.147(c)")[0] == "none"
    # the first expected reference of a section decides, even if a later one agrees wholly
    assert g("29 CFR 1910.147(d)", "29 CFR 1910.147(c), 29 CFR 1910.147(d)", "29 CFR 1910.147(c)")[0] == "correct_section"


def test_locality(spark):
    section = "<p>(a) first words</p> (b) (1) second words (2) third words (3) (4) (5) (6) (7) last words"
    f = lambda clause, anchor: spark.range(1).select(C.anchor_local(F.lit(section), F.lit(anchor), C.section_of(F.lit(clause))["markers"]).alias("x")).first().x
    assert f("29 CFR 1910.1(a)", "first words") is True and f("29 CFR 1910.1(b)(1) and (2)", "third words") is True
    assert f("29 CFR 1910.1(a)", "last words") is False and f("29 CFR 1910.1", "first words") is None and f("29 CFR 1910.1(a)", "nowhere") is None
    parts = spark.range(1).select(*[v.alias(k) for k, v in C.section_of(F.lit("See 46 CFR 54.15-13(b)(3) and (c)")).items()]).first()
    assert tuple(parts) == ("46", "54.15-13", "54", ["(b)", "(3)"], ["(b)", "(3)", "(c)"])


KEY = (1, [["five years", "60 months"], ["disk"]], [["no test"]], [(5.0, 0.0)], ["spring", "blowdown"])


def outcomes(spark, *responses):
    items = spark.createDataFrame([KEY], f"item_id long, {scoring.KEY}")
    rows = spark.createDataFrame([(1, i, t, e) for i, (t, e) in enumerate(responses)], "item_id long, n long, text string, error string")
    return [r.outcome for r in scoring.score(items, rows).orderBy("n").collect()]


def test_scoring_decisions(spark):
    assert outcomes(
        spark, ("The disk is replaced every five years.", None), ("The disk, every 5 years, with no test.", None), ("The disk lasts sixty months, 60 months.", None), ("It has a spring and blowdown.", None),
        ("A disk has no spring; every five years.", None), ("I do not know.", None), ("I cannot verify it, but the disk lasts five years.", None), ("", None), ("The disk, five years.", "timeout"), ("something else", None), ("the spring", None),
    ) == ["correct", "other_incorrect", "other_incorrect", "adjacent_substitution", "correct", "abstained", "correct", "unscorable", "unscorable", "other_incorrect", "adjacent_substitution"]


def test_unknown_item_raises(spark):
    items = spark.createDataFrame([KEY], f"item_id long, {scoring.KEY}")
    with pytest.raises(Exception, match="no such item"):
        scoring.score(items, spark.createDataFrame([(2, "x", None)], "item_id long, text string, error string")).collect()


def test_spans_and_sample(spark):
    df = spark.createDataFrame([("a", 1, 4), ("a", 2, 3), ("a", 4, 6), ("a", 8, 9), ("b", 1, 2)], "k string, start long, end long")
    assert sorted(tuple(r) for r in retrieval.spans(df, "k").collect()) == [("a", 1, 6), ("a", 8, 9), ("b", 1, 2)]
    rows = spark.createDataFrame([(i, "big" if i < 13 else "one", f"arm{i}") for i in range(14)], "i long, outcome string, arm string")
    sample = sampling.stratified(rows, "outcome", ["i"])
    assert {(r.outcome): r["count"] for r in sample.groupBy("outcome").count().collect()} == {"big": 3, "one": 1}
    sheet, key = sampling.blinded(sample, ["i"])
    assert set(sheet.columns) == {"rating_id", "i"} and "arm" in key.columns and sample.select("rating_id").distinct().count() == 4


def test_corpus_helpers(spark):
    df = spark.createDataFrame([(1, "d", "factual", "a"), (2, "e", "factual", None)], "item_id long, domain string, item_type string, clause string")
    assert corpus.select(df, domains=["d"]).count() == 1 and corpus.select(df).count() == 2
    with pytest.raises(KeyError):
        corpus.one(df, 3)
    a, b = corpus.digest(df, ["item_id", "domain"]).first().digest, corpus.digest(df.orderBy(F.desc("item_id")), ["item_id", "domain"]).first().digest
    assert a == b != corpus.digest(df, ["item_id", "item_type"]).first().digest
    r = spark.range(1).select(corpus.prints_as(F.lit(0.12345), F.lit(12.3), F.lit(1), 100.0).alias("x"), corpus.prints_as(F.lit(0.12345), F.lit(12.4), F.lit(1), 100.0).alias("y")).first()
    assert (r.x, r.y) == (True, False)


def test_few_items_leave_no_task_without_responses(spark):
    items = spark.createDataFrame([(0, [["a"]], [], [], ["b"])], f"item_id long, {scoring.KEY}")
    said = spark.range(64).select("id", F.lit(0).cast("long").alias("item_id"), F.lit("a").alias("text"), F.lit(None).cast("string").alias("error"))
    out = scoring.score(items, said)
    assert {r.outcome for r in out.collect()} == {"unscorable"}  # shorter than an answer
    parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in parts) == 64 and len(parts) == 4
