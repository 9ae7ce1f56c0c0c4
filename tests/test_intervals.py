"""Resampling, selective intervals, summaries and guarded comparisons against plain Python."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import reports, selective, significance


def times(rep, cluster):
    """How often a replicate takes a cluster: a Poisson number read off a digest's word."""
    word = hashlib.md5(f"{significance.SEED}|{rep // 4}|{cluster}".encode()).hexdigest()[8 * (rep % 4) :][:8]
    u, k, upto = int(word, 16) / 2**32, 0, math.exp(-1)
    while u >= upto and k < 12:
        k += 1
        upto += math.exp(-1) / math.factorial(k)
    return k


def measures(rows):
    """(aurc, e_aurc, accuracy at 25, 50, 75) of (confidence, correct), ties at the mean of all orders."""
    n = len(rows)
    if not n:
        return [None] * 5
    levels, done, hits, area, points = sorted({c for c, _ in rows}, reverse=True), 0, 0, 0.0, []
    for c in levels:
        tie = [ok for x, ok in rows if x == c]
        area += sum(1 - (hits + j * sum(tie) / len(tie)) / (done + j) for j in range(1, len(tie) + 1))
        done, hits = done + len(tie), hits + sum(tie)
        points.append((done / n, hits / done))
    best = sum((k - hits) / k for k in range(hits + 1, n + 1)) / n
    return [area / n, area / n - best, *(next(a for c, a in points if c >= t - 1e-12) for t in (0.25, 0.5, 0.75))]


def observations():
    rng = np.random.default_rng(3)
    return [("x", f"c{i % 7}" if i % 7 else None, None if i % 11 == 0 else float("nan") if i % 13 == 0 else round(float(rng.random()), 1), bool(rng.random() < 0.6)) for i in range(90)]


def test_selective_intervals_against_brute_force(spark):
    rows = observations() + [("alone", "c1", 0.5, True), ("none", "c1", None, True), ("none", "c2", None, False)]
    df = spark.createDataFrame(rows, "arm string, family string, confidence double, correct boolean")
    got = {(r.arm, r.measure): (r.estimate, r.ci_low, r.ci_high) for r in significance.bootstrap_selective(df, n_draws=50).collect()}
    for arm in ("x", "alone"):
        mine = [(f, c, ok) for a, f, c, ok in rows if a == arm and c is not None and not math.isnan(c)]
        reps = [measures([(c, ok) for f, c, ok in mine for _ in range(times(rep, f) if f else times_null(rep))]) for rep in range(50)]
        for k, m in enumerate(("aurc", "e_aurc", "accuracy_at_25", "accuracy_at_50", "accuracy_at_75")):
            values = [r[k] for r in reps if r[k] is not None]  # replicates without rows are left out
            want = (measures([(c, ok) for _, c, ok in mine])[k], *np.percentile(values, [2.5, 97.5]))
            assert np.allclose(got[arm, m], want, atol=1e-12), (arm, m)
    assert len(got) == 10
    one = {r.arm: r for r in significance.summarize_selective(df, n_draws=50).collect()}
    assert (one["none"].n_items, one["none"].n_with_confidence, one["none"].accuracy_full_coverage) == (2, 0, 0.5)
    assert one["none"].aurc is None and one["none"].accuracy_at_50_ci_low is None
    x = one["x"]
    assert (x.n_items, x.n_with_confidence) == (90, sum(c is not None and not math.isnan(c) for _, _, c, _ in rows[:90]))
    assert (x.aurc, x.aurc_ci_low, x.accuracy_at_25_ci_high) == pytest.approx((got["x", "aurc"][0], got["x", "aurc"][1], got["x", "accuracy_at_25"][2]))
    assert x.coverage_at_25 >= 0.25 and abs(x.e_aurc - (x.aurc - x.aurc_optimal)) < 1e-12


def times_null(rep):
    word = hashlib.md5(f"{significance.SEED}|{rep // 4}".encode()).hexdigest()[8 * (rep % 4) :][:8]  # concat_ws leaves a null out
    return sum(word >= s for s in significance.STEPS)


def test_resampled_cells(spark):
    cells = spark.createDataFrame([("a", 1), ("b", 2)], "family string, n int")
    want = {(f, rep): times(rep, f) for f in "ab" for rep in range(10)}
    for shared in (False, True):
        got = {(r.family, r._rep): r._times for r in significance.resampled(cells, "family", 10, shared=shared).collect()}
        assert got == {k: v for k, v in want.items() if v} | {("a", -1): 1, ("b", -1): 1}
    many = significance.resampled(spark.range(400).withColumnRenamed("id", "family"), "family", 1000).where("_rep >= 0").agg(F.sum("_times").alias("s"), F.sum(F.col("_times") * F.col("_times")).alias("q")).first()
    assert abs(many.s / 4e5 - 1) < 0.01 and abs(many.q / 4e5 - 2) < 0.03  # Poisson: mean 1, mean square 2


def test_replicates_against_brute_force(spark, monkeypatch):
    """Null groups, keys and clusters, many clusters a batch and more groups than a worker holds: sums as cell by cell."""
    monkeypatch.setattr(significance, "CLUSTERS_AT_ONCE", 3)
    monkeypatch.setattr(significance, "GROUPS_HELD", 2)
    rng = np.random.default_rng(7)
    rows = [(["x", "y", None][i % 3], int(rng.integers(4)) if i % 5 else None, f"c{i % 11}" if i % 11 else None, int(rng.integers(9)), None if i % 4 else 0.5 * i) for i in range(150)]
    cells = spark.createDataFrame(rows, "arm string, bin int, family string, n long, s double")
    for by in (["arm", "bin"], ["arm"], []):
        want = {}
        for arm, b, f, n, s in rows:
            for rep in range(-1, 10):
                took = 1 if rep < 0 else times(rep, f) if f else times_null(rep)
                if took:
                    key = (*[{"arm": arm, "bin": b}[c] for c in by], rep)
                    was = want.get(key, (0, 0))
                    want[key] = (was[0] + took * n, was[1] + took * (s or 0))
        got = {tuple(r[:-2]): (r.n, r.s) for r in significance.replicates(cells, "family", by, ["n", "s"], 10).collect()}
        assert got == want
    none = significance.replicates(cells.limit(0), "family", ["arm"], ["n"], 10)
    assert none.collect() == [] and none.schema.names == ["arm", "_rep", "n"]


def test_cells_are_not_multiplied_by_replicates(spark):
    """A task sums a cluster's cells for all replicates: no row a cell and replicate is made, for whatever statistic."""
    df = spark.createDataFrame(observations(), "arm string, family string, confidence double, correct boolean")
    mean = significance.bootstrap_mean(df, ["arm"], "family", F.col("correct").cast("int"))
    for found in (mean, significance.bootstrap_ece(df), significance.bootstrap_selective(df, targets=())):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "md5(" not in plan  # each row of which was a cell and four replicates


def test_summary_shares_its_draws(spark):
    rng = np.random.default_rng(5)
    outcomes = ["correct", "abstained", "adjacent_substitution", "other_incorrect", "unscorable"]
    rows = []
    for i in range(60):
        o = outcomes[rng.integers(5)]
        rows.append(("m", i, 0, f"f{i % 9}", i // 2, "ab"[i % 2], "high", "category_error" if i % 10 == 9 else "factual", i % 7 == 0, o, ["correct_clause", "none"][i % 2], False, o == "correct"))
    df = spark.createDataFrame(rows, "arm string, item_id long, repeat long, family string, pair_id long, pair_role string, risk_tier string, item_type string, abstention_acceptable boolean, outcome string, citation_grade string, paywalled boolean, correct boolean")
    r = reports.summarize(df, n_draws=200).first()
    values = {"accuracy": F.when(F.col("item_type") == "factual", F.col("correct").cast("int")), "utility": reports.utility("safety")}
    for m, v in values.items():
        alone = significance.bootstrap_mean(df, ["arm"], "family", v, 200).first()
        assert (r[f"{m}_ci_low"], r[f"{m}_ci_high"], r.n_clusters) == pytest.approx((alone.ci_low, alone.ci_high, alone.n_clusters))
    assert r.accuracy_ci_low <= r.accuracy <= r.accuracy_ci_high and r.n_items == 60 and r.utility_policy == "safety"
    assert r.mean_utility == pytest.approx(reports.utility_table(df, ["safety"]).first().mean_utility)
    with pytest.raises(ValueError):
        reports.summarize(df, "bold")


def test_arms_are_compared_on_the_same_items_only(spark):
    schema = "arm string, item_id long, repeat long, item_type string, family long, correct boolean"
    rows = [(a, i, 0, "factual", i // 2, i % 3 == 0) for a in "ab" for i in range(12)] + [(a, 90, 0, "category_error", 9, True) for a in "a"]
    fine = spark.createDataFrame(rows, schema)
    assert significance.compare_arms(fine, n_draws=20).first().n == 12  # other kinds of items do not matter
    extra = spark.createDataFrame(rows + [("a", k, 0, "factual", 7, True) for k in range(70, 90)] + [("b", 69, 0, "factual", 7, True)], schema)
    with pytest.raises(Exception, match=r"arm a lacks items such as 69; arm b lacks items such as 70, 71, 72, 73, 74"):
        significance.compare_arms(extra, n_draws=20).collect()
    assert significance.compare_arms(extra, n_draws=20, unequal="pair").first().n == 12
    assert significance.compare_arms(significance.shared_items(extra), n_draws=20).first().n == 12
    with pytest.raises(ValueError):
        significance.compare_arms(fine, unequal="drop")


def two_sided(k, n):
    return min(1.0, float(sum(Fraction(math.comb(n, j), 2**n) for j in range(n + 1) if math.comb(n, j) <= math.comb(n, k))))


def test_two_tails_of_any_size(spark):
    small = [(k, n) for n in (0, 1, 2, 7, 30, 31) for k in range(n + 1)]
    large = [(5 * 10**9 - 10**5, 10**10), (10, 10**10), (10**10, 10**10), (5 * 10**9, 10**10), (3 * 10**9, 10**10), (5 * 10**9 + 250_000, 10**10)]
    got = {(r.k, r.n): r.p_value for r in significance.two_sided_p(spark.createDataFrame(small + large, "k long, n long"), "k", "n").collect()}
    assert all(abs(got[c] - two_sided(*c)) < 1e-12 for c in small)
    tail = lambda k, n: math.erfc((abs(k - n / 2) - 0.5) / math.sqrt(n / 2))  # noqa: E731  at this size good to 1e-9
    assert got[large[0]] == pytest.approx(tail(*large[0]), rel=1e-6) and got[large[5]] == pytest.approx(tail(*large[5]), rel=1e-5)
    assert got[large[1]] == got[large[2]] == got[large[4]] == 0 and got[large[3]] == 1
    skewed = [(k, 40) for k in range(41)]
    for p in (0.03, 0.3, 0.9):
        pm = [math.comb(40, j) * p**j * (1 - p) ** (40 - j) for j in range(41)]
        for r in significance.two_sided_p(spark.createDataFrame(skewed, "k long, n long"), "k", "n", p).collect():
            assert abs(r.p_value - min(1, sum(x for x in pm if x <= pm[r.k] * (1 + 1e-9)))) < 1e-12


def test_tails_take_few_terms(spark):
    """A plan's rows follow the standard deviation, however far out k is."""
    df = spark.createDataFrame([(10, 10**10), (4 * 10**9, 10**10)], "k long, n long")
    plan = significance.two_sided_p(df, "k", "n")
    assert plan.count() == 2 and selective.TARGETS == (0.25, 0.5, 0.75)
