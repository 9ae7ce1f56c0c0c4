from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import phrases, scoring

TEXTS = ["lock out the valve now", "lockout of 40 valves", "a block-lock  out", "section 1910.147(c) holds", "145 psi", "14 psi (c) é", "unlike lock out here", "éclairs for all", "", None, "the the the", "x" * 5000 + " lock"]
PHRASES = ["lock out", "Lock  Out", "lock", "ock", "valve", "1910.147(c)", "1910.14", "14", "14 psi", "(c)", "é", "the valve", "t", "locko", "lockout of", "clair", "lockouts", "x" * 4000, " ", "", None, "the the"]


def test_found_as_every_pattern_on_every_text(spark):
    texts = T.normalized(spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string"), "text").drop("text")
    some = spark.createDataFrame([(p,) for p in PHRASES * 2], "phrase string")
    asserted = lambda p: scoring.asserted_pattern(p, ["unlike"])
    got = phrases.occurrences(texts, ["i"], some, scoring.pattern_of, asserted)
    assert sorted(map(tuple, got.select("i", "phrase", "asserted").collect())) == sorted(
        (r.i, p, bool(r.a)) for p in set(PHRASES) if p and p.strip() for r in texts.select("i", T.contains(F.col("normal"), p).alias("c"), T.asserted(F.col("normal"), p, ["unlike"]).alias("a")).collect() if r.c
    )
    assert phrases.occurrences(texts.limit(0), ["i"], some, scoring.pattern_of, asserted).count() == 0
    assert phrases.occurrences(texts, ["i"], some.limit(0), scoring.pattern_of, asserted).count() == 0


def test_keys_are_the_longest_runs(spark):
    rows = spark.createDataFrame([("the valves (c)",), ("the val",), ("valve stem",), ("valve",), ("(§)",)], "p string").select(phrases.key(F.col("p")).alias("k")).collect()
    assert [r.k for r in rows] == ["=valves", "=the", "=valve", "^valve", ""]


def test_space_does_not_multiply_texts(spark):
    schema = "item_id long, required array<array<string>>, forbidden array<array<string>>, numeric array<struct<value: double, tolerance: double>>, adjacent array<string>"
    keys = spark.createDataFrame([(1, [["lock out", "lockout"], ["valve"]], [["never"]], [(40.0, 0.0)], ["psi", "section"]), (2, [], [], [], []), (3, [["zz"], []], [], [], ["lock", "valve"])], schema)
    excerpts = spark.createDataFrame([(i, t, None if t is None else f"see: {t}") for i, t in enumerate(TEXTS)], "excerpt_id long, bare string, wrapped string")
    got = {(r.item_id, r.form, r.excerpt_id): (r.outcome, r.coverage) for r in scoring.answer_space(keys, excerpts).collect()}
    assert len(got) == 3 * 2 * len(TEXTS)
    forms = excerpts.select("excerpt_id", F.lit("bare").alias("form"), F.col("bare").alias("text")).unionByName(excerpts.select("excerpt_id", F.lit("wrapped").alias("form"), F.col("wrapped").alias("text")))
    pairs = scoring.compiled(keys).crossJoin(T.normalized(forms, "text")).withColumn("error", F.lit(None).cast("string"))
    direct = scoring.assessed(pairs).withColumn("outcome", scoring.outcome()).select("item_id", "form", "excerpt_id", "outcome", "coverage")
    assert got == {(r.item_id, r.form, r.excerpt_id): (r.outcome, r.coverage) for r in direct.collect()}
    plan = scoring.answer_space(keys, excerpts)._jdf.queryExecution().optimizedPlan().toString()
    product = next(line for line in plan.splitlines() if "Join Cross" in line or "Join Inner" in line and "item_id" not in line)
    assert "normal" not in product
