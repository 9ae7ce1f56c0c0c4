import pytest
from pyspark.sql import functions as F

from plumbline.operators import adapters, corpus, evidence, prefix, retrieval, sampling


def test_search_and_filters(spark):
    rows = spark.createDataFrame([(1, "Lock_Out", True, True, True, True), (2, "tag", False, True, False, False), (3, None, False, False, False, False)], "item_id long, name string, baseline boolean, attainable boolean, attainable_bare boolean, own_passes boolean")
    ids = lambda words, name: [r.item_id for r in evidence.search(rows, words, ["item_id", "name"], name).orderBy("item_id").collect()]
    assert ids("lock out", "all") == ids("LOCK_OUT", "baseline") == [1]
    assert (ids("", "recoverable"), ids("", "unreachable"), ids("", "own-fails"), ids("", "metadata")) == ([2], [3], [2, 3], [2])
    with pytest.raises(ValueError):
        evidence.search(rows, "", ["name"], "none")


def test_json_and_prompts(spark):
    df = spark.createDataFrame([('[{"k": "a"}, {"k": "b"}, {"j": "a"}]', "q", "e"), (None, "q", None)], "j string, q string, e string")
    a, b = df.select(evidence.count_where(F.col("j"), "k", "a").alias("a"), evidence.count_where(F.col("j"), "k", "").alias("n"), evidence.prompt(F.col("q"), F.col("e")).alias("p"), evidence.short_hash(F.col("q")).alias("h")).collect()
    assert (a.a, a.n, b.a, b.n) == (1, 1, 0, 0) and a.p.startswith("Excerpt:\ne") and b.p == "q" and len(a.h) == 16
    assert spark.range(1).select(evidence.dig(F.lit('{"a": {"b": 3}}'), "a.b").alias("x")).first().x == "3"


def test_sound_baseline_has_no_problems(spark):
    fresh = spark.createDataFrame([(i, "t", "correct") for i in range(4)], "item_id long, text string, outcome string")
    stored = fresh.withColumns({"is_mock": F.lit(False), "digest": F.lit("d")})
    assert all(r.n == 0 for r in evidence.baseline_problems(stored, fresh, "d").collect())
    found = {r.problem: r.n for r in evidence.baseline_problems(stored.unionByName(stored.where("item_id = 0")), fresh.where("item_id < 3"), "e").collect()}
    assert (found["duplicate"], found["digest"], found["unknown"], found["missing"]) == (1, 5, 1, 0)


def test_mock_is_order_independent(spark):
    items = spark.range(300).select(F.col("id").alias("item_id"), F.lit("right").alias("correct_answer"), F.lit(None).cast("string").alias("adjacent_answer"))
    a, b = (sorted(map(tuple, evidence.mock(x, evidence.PROFILES["pseudo_grounded"]).collect())) for x in (items, items.orderBy(F.desc("item_id"))))
    assert a == b and 0.34 < sum(r[1] == "correct" for r in a) / 300 < 0.54 and all(0.68 <= r[3] <= 0.97 and r[4] for r in a)
    assert {r[2] for r in a if r[1] == "correct"} == {"right"} and {r[2] for r in a if r[1] == "adjacent"} == {""}
    assert {r.branch for r in evidence.mock(items, evidence.PROFILES["abstainer"]).collect()} == {"abstain"}


def test_running_sums_over_buckets(spark):
    rows = [(g, x) for g in ("a", None) for x in range(50)]
    df = spark.createDataFrame(rows, "g string, x long")
    got = prefix.running(df, ["g"], F.floor(F.col("x") / 7), [F.desc("x")], {"s": F.col("x")}, descending=True)
    assert all(r.s == sum(range(r.x, 50)) for r in got.collect()) and got.count() == 100


def test_retrieval_adapter_quotes_the_best_passage(spark):
    items = spark.createDataFrame([(1, "long inspection interval")], "item_id long, text string")
    passages = spark.createDataFrame([(7, "S", "C 1", "T", "inspection interval of disks"), (8, "S", "C 2", "T", "other words")], "doc_id long, standard string, clause string, title string, anchor string")
    docs = passages.select("doc_id", F.col("anchor").alias("text"))
    queries = items.withColumnRenamed("item_id", "query_id")
    terms = retrieval.query_terms(queries)
    top = retrieval.top(retrieval.bm25plus(retrieval.build(docs, terms), terms), 1)
    r = adapters.retrieved(items, top, passages).first()
    assert r.text == "S (C 1, T) states: inspection interval of disks See C 1." and r.citations == ["C 1"] and r.confidence == round(top.first().score, 4)
    assert [x.clause for x in corpus.labels(passages, "clause").collect()] == ["C 1", "C 2"]


def test_source_parts_stand_behind_the_citation(spark):
    rows = spark.createDataFrame([("S (C 1, ask ) twice) states: ask ) See C 1.", "ask )"), ("S (C, T) states: ", ""), (None, "x"), ("x", None)], "w string, a string")
    got = [r.p for r in rows.select(corpus.source_parts(F.col("w"), F.col("a")).alias("p")).collect()]
    assert [tuple(p) if p else None for p in got] == [("S (C 1, ask ) twice) states:", "See C 1."), ("S (C, T) states:", ""), None, None]
    for w, a in (("S (C, T) says: x", "x"), ("S (C, T) states: y x", "x")):
        with pytest.raises(Exception, match="no such excerpt"):
            spark.createDataFrame([(w, a)], "w string, a string").select(corpus.source_parts(F.col("w"), F.col("a"))).collect()


def test_only_rated_outcomes_with_response_and_item_are_drawn(spark):
    run = "adapter string, arm string, repeat int, item_id string"
    scores = spark.createDataFrame([("a", "m", 0, i, o) for i, o in (("1", "correct"), ("2", "abstained"), ("3", "unscorable"), ("4", "correct"), ("5", "correct"))], f"{run}, outcome string")
    said = spark.createDataFrame([("a", "m", 0, i, f"text {i}") for i in "1235"] + [("a", "m", 1, "4", "another repeat")], f"{run}, text string")
    items = spark.createDataFrame([(i, "q", "r", "c", None) for i in "1234"], "item_id string, question string, correct_answer string, clause string, adjacent_label string")
    rows = sampling.ratable(scores, said, items)
    assert sorted((r.item_id, r.automatic_outcome, r.response_text, r.adjacent_label) for r in rows.collect()) == [("1", "correct", "text 1", None), ("2", "abstained", "text 2", None)]
    sheet, key = sampling.blinded(sampling.stratified(rows, "automatic_outcome", [*sampling.RUN, "item_id"]), ["question", "response_text", "reference_answer", "clause"])
    assert sheet.columns == ["rating_id", "question", "response_text", "reference_answer", "clause"] and key.count() == 2
    assert sampling.ratable(scores.limit(0), said, items).count() == 0
