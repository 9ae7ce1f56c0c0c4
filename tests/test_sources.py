import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import adapters, corpus, evidence, scoring
from plumbline.sources import corpus as C
from plumbline.sources import sinks
from plumbline.streaming import arms


def item(i, **more):
    return {
        "id": i, "item_type": "factual", "family": "f", "question": "How long?", "correct_answer": "Five years.", "answer_key": {"required_concepts": [[" Five Years "]], "numeric_facts": [{"label": "years", "value": 5, "unit": "y"}]},
        "adjacent_wrong": {"signature_terms": ["spring"]}, "source": {"clause": "29 CFR 1910.1(a)", "anchor_text": "inspect every five years"}, "verification": {"status": "verified"},
    } | more


def write(tmp_path, name, items, **more):
    (tmp_path / name).write_text(json.dumps({"schema_version": "1.0", "domain": "d", "items": items} | more))
    return str(tmp_path)


def test_read_score_and_write(spark, tmp_path):
    path = write(tmp_path, "one.json", [item("a", pair_id="p", pair_role="a"), item("b", pair_id="p", pair_role="b")])
    items = C.read_items(spark, path)
    rows = {r.id: r for r in items.collect()}
    assert rows["a"].risk_tier == "medium" and rows["a"].answer_key.required_concepts == [["five years"]] and rows["a"].file == "one.json"
    flat = items.select(F.col("id").alias("item_id"), "correct_answer", F.lit("The spring.").alias("adjacent_answer"), F.col("source.clause").alias("clause"))
    got = scoring.score(C.keys(items), adapters.oracle(flat))
    assert [r.outcome for r in got.collect()] == ["correct", "correct"]
    first = adapters.random_floor(flat, flat.select("clause")).orderBy("item_id").collect()
    assert first == adapters.random_floor(flat.orderBy(F.desc("item_id")), flat.select("clause")).orderBy("item_id").collect()


def test_numbers_in_the_oracle_answer(spark, tmp_path):
    path = write(tmp_path, "one.json", [item("a", correct_answer="Every five years, 5 years.")])
    items = C.read_items(spark, path)
    said = adapters.static(C.keys(items), "Every 5 years, five years in all.")
    assert scoring.score(C.keys(items), said).first().outcome == "correct"


@pytest.mark.parametrize("broken", [dict(item_type="x"), dict(pair_id="p"), dict(pair_id="p", pair_role="a"), dict(verification={"status": "draft"}), dict(item_type="category_error"), dict(answer_key={"required_concepts": [[]]}), dict(source={"clause": "none", "anchor_text": "x"}), dict(question=" ")])
def test_broken_rules_raise(spark, tmp_path, broken):
    with pytest.raises(C.CorpusError):
        C.read_items(spark, write(tmp_path, "x.json", [item("a", **broken)]))
    assert corpus.violations(C.read_items(spark, str(tmp_path), strict=False)).count() >= 1


def test_guards(spark, tmp_path):
    with pytest.raises(C.CorpusError):
        C.read_items(spark, write(tmp_path, "x.json", [], schema_version="2"))
    (tmp_path / "q.json").write_text(json.dumps({"status": "DRAFT", "items": []}))
    with pytest.raises(C.CorpusError):
        C.read_quarantine(spark, str(tmp_path / "q.json"))
    (tmp_path / "q.json").write_text(json.dumps({"status": C.EXCLUDED, "items": [{"id": "z"}]}))
    assert C.read_quarantine(spark, str(tmp_path / "q.json")).first().id == "z"
    (tmp_path / "r.json").write_text(json.dumps({"adapter": {"name": "m/1", "arm": "x"}, "corpus_digest": "d", "repeat": 1, "is_mock_demonstration": True, "scores": [{"item_id": "a", "outcome": "correct"}]}))
    with pytest.raises(C.CorpusError):
        C.read_runs(spark, str(tmp_path / "r.json"), "other")
    scores = C.run_scores(C.read_runs(spark, str(tmp_path / "r.json"), "d"))
    assert scores.first().correct is True
    sinks.write_scores(scores, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().adapter_file == "mock__m-1"
    with pytest.raises(ValueError):
        sinks.summary(scores, scores.select("adapter"))
    assert "mock!" in sinks.summary(scores, scores.select("adapter"), "mock!")
    assert sinks.safe_name("a b/c", True) == "mock__a-b-c"


def test_runs_round_trip(spark, tmp_path):
    none = "array<array<string>>"
    key = spark.createDataFrame([("i1", [["lock"]], [], [], ["tag"], "29 CFR 1910.147(c)", ["40 CFR 68.79"], True), ("i2", [["x"], ["y"]], [], [(3.0, 0.0)], ["tag"], "29 CFR 1910.95", [], False)], f"item_id string, required {none}, forbidden {none}, numeric array<struct<value: double, tolerance: double>>, adjacent array<string>, clause string, cross_reference array<string>, abstention_acceptable boolean")
    said = [("i1", "a lock; see 1910.147(c)", [], None), ("i2", "x unlike a tag", ["NFPA 70E", "40 CFR 68.79"], None)]
    responses = spark.createDataFrame(said, "item_id string, text string, citations array<string>, error string")
    scored = scoring.score_full(key, responses, cues=["unlike"])
    rows = {r.item_id: r for r in scored.collect()}
    assert (rows["i1"].outcome, rows["i1"].citation_grade, rows["i1"].utility) == ("correct", "correct_clause", 1.0)
    assert (rows["i2"].citation_grade, rows["i2"].unsupported_paywalled, rows["i2"].cited_cross_reference) == ("wrong", ["NFPA 70e"], False)
    assert (rows["i2"].missing_groups, rows["i2"].missing_numbers, rows["i2"].contrasted) == ([1], [3.0], ["tag"])
    loose = scoring.score_full(key, responses, cues=["unlike"], config=scoring.Config(coverage=0.5, full_numeric=False))
    assert {r.item_id: r.outcome for r in loose.collect()}["i2"] == "correct"
    silent = spark.createDataFrame([("i1", "1910.147", None, "late"), ("i2", " ", None, None)], "item_id string, text string, citations array<string>, error string")
    lost = {r.item_id: (r.unscorable_reason, r.citation_grade, r.utility) for r in scoring.score_full(key, silent).collect()}
    assert lost == {"i1": ("adapter_error: late", "none", 0.0), "i2": ("empty_response", "none", 0.0)}
    with pytest.raises(ValueError, match="no policy"):
        scoring.Config(policy="none such").describe()
    named = scored.withColumns({"adapter": F.lit("my sys:1"), "arm": F.lit("a"), "repeat": F.lit(2), "is_mock": F.lit(True)})
    sinks.write_runs(named, str(tmp_path / "runs"), "dig", scoring.DEFAULT.describe(), seed=7)
    back = C.read_runs(spark, str(tmp_path / "runs" / "*" / "*"), "dig")
    run = back.first()
    assert (run.adapter.name, run["repeat"], run.seed, run.n_items, run.is_mock_demonstration) == ("my sys:1", 2, 7, 2, True)
    assert [r.text for r in run.responses] == [t for _, t, _, _ in said] and run.scoring_config["coverage"] == "0.75" and run.environment["pyspark"]
    assert {r.item_id: r.outcome for r in C.run_scores(back).collect()} == {i: r.outcome for i, r in rows.items()}
    with pytest.raises(C.CorpusError):
        C.read_runs(spark, str(tmp_path / "runs" / "*" / "*"), "other")


def test_baselines_are_rejected(spark):
    rows = lambda *x: spark.createDataFrame(x, "item_id long, is_mock boolean, digest string, text string, outcome string")
    fresh = rows((1, False, "d", "t", "correct")).drop("is_mock", "digest")
    sound = rows((1, False, "d", "t", "correct"))
    assert evidence.require_baseline(sound, fresh, "d").count() == 1
    for bad in (rows((1, True, "d", "t", "correct")), rows((1, False, "e", "t", "correct")), rows((1, False, "d", "u", "correct")), rows((2, False, "d", "t", "correct"))):
        with pytest.raises(ValueError):
            evidence.require_baseline(bad, fresh, "d")
    with pytest.raises(ValueError):
        evidence.require_baseline(sound, fresh, "d", {"coverage": "0.75"}, {"coverage": "0.5"})


def test_expected_and_acceptable_citations_and_export(spark):
    df = spark.createDataFrame([("29 CFR 1910.147(c)", ["40 CFR 68.79", "NFPA 70E"]), ("none", None)], "clause string, others array<string>")
    rows = df.select(F.size(scoring.expected(F.col("clause"))).alias("e"), F.size(scoring.acceptable(F.col("clause"), F.col("others"))).alias("a")).collect()
    assert [tuple(r) for r in rows] == [(1, 3), (0, 0)]
    items = spark.createDataFrame([("i", ("S", "C", None, "anchor words"))], "id string, source struct<standard: string, clause: string, section_title: string, anchor_text: string>")
    assert corpus.documents(items).first().text == "S C  anchor words"
    assert json.loads(corpus.export(items).first().json) == {"id": "i", "source": {"standard": "S", "clause": "C", "anchor_text": "anchor words"}}


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    df.coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    back = C.read_table(spark, str(tmp_path / "t"), "k string, v double")
    assert sinks.differs(back, df).count() == 0 and C.cell(back, "v", k="a") == 1.5
    assert [r.side for r in sinks.differs(back, df.where("k = 'a'")).collect()] == ["stored"]
    with pytest.raises(C.CorpusError):
        C.cell(back, "v", k="z")
    assert sinks.markdown(df.orderBy("k")) == "| k | v |\n| --- | --- |\n| a | 1.500 |\n| b |  |"
    assert sinks.wide(spark.createDataFrame([("x", "a", 1)], "g string, n string, v int"), "g", "n", "v", ["a", "b"]).first().asDict() == {"g": "x", "a": 1, "b": None}


def test_external_errors_stay_in_their_row(spark):
    def ask(item):
        if item["item_id"] == 2:
            raise TimeoutError("late")
        return {"item_id": 9 if item["item_id"] == 3 else item["item_id"], "text": "yes", "confidence": 0.5}

    items = spark.createDataFrame([(1,), (2,)], "item_id long")
    got = {r.item_id: (r.text, r.error) for r in adapters.external(items, ask).collect()}
    assert got == {1: ("yes", None), 2: ("", "TimeoutError: late")}
    with pytest.raises(Exception, match="asked 3"):
        adapters.external(spark.createDataFrame([(3,)], "item_id long"), ask).collect()
    assert adapters.repeats(items, lambda k: lambda df: adapters.static(df, str(k)), 2).count() == 4
    with pytest.raises(ValueError):
        adapters.repeats(items, lambda k: k, 0)


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:00:0{i}", a, json.dumps({"k": 30 * i})) for h in range(3) for a in "xy" for i in range(3)]
    df = spark.createDataFrame(rows, "ts string, event_type string, props string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = arms.summarize(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("arms").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("arms").collect())) == sorted(map(tuple, arms.summarize(df).collect()))
