import json

import pytest

from plumbline.operators import corpus, ledger, provenance
from plumbline.sources.corpus import CorpusError, read_arms

ROWS = [{"arm": "a", "k": "1", "acc": "0.125", "n": "40"}, {"arm": "b", "k": "1", "acc": "0.5", "n": "0"}, {"arm": "b", "k": "2", "acc": "", "n": "7"}]
JSON = '{"x": {"y": [{"v": 2.5, "s": "p"}, {"v": 1}, {"s": ""}]}, "n": 12}'


def _checked(spark, claims):
    tables = spark.createDataFrame([("t.csv", r) for r in ROWS], "file string, row map<string, string>")
    files = spark.createDataFrame([("f.json", JSON), ("g.md", "level 0.95 of 40 items"), ("void", None)], "file string, text string")
    counts = spark.createDataFrame([("n_items", 10.0), ("n_none", 0.0)], "name string, value double")
    df = spark.createDataFrame(claims, "claim_id string, printed string, source string, locator string")
    return {(r.claim_id, r.locator): (r.value, list(r.problems)) for r in ledger.check(ledger.resolve(df, tables, files, counts)).collect()}


def test_every_kind_of_locator(spark):
    t, f, g = "t.csv", "f.json", "g.md"
    claims = [
        ("A1", "12.5%", t, "csv::t.csv::arm=a::acc"), ("A2", "99.9%", t, "csv::t.csv::arm=a::acc"), ("A3", "0.5", t, "csv::t.csv::arm=b&k=1::acc"), ("A4", "0.5", t, "csv::t.csv::arm=b::acc"),
        ("A5", "0", t, "csv::t.csv::k=2&arm=b::acc"), ("A6", "1", t, "csv::t.csv::arm=c::k"), ("A7", "5", t, "csvn::t.csv::arm=a::acc*n"), ("A8", "12%", t, "csv::t.csv::arm=a::acc"), ("A9", "1", t, "csv::t.csv::::k"),
        ("J1", "2.5", f, "json::f.json::x.y.0.v"), ("J2", "12", f, "json::f.json::n"), ("J3", "1", f, "json::f.json::x.z"), ("J4", "3", f, "jsonlen::f.json::x.y"), ("J5", "1", f, "jsonlen::f.json::x.y?s=p"), ("J6", "2", f, "jsonlen::f.json::x.y?s="),
        ("G1", "40 items", g, "grep::g.md::of 40 items"), ("G2", "41 items", g, "grep::g.md::of 40 items"), ("G3", "40", g, "grep::g.md::of 41"), ("G4", "95% and 5%", g, "grep100::g.md::level 0.95"), ("G5", "95.0%", g, "grep100::g.md::level 0.95"), ("G6", "1", "void", "grep::void::1"),
        ("C1", "10", g, "corpus::n_items"), ("C2", "0", g, "corpus::n_none"), ("C3", "1", g, "corpus::n_other"), ("B1", "0.3085", g, "cp::hi::C2::C1"), ("B2", "0", g, "cp::lo::C2::C1"), ("B3", "0.6915", g, "cp::lo::C1::C1"), ("B4", "1", g, "cp::hi::C1::C2"), ("B5", "1", g, "cp::hi::C9::C1"),
        ("M1", "1", "none", "corpus::n_items"), ("S1", "12", g, "json::f.json::n"), ("D1", "10", g, "corpus::n_items"), ("D1", "11", g, "corpus::n_items "), ("U1", None, g, None), ("N1", None, g, "corpus::n_items"),
    ]
    got = {k[0]: v for k, v in _checked(spark, claims).items() if k[0] != "D1"}
    wrong = {k: v[1] for k, v in got.items() if v[1]}
    assert wrong == {
        "A2": ["printed_differs"], "A4": ["unresolved"], "A5": ["unresolved"], "A6": ["unresolved"], "A9": ["unresolved"], "J3": ["unresolved"], "G2": ["printed_differs"], "G3": ["unresolved"], "G5": ["printed_differs"], "G6": ["unresolved"],
        "C3": ["unresolved"], "B4": ["unresolved"], "B5": ["unresolved"], "M1": ["missing_source"], "S1": ["source_differs"], "U1": ["unresolved"], "N1": ["printed_differs"],
    }
    assert got["A7"][0] == 5 and got["J1"][0] == 2.5 and got["B3"][0] == pytest.approx(1 - 0.3084971, abs=1e-6)
    twice = [v[1] for k, v in _checked(spark, claims).items() if k[0] == "D1"]
    assert sorted(twice) == [["duplicate_id"], ["duplicate_id", "unresolved"]]
    assert _checked(spark, []) == {}


def test_coverage_is_both_ways(spark):
    prose = spark.createDataFrame([(1, "# 7 heads\n1. In 2024 we saw 3.5 of 40 on 2024-01-02, see Table 9.\n```\n88\n```\nv12 1 0"), (2, "40 again, 40"), (3, None)], "doc_id long, text string")
    claims = spark.createDataFrame([("40",), ("3.50",), ("12.5% (6)",), (None,)], "printed string")
    got = {r.number: (r.n_docs, r.n_claims, r.problem) for r in ledger.coverage(prose, claims).collect()}
    assert got == {"40": (2, 1, None), "3.5": (1, 0, "unsourced"), "3.50": (0, 1, "unused"), "12.5": (0, 1, "unused"), "6": (0, 1, "unused"), "1": (1, 0, None), "0": (1, 0, None)}


def _state(record):
    return {r.item_id: (r.ok, r.anchor_present, r.anchor_local, r.error) for r in record.collect()}


def test_only_what_changed_is_read_again(spark):
    texts = {"1910.1": "(a) one rule (b) other rule", "1910.2": "(a) two rules", "1910.3": "(a) three rules"}
    rows = [(1, "29 CFR 1910.1(a)", "one rule"), (2, "29 CFR 1910.1(a)", "other rule"), (3, "29 CFR 1910.2(a)", "absent"), (4, "no clause", "x"), (5, "29 CFR 1910.9(a)", "x"), (6, "29 CFR 1910.3(c)", "three"), (7, None, None)]
    schema, asked = "item_id long, clause string, anchor string", []

    def manifest(t):
        return spark.createDataFrame([("29", k, str(hash(v))) for k, v in t.items()], "title string, section string, digest string")

    def reader(t):
        def read(keys):
            asked.append(sorted(r.section for r in keys.collect()))
            return spark.createDataFrame([("29", k, v) for k, v in t.items()], "title string, section string, text string").join(keys, ["title", "section"], "left_semi")

        return read

    items = spark.createDataFrame(rows, schema)
    first = provenance.reverify(items, manifest(texts), reader(texts))
    assert asked == [["1910.1", "1910.2", "1910.3"]]
    assert _state(first) == {1: (True, True, True, None), 2: (True, True, True, None), 3: (False, False, None, None), 4: (False, False, None, "unparsed"), 5: (False, False, None, "no_section"), 6: (False, True, False, None), 7: (False, False, None, "unparsed")}
    n = provenance.totals(first).first().asDict()
    assert n == {"n_items": 7, "n_checked": 5, "n_ok": 2, "n_failed": 3, "n_unparsed": 2, "n_warnings": 1, "n_sections": 3, "n_section_errors": 1}
    assert [r.item_id for r in provenance.warnings(first).collect()] == [6]

    def never(keys):
        raise AssertionError("a section was read")

    again = provenance.reverify(items, manifest(texts), never, first)
    assert _state(again) == _state(first)
    # a changed anchor, a changed section, an item that is gone, a new one, and a section that the reader does not have
    later = texts | {"1910.2": "(a) two rules, now absent", "1910.4": "(a) four"}
    moved = spark.createDataFrame([(1, "29 CFR 1910.1(a)", "other rule"), *rows[1:5], (8, "29 CFR 1910.4(a)", "four")], schema)
    asked.clear()
    merged = provenance.reverify(moved, manifest(later), reader({k: v for k, v in later.items() if k != "1910.4"}), first)
    assert asked == [["1910.1", "1910.2", "1910.4"]]
    assert _state(merged) == {1: (True, True, True, None), 2: (True, True, True, None), 3: (True, True, True, None), 4: (False, False, None, "unparsed"), 5: (False, False, None, "no_section"), 8: (False, False, None, "no_section")}
    alone = provenance.reverify(items.limit(0), manifest(texts), never)
    assert alone.count() == 0 and provenance.totals(alone).first().n_items == 0
    kept = corpus.recheck(moved.where("item_id < 4").select("item_id", "clause"), merged).collect()
    assert kept == []


def test_arms_are_loaded_only_if_they_can_be_compared(spark, tmp_path):
    def run(name, ids, runs=1):
        score = lambda i: {"item_id": i, "item_type": "category_error" if i == "z" else "factual", "outcome": "correct"}
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps([{"adapter": {"name": name, "arm": name}, "repeat": r, "scores": [score(i) for i in ids]} for r in range(runs)]))
        return str(path)

    a, b, c = run("a", ["x", "y", "z"]), run("b", ["y", "x"]), run("c", ["x"])
    got = read_arms(spark, {"one": a, "two": b})
    assert sorted((r.arm, r.item_id) for r in got.collect()) == [("one", "x"), ("one", "y"), ("two", "x"), ("two", "y")]
    with pytest.raises(Exception, match="y"):
        read_arms(spark, {"one": a, "three": c}).collect()
    with pytest.raises(CorpusError, match="expected one run"):
        read_arms(spark, {"one": a, "four": run("d", ["x", "y"], runs=2)})
    with pytest.raises(CorpusError, match="no arms"):
        read_arms(spark, {})
