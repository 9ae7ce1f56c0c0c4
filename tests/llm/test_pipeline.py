"""The pipeline's stages, each on its own input, against brute-force versions."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from test_native import base
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

from plumbline.llm import mixing, packing, scratch, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        words = [f"{rng.choice(['mi', 'lo', 'Ta', 'né'])}{rng.randint(0, 400)}" for _ in range(rng.randint(30, 140))]
        if i % 9 == 0:
            words.insert(7, "password=b7db7aa4a5fcc78305")
        rows.append((len(rows), " ".join(words), "en", f"s{min(i % 7, 3)}"))
        if i % 5 == 0:
            rows.append((len(rows), rows[-1][1] if i % 2 else rows[-1][1].replace("mi1 ", "mi2 "), "en", "s9"))
        if i % 11 == 0:
            rows.append((len(rows), "| junk " * 80, "xx", "s1"))
    rows += [(len(rows), None, None, None), (len(rows) + 1, "", "en", "s0"), (3, rows[3][1], "en", rows[3][3])]
    rows = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash", "secrets", "mixing", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, folder)
    assert kept.columns == COLUMNS
    good = [r for r in docs.collect() if not base(r.text)[-1] and "|" not in r.text]
    assert Counter(kept.collect()) == Counter(good)

    one = stage["simhash"](spark, kept, folder)
    assert one.columns == COLUMNS
    prints = {r.doc_id: brute_print(r.text) for r in good}
    least = brute_components(prints)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(least.values())) != sorted(prints)

    clean = stage["secrets"](spark, one, folder)
    assert clean.columns == COLUMNS and clean.schema == one.schema
    texts = {r.doc_id: r.text for r in one.collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {i: (t := secrets.redact(x), len(t)) for i, x in texts.items()}
    assert any("[SECRET]" in r.text for r in clean.collect()) and not any("password=b" in r.text for r in clean.collect())

    mixed = stage["mixing"](spark, clean, folder)
    assert mixed.columns == COLUMNS
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect() if r.copies}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(copies) and max(copies.values()) > 1

    t = Tokenizer.from_file(packing.default_tokenizer())
    n = {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect()}
    total = Counter()
    for r in stage["packing"](spark, mixed, folder).collect():
        assert r.doc_tokens == n[r.doc_id]
        total[r.doc_id] += r.length
    assert total == Counter({i: k * n[i] for i, k in copies.items()})
    ran = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        ran[r.doc_id] += r.length
    assert ran == total


def test_stages_on_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_tables_on_the_way_are_dropped(spark, folder):
    before = len(scratch._MADE)
    corpus_pipeline.run(spark, folder)
    assert len(scratch._MADE) - before <= 3  # the last stage's input and its own tables
    scratch.clear()


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(dict)

        conf = {}  # noqa: RUF012

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Cluster)
