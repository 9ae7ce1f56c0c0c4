import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from plumbline.llm import batches, near_copies, secrets, simhash

SCHEMA = "doc_id long, source string, lang string, url string, text string, n_chars long"


@pytest.fixture
def own_batches(spark):
    before = spark.conf.get(batches.SETTING)
    yield
    spark.conf.set(batches.SETTING, before)


@pytest.mark.parametrize(("rows", "bound"), [("10000", 1000), ("0", 1000), ("7", 7)])
def test_stages_with_python_bound_their_batches(spark, own_batches, rows, bound):
    spark.conf.set(batches.SETTING, rows)
    docs = spark.createDataFrame([(i, "a", "en", "u", "one two", 7) for i in range(2500)], SCHEMA).coalesce(1)
    clean = corpus_pipeline.without_secrets(spark, docs, "")
    sizes = [r.n for r in clean.mapInArrow(lambda them: (pa.record_batch({"n": [b.num_rows]}) for b in them), "n long").collect()]
    assert sum(sizes) == 2500 and max(sizes) <= bound


def test_columns_hold_few_texts_at_once():
    texts = pa.array(["the same text twice over " * 100 + str(k) for k in range(2000)] + [None])
    tracemalloc.start()
    made = secrets.redacted.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.equals(texts)
    assert peak < 2_000_000  # all of them are 5 MB


def test_columns_equal_their_functions():
    texts = [None, "", " ", "password = abcdefgh1234", "Été " * 40] + [f"a b c d e f {k}" for k in range(300)]
    column = pa.array(texts)
    assert secrets.redacted.func(column).to_pylist() == [secrets.redact(t) for t in texts]
    assert simhash.fingerprints.func(column).to_pylist() == [simhash.fingerprint(t) for t in texts]
    assert near_copies.signatures.func(column).to_pylist() == [near_copies.signature(t).tolist() for t in texts]
    found = near_copies.sets.func(column)
    assert [np.frombuffer(x, np.uint64).tolist() for x in found.to_pylist()] == [near_copies.shingles(t).tolist() for t in texts]
    a, b = found.slice(5, 299), found.slice(6, 299)
    assert near_copies.linked.func(a, b).to_pylist() == [near_copies.similar(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    assert secrets.redacted.func(pa.array([], pa.string())).to_pylist() == []
