import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import filter_audit


def brute(docs, labels):
    """Every order walked document by document."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(i, p or "", t or "") for i, p, t in docs]

    def failing(i, t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A"} if len(words) < 100 else set()
        out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        out |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        return out | ({"E"} if i is not None and any(j is not None and j < i and u == t for j, _, u in rows) else set())

    facts = [(p, failing(i, t), i in good, i in toxic) for i, p, t in rows]
    out = {}
    for part in {p for p, *_ in facts}:
        mine = [f for f in facts if f[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(gone)
                own = [x for x in mine if f in x[1]]
                out[part, "".join(order), step] = [len(left), len(gone), len(own) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), numbers in out.items():
            if p == part:
                numbers.append(total[order[step - 1]])
    return out


def table():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["SHOUT", "LOUD", "a#b", "50%", "é", "a\x1cb", "𝒳"]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 300, 307])]) for _ in range(rng.choice([1, 99, 100, 101, 160]))) for _ in range(40)]
    texts += [None, "", " \t\n\v\f\r", "x" * 200000, "WORD " * 30000]
    docs = [(i, rng.choice(["en", "de", None, ""]), rng.choice(texts)) for i in range(160)]
    docs += [(5, "en", docs[5][2]), (5, "fr", docs[5][2]), (5, "en", texts[0]), (None, "en", texts[0]), (None, None, texts[0]), (None, "xx", None)]
    docs += [(1000 + i, "en", "the same text") for i in range(300)]  # a group of copies
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1300, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (99999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("digest", [filter_audit.fingerprint, lambda text: len(text) % 2])
def test_query_against_brute_force(spark, digest):
    docs, labels = table()
    frame = spark.createDataFrame([(*d, "clash", 7) for d in docs], "doc_id long, lang string, text string, quality string, part int").repartition(7)
    found = filter_audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), digest=digest).collect()
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in found}
    assert len(got) == len(found) and got == brute(docs, labels)


def test_copies_are_settled_where_they_are_read(monkeypatch):
    """A map task sends one text for a group of copies, whatever its size; chains tell colliding texts apart."""
    rows = [(i, "en", "copy") for i in range(500, 0, -1)] + [(0, "en", "other"), (7, "de", None), (None, "en", "copy")]
    schema = pa.schema([("key", pa.int64()), ("text", pa.string()), ("_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(("_id", "part", "text"), r, strict=True)) for r in rows[k : k + 100]]) for k in range(0, 503, 100)]
    run = lambda: [r for b in filter_audit._sent([], lambda text: 3, 1, schema)(iter(batches)) for r in b.to_pylist()]
    sent = run()
    assert sorted((r["text"], r["_id"]) for r in sent if r["text"] is not None) == [("", 7), ("copy", 1), ("other", 0)]
    assert sorted(r["_id"] for r in sent if r["text"] is None and r["_id"]) == list(range(2, 501))
    assert [(r["mask"], r["n"]) for r in sent if r["_id"] is None] == [(0, 1)]
    monkeypatch.setattr(filter_audit, "HELD", 3)
    monkeypatch.setattr(filter_audit, "SENT", 3)
    assert sorted(r["_id"] for r in run() if r["text"] == "copy") == [1, 101, 201, 301, 401]


def test_vectors_of_a_part():
    vector = np.zeros((3, 4), np.int64)
    vector[0] = [5, 3, 2, 4]  # passes both, fails A only, fails E only, fails both
    lines = {(o, s): rest for o, s, *rest in filter_audit.report("AE", vector)}
    assert lines["AE", 1] == [7, 7, 0, 3, 0, 0, 10] and lines["AE", 2] == [5, 2, 4, 2, 0, 0, 8]
    assert lines["EA", 1] == [8, 6, 0, 2, 0, 0, 8] and lines["EA", 2] == [5, 3, 4, 3, 0, 0, 10]


def test_empty_tables_and_own_filters(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.op12_query(spark.createDataFrame([], "doc_id long, lang string, text string"), labels).collect() == []
    docs = spark.createDataFrame([("a", "en", "x"), ("b", "en", "x"), ("c", "en", "yy")], "doc_id string, lang string, text string")
    found = filter_audit.audit(docs, spark.createDataFrame([("b", 1, None)], "doc_id string, quality int, toxic int"), filters={"L": lambda text, raw, words: len(text) > 1}).collect()
    assert sorted(tuple(r)[1:8] for r in found) == [("EL", 1, 2, 1, 0, 1, 1), ("EL", 2, 1, 1, 0, 1, 0), ("LE", 1, 2, 1, 0, 1, 0), ("LE", 2, 1, 1, 0, 1, 1)]
    with pytest.raises(ValueError):
        filter_audit.audit(docs, labels, filters={"E": len})
