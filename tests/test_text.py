"""The normal form's step in Python, over whole batches."""

import unicodedata

import pyarrow as pa
import pytest

from plumbline.functions import text as T


@pytest.mark.parametrize("rows", [0, 1, 127, 128, 129, 300])
def test_nfkc_takes_a_batch_in_slices(rows, monkeypatch):
    held = [None if i % 7 == 0 else f"ﬁ{i} Ａ½ é" for i in range(rows)]
    want = [None if t is None else unicodedata.normalize("NFKC", t) for t in held]
    assert T._nfkc.func(pa.array(held, pa.string())).to_pylist() == want
    monkeypatch.setattr(T, "ROWS_AT_ONCE", 3)
    assert T._nfkc.func(pa.array(["é", *held], pa.string()).slice(1)).to_pylist() == want


def test_normal_form_of_wide_and_plain_texts(spark):
    texts = [None, "", "  Plain  TEXT ", "ﬁne  Ａ", "½ é", "20 °C"]
    rows = T.normalized(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), "text").orderBy("i").collect()
    assert [r.normal for r in rows] == ["", "", "plain text", "fine a", "1/2 é", "20 degrees c"]
