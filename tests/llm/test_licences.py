"""Every full text of the licence table, found as a document."""

from plumbline.llm import licences

FULL = {"Apache-2.0", "Artistic-1.0-Perl", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"}


def test_full_texts(spark):
    files = {licences.IDENTIFIERS.get(f.name, f.name): f.read_text("utf-8") for f in licences.FOLDER.iterdir()}
    assert set(files) == FULL
    rows = [(k, x) for k, x in files.items()]
    rows += [(f"{k} in part", x[: len(x) // 2]) for k, x in files.items()]
    found = {r.doc_id: r.license_id for r in licences.op10_query(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {k: found[k] for k in FULL} == {k: k for k in FULL}
    assert all(found[f"{k} in part"] is None for k in FULL)
