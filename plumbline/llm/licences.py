"""License scans: the digest of a whole text in canonical form, joined to the digests of known texts.

Canonical form: copyright lines dropped, lower case, everything but letters and digits one space, equivalent
spellings made one. Known texts are put in the same form by the same columns, so the two sides cannot drift apart.
The known table is made of constants of this module and of the full texts in ``licence_texts``, and is broadcast; documents are not shuffled.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines that name a holder and say nothing of the licence.
COPYRIGHT_LINE = r"(?im)^[ \t]*(copyright\b[^\n]*(\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*$"
#: Spellings that count as equal, applied in this order to canonical text.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), (r"\b(author|organ)is(e|ation)", "$1iz$2"), (r"\b(favo|behavio)ur", "$1r"), ("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), (r"\bhttps\b", "http")]

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Fixed values: (licence, titles under which its text is found, text). A text counts with each title and without one.
KNOWN = [
    ("MIT", ["MIT License", "The MIT License", "The MIT License (MIT)"], f"{_MIT_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_MIT_WARRANTY}"),
    ("MIT-0", ["MIT No Attribution"], f"{_MIT_GRANT}.\n\n{_MIT_WARRANTY}"),
    ("BSD-2-Clause", ["BSD 2-Clause License"], f"{_BSD_CLAUSES}\n\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", ["BSD 3-Clause License"], f"{_BSD_CLAUSES}\n{_BSD_THIRD}\n\n{_BSD_WARRANTY}"),
    ("ISC", ["ISC License"], f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}"),
    ("0BSD", ["BSD Zero Clause License", "Zero-Clause BSD"], f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}"),
    ("Apache-2.0-notice", [], "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", [], "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", [], "Licensed under CC BY-NC 4.0."),
]
#: A caller's table of digests is broadcast up to so many rows (about 15 MB).
BROADCAST_KNOWN = 100_000
#: Full texts by file, each named as its licence.
FOLDER = Path(__file__).parent / "licence_texts"
#: Licence identifiers of the files whose names are not theirs.
IDENTIFIERS = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-3": "LGPL-3.0", "Artistic": "Artistic-1.0-Perl"}


def canonical(text: Column) -> Column:
    """Canonical form of a whole text; null gives null."""
    out = F.regexp_replace(text, COPYRIGHT_LINE, " ")
    out = F.trim(F.regexp_replace(F.lower(out), r"[^\p{L}\p{N}]+", " "))
    for spelling, one in SPELLINGS:
        out = F.regexp_replace(out, spelling, one)
    return out


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where nothing is left of the text."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): the constants and the files; an apostrophe is a space, as in canonical form, so SQL can quote."""
    short = [(name, f"{title}\n\n{body}".strip()) for name, titles, body in KNOWN for title in ["", *titles]]
    return short + [(IDENTIFIERS.get(f.name, f.name), f.read_text("utf-8").replace("'", " ")) for f in sorted(FOLDER.iterdir())]


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license_id); of two licences with the same canonical text the first by name stands."""
    made = spark.createDataFrame(known_texts() if texts is None else texts, "license_id string, _body string")
    return made.select(digest(F.col("_body")).alias("_known"), "license_id").groupBy("_known").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """``docs`` with canonical_sha256 and license_id (null: not a known text). Columns of those names are replaced.

    ``known`` is broadcast up to BROADCAST_KNOWN rows and shuffled beyond, where Spark splits digests that many rows
    share. Every row gives one row, repeated or not. Null, empty and punctuation-only texts have a null digest and no
    licence. Only a text that is a licence as a whole is one; a licence line inside prose is not.
    """
    known = F.broadcast(known_digests(docs.sparkSession)) if known is None else known if known.limit(BROADCAST_KNOWN + 1).count() > BROADCAST_KNOWN else F.broadcast(known)
    kept = docs.drop("canonical_sha256", "license_id").withColumn("canonical_sha256", digest(F.col(text)))
    return kept.join(known, F.col("canonical_sha256") == F.col("_known"), "left").drop("_known")


def op10_query(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", "canonical_sha256", "license_id")


def op10_sql() -> str:
    def form(x: str) -> str:
        out = rf"trim(regexp_replace(lower(regexp_replace({x}, '{COPYRIGHT_LINE}', ' ', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        for spelling, one in SPELLINGS:
            out = f"regexp_replace({out}, '{spelling}', '{one.replace('$', chr(92))}', 'g')"
        return f"sha256(nullif({out}, ''))"

    rows = ", ".join(f"('{name}', '{body}')" for name, body in known_texts())
    return f"""WITH k AS (SELECT {form('body')} AS digest, min(id) AS license_id FROM (VALUES {rows}) AS v(id, body) GROUP BY 1),
d AS (SELECT doc_id, {form('text')} AS canonical_sha256 FROM documents)
SELECT doc_id, canonical_sha256, license_id FROM d LEFT JOIN k ON canonical_sha256 = digest"""
