"""Citations of standards in free text, their grades, and where in a section an anchor stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of the citation forms.
CFR = r"(?i)(\d{1,2})\s*c\.?f\.?r\.?\s*(?:part\s*)?(\d{2,4}(?:\.\d+)?(?:-\d+)?)((?:\s*\([0-9a-z]{1,4}\))*)"
BARE = r"(?i)(?<![\d.])(?:§\s*)?(19\d{2}\.\d++|68\.\d++|54\.\d++(?:-\d++)?+)(?!\.\d)((?:\s*\([0-9a-z]{1,4}\))*)"  # 68.1.2.3 is an address
BARE_TITLES = {"1904.": "29 cfr", "1910.": "29 cfr", "1926.": "29 cfr", "68.": "40 cfr", "54.": "46 cfr"}
PAID = {
    "asme ug": r"(?i)\bug-?\s?(\d{2,3})\b", "nfpa": r"(?i)\bnfpa\s*(\d{1,4}[a-z]?)\b",
    "api": r"(?i)\bapi\s*(?:rp|std|standard|recommended practice)?\s*(\d{2,4})\b", "iso": r"(?i)\biso\s*(\d{3,5}(?:-\d+)?)\b",
}
PAYWALLED = ("asme ug", "nfpa", "api", "iso", "ansi", "asme bpvc")
SECTION = r"\b(\d{1,2})\s*CFR\s*([0-9]+\.[0-9A-Za-z\-]+)"
MARKER = r"\((?:[a-z]{1,2}|[0-9]{1,2}|[ivxlc]{1,5}|[A-Z]{1,2})\)"
#: Separates the parts of a match while it is one string.
PART = "\u001f"


def _ref(family: Column, section: Column, chain: Column) -> Column:
    parts = F.regexp_extract_all(F.lower(chain), F.lit(r"\(([0-9a-z]{1,4})\)"), F.lit(1))
    return F.struct(family.alias("family"), section.alias("section"), parts.alias("chain"))


def _matches(text: Column, pattern: str, form: str) -> Column:
    """Array of matches, each rewritten by ``form`` with its groups."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.regexp_replace(m, pattern, form))


def citations(text: Column) -> Column:
    """Array of structs (family, section, chain), each once, form by form: titled, bare, then the paid families.

    Titled spans are blanked before bare sections are looked for, so a section counts once. A bare section is read
    only under the prefixes whose title is known. Null text has none.
    """
    t = F.coalesce(text, F.lit(""))
    titled = F.transform(_matches(t, CFR, f"$1{PART}$2{PART}$3"), lambda m: _ref(F.concat(F.split(m, PART)[0], F.lit(" cfr")), F.split(m, PART)[1], F.split(m, PART)[2]))
    rest = F.regexp_replace(t, CFR, " | ")
    title = lambda s: F.coalesce(*[F.when(s.startswith(p), F.lit(n)) for p, n in BARE_TITLES.items()])
    bare = F.transform(F.transform(F.regexp_extract_all(rest, F.lit(BARE), F.lit(0)), lambda m: F.regexp_replace(m, r"^§?\s*(19\d{2}\.\d+|68\.\d+|54\.\d+(?:-\d+)?)(.*)$", f"$1{PART}$2")), lambda m: _ref(title(F.split(m, PART)[0]), F.split(m, PART)[0], F.split(m, PART)[1]))
    named = lambda family: lambda s: _ref(F.lit(family), F.lower(s), F.lit(""))
    paid = [F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), named(f)) for f, p in PAID.items()]
    return F.array_distinct(F.concat(titled, F.filter(bare, lambda c: c["family"].isNotNull()), *paid))


def paywalled(family: Column) -> Column:
    return F.coalesce(*[F.when(family.startswith(p), True) for p in PAYWALLED], F.lit(False))


def as_text(ref: Column) -> Column:
    return F.concat(F.upper(ref["family"]), F.lit(" "), ref["section"], F.array_join(F.transform(ref["chain"], lambda x: F.concat(F.lit("("), x, F.lit(")"))), ""))


def same_target(a: Column, b: Column) -> Column:
    return (a["family"] == b["family"]) & (a["section"] == b["section"])


def grade(found: Column, expected: Column, acceptable: Column) -> dict[str, Column]:
    """(citation_grade, cited_cross_reference, unsupported_paywalled) of found references.

    For each found reference the first expected one with its section decides: clause if the chain agrees, else section.
    """
    first = lambda r: F.get(F.filter(expected, lambda w: same_target(r, w)), 0)
    clause = F.exists(found, lambda r: F.coalesce(first(r)["chain"] == r["chain"], F.lit(False)))
    section = F.exists(found, lambda r: first(r).isNotNull())
    label = F.when(F.size(found) == 0, "none").when(clause, "correct_clause").when(section, "correct_section").otherwise("wrong")
    other = F.filter(acceptable, lambda x: ~F.array_contains(expected, x))
    cross = F.exists(found, lambda r: F.exists(other, lambda x: same_target(r, x)))
    lone = F.filter(found, lambda r: paywalled(r["family"]) & ~F.exists(acceptable, lambda x: same_target(r, x)))
    return {"citation_grade": label, "cited_cross_reference": cross, "unsupported_paywalled": F.array_sort(F.array_distinct(F.transform(lone, as_text)))}


def section_of(clause: Column) -> dict[str, Column]:
    """(title, section, part, path, markers) of a clause: the run of markers right after the section, and all after it."""
    hit = F.regexp_extract(clause, SECTION, 0)
    tail = F.when(hit != "", F.regexp_replace(clause, rf"(?s)^.*?{SECTION}", "")).otherwise(F.lit(""))
    run = F.regexp_extract(tail, rf"^((?:{MARKER})*)", 1)
    some = lambda c: F.when(c != "", c)
    section = some(F.regexp_extract(clause, SECTION, 2))
    every = lambda c: F.regexp_extract_all(c, F.lit(f"({MARKER})"), F.lit(1))
    return {"title": some(F.regexp_extract(clause, SECTION, 1)), "section": section, "part": F.substring_index(section, ".", 1), "path": every(run), "markers": every(tail)}


def anchor_local(section_text: Column, anchor: Column, markers: Column) -> Column:
    """Whether a cited marker is among the last six before the anchor; null without anchor, markers or a match."""
    flat = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"(?U)\s+", " "))
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  an array of one element binds a value once
    needle = flat(anchor)
    last = lambda b: F.slice(b, F.greatest(F.size(b) - 5, F.lit(1)), F.lit(6))
    before = lambda text, at: F.regexp_extract_all(F.left(text, F.greatest(at - 1, F.lit(0))), F.lit(f"({MARKER})"), F.lit(1))
    near = lambda text, at: F.when(at > 0, let(before(text, at), lambda b: F.arrays_overlap(last(b), markers)))
    found = let(flat(section_text), lambda text: let(F.call_function("locate", F.lower(needle), F.lower(text)), lambda at: near(text, at)))
    return F.when((needle != "") & (F.size(markers) > 0), found)
