"""Queries on text operators: conversations as responses, documents as passages, keys inline in both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import citations as C
from plumbline.functions import text as T
from plumbline.operators import corpus as O
from plumbline.operators import scoring as S
from plumbline.session import table

PHRASES = ["the", "of the", "licensed under", "password", "is", "th", "4"]
CUES = ["by the", "and", "that", "une", "der"]
#: item, required groups, forbidden groups, numeric facts, adjacent terms.
KEYS = [
    (0, [["the", "der"], ["of", "la"]], [["password"]], [], ["licensed", "token"]),
    (1, [["is", "un"], ["this", "une"], ["and", "die"], ["by"]], [], [], ["in", "el"]),
    (2, [["tion"], ["thing", "qu"]], [["not"]], [(3.0, 0.0)], ["or", "que"]),
    (3, [["a", "le"]], [], [], ["an"]),
    (4, [["zzz"], ["for"], ["was", "est"]], [["on"]], [], ["re", "er", "le"]),
]


def _said(s, d):
    """Assistant turns as responses to five items; every seventh failed."""
    rows = table(s, d, "conversations").where("role = 'assistant'")
    return rows.select("conv_id", "turn", (F.col("conv_id") % 5).alias("item_id"), "text", F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "timeout").alias("error"))


def _items(s):
    return s.createDataFrame(KEYS, f"item_id long, {S.KEY}")


def _normal(s, d):
    return T.normalized(table(s, d, "documents").select("doc_id", "text"), "text").select("doc_id", F.length("normal").cast("long").alias("n"), F.md5("normal").alias("digest"))


def _phrases(s, d, asserted):
    rows = T.normalized(_said(s, d), "text")
    flag = (lambda t, p: T.asserted(t, p, CUES)) if asserted else T.contains
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("phrase"), flag(F.col("normal"), p).alias("found")) for p in PHRASES])).alias("_p")
    return rows.select("conv_id", "turn", each).select("conv_id", "turn", "_p.*")


def _numbers(s, d):
    rows = T.normalized(table(s, d, "documents").select("doc_id", "text"), "text")
    v = F.col("_v")
    return rows.select("doc_id", T.numbers(F.col("normal")).alias("_v")).select("doc_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x % 1e6), 3).alias("total"), F.exists(v, lambda x: x == 4).alias("has_four"))


def _abstention(s, d):
    empty, declined = T.abstention(F.col("normal"))
    return T.normalized(table(s, d, "conversations"), "text").select("conv_id", "turn", empty.alias("empty"), declined.alias("abstained"))


def _variants(s, d):
    value = F.col("l_extendedprice") / F.when(F.col("l_linenumber") % 2 == 0, 100).otherwise(1)
    rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(value).cast("double").alias("_v"))
    return rows.select("l_orderkey", "l_linenumber", F.concat_ws("|", T.number_variants(F.col("_v"))).alias("variants"))


def _answers(s, d):
    reply = F.concat(F.lit("ANSWER: "), F.col("text"), F.lit("\nCITATION: "), F.when(F.col("turn") % 3 == 0, "none").otherwise(F.concat(F.lit("clause "), F.col("turn").cast("string"))))
    rows = table(s, d, "conversations").where("role = 'assistant'").withColumn("_r", F.when(F.col("conv_id") % 4 == 0, F.col("text")).otherwise(reply))
    return rows.select("conv_id", "turn", *[v.alias(k) for k, v in T.answer_parts(F.col("_r")).items()]).withColumn("answer", F.md5("answer"))


def _cited(s, d):
    """Whole texts, each with a clause of its own between two words of its middle, in one of eight forms."""
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    n, space = (F.abs(i) % 90 + 10).cast("string"), F.call_function("locate", F.lit(" "), t, F.floor(F.length(t) / 2).cast("int") + 1)
    half = F.when(space > 0, space).otherwise(F.length(t))  # half an address would read as a section
    forms = [
        [F.lit("29 CFR 1910."), n, F.lit("(c)(6)(i)")], [F.lit("See 1910."), n, F.lit("(c) and 40 CFR 68."), n, F.lit("(a)")], [F.lit("ASME UG-1"), n, F.lit(" or NFPA 70E")], [F.lit("API RP 5"), n, F.lit(", ISO 4126-1; 54."), n, F.lit("-13(b)")],
        [F.lit("129 cfr part 1904."), n, F.lit(" (A)(2), api 5"), n], [F.lit("29 CFR 1910."), n, F.lit(" (c) (6) (i) twice 29 CFR 1910."), n, F.lit("(c)(6)(i)")], [F.lit("no citation")], [F.lit("29 c.f.r. 1910."), n, F.lit("(d)")],
    ]
    clause = F.get(F.array(*[F.concat(*f) for f in forms]), (F.abs(i) % 8).cast("int"))
    return table(s, d, "documents").select("doc_id", n.alias("_n"), F.concat(F.left(t, half), F.lit(" | "), clause, F.lit(" | "), F.substr(t, half + 1)).alias("said"))


def _citations(s, d):
    rows = _cited(s, d).select("doc_id", F.explode(C.citations(F.col("said"))).alias("_r"))
    return rows.select("doc_id", C.as_text(F.col("_r")).alias("reference"), C.paywalled(F.col("_r.family")).alias("paywalled"))


def _grades(s, d):
    """Every whole text against an item whose clause is form 0 and whose cross reference is form 1's."""
    clause, other = F.concat(F.lit("29 CFR 1910."), F.col("_n"), F.lit("(c)(6)(i)")), F.concat(F.lit("40 CFR 68."), F.col("_n"), F.lit("(a)"))
    rows = _cited(s, d).select("doc_id", C.citations(F.col("said")).alias("_f"), C.citations(clause).alias("_e"), C.citations(other).alias("_x"))
    graded = C.grade(F.col("_f"), F.col("_e"), F.array_union("_e", "_x"))
    return rows.select("doc_id", *[v.alias(k) for k, v in graded.items()]).withColumn("unsupported_paywalled", F.concat_ws("|", "unsupported_paywalled"))


def _scored(s, d):
    return S.score(_items(s), _said(s, d), cues=CUES)


def _score(s, d):
    return _scored(s, d).select("conv_id", "turn", "item_id", "outcome", F.round("coverage", 6).alias("coverage"), F.round("numeric_coverage", 6).alias("numeric_coverage"), F.concat_ws("|", "forbidden_asserted").alias("forbidden"), F.concat_ws("|", "adjacent_hits").alias("adjacent"))


def _missed(s, d):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    return _scored(s, d).select("conv_id", "turn", "item_id", text("missing_groups").alias("missing_groups"), text("missing_numbers").alias("missing_numbers"), text("contrasted").alias("contrasted"))


def _score_full(s, d):
    """Responses that also cite: the item's clause, its cross reference, a paid standard, or nothing."""
    k = F.abs(F.col("conv_id")) % 4
    said = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, " See 29 CFR 1910.147(c).").when(k == 1, " See 40 CFR 68.79.").when(k == 2, " per NFPA 70E.").otherwise(""))
    items = _items(s).withColumns({"clause": F.lit("29 CFR 1910.147(c)"), "cross_reference": F.array(F.lit("40 CFR 68.79")), "abstention_acceptable": F.col("item_id") % 2 == 0})
    out = S.score_full(items, _said(s, d).withColumn("text", said), CUES, S.Config(coverage=0.6))
    return out.select(
        "conv_id", "turn", "item_id", "outcome", "abstained", "unscorable_reason", "citation_grade", "cited_cross_reference", F.array_join("unsupported_paywalled", "|").alias("unsupported_paywalled"), "utility", F.round("coverage", 6).alias("coverage"),
    )


def _documents(s, d):
    null = F.lit(None).cast("string")
    items = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.struct(F.col("source").alias("standard"), F.col("lang").alias("clause"), null.alias("section_title"), F.col("text").alias("anchor_text")).alias("source"))
    return O.documents(items).select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def _space(s, d):
    excerpts = table(s, d, "benchmark").select(F.col("item_id").alias("excerpt_id"), F.col("text").alias("bare"), O.answered_from(F.lit("a standard"), F.col("item_id").cast("string"), F.lit("by title"), F.col("text")).alias("wrapped"))
    return S.answer_space(_items(s), excerpts, CUES)


def _parts(s, d):
    """Excerpts whose words are their title's as well."""
    text, name = F.col("text"), F.col("item_id").cast("string")
    parts = O.source_parts(O.answered_from(F.lit("a standard"), name, text, text), text)
    return table(s, d, "benchmark").select("item_id", parts["prefix"].alias("prefix"), parts["suffix"].alias("suffix"))


def _retrieved(s, d):
    return s.createDataFrame([(i, i * 3 + 1) for i in range(5)], "item_id long, excerpt_id long")


def _corpus(s, d):
    """Documents in the role of corpus items, some of them broken on purpose."""
    i, t = F.col("doc_id"), F.lit(None).cast("string")
    groups = F.when(i % 11 == 3, F.array().cast("array<array<string>>")).when(i % 11 == 4, F.array(F.array().cast("array<string>"))).otherwise(F.array(F.array(F.col("lang"))))
    return table(s, d, "documents").select(
        F.when(i % 50 == 9, F.lit("dup")).otherwise(i.cast("string")).alias("id"), F.col("text").alias("question"), F.when(i % 13 == 0, F.lit(" ")).otherwise(F.col("lang")).alias("correct_answer"), F.col("source").alias("family"),
        F.when(i % 17 == 0, "other").when(i % 3 == 0, "category_error").otherwise("factual").alias("item_type"), (i % 6 != 0).alias("abstention_acceptable"),
        F.struct(groups.alias("required_concepts")).alias("answer_key"), F.struct(F.when(i % 19 == 0, "").otherwise(F.col("source")).alias("anchor_text"), F.when(i % 23 == 0, "none").otherwise(F.lit("29 CFR 1910.147(c)")).alias("clause")).alias("source"),
        F.struct(F.when(i % 29 == 0, "unverified").otherwise(F.lit("verified")).alias("status")).alias("verification"),
        F.when(i % 31 == 0, t).otherwise(F.concat(F.lit("p"), F.floor(i / 2).cast("string"))).alias("pair_id"), F.when(i % 37 == 0, "c").when(i % 2 == 0, "a").otherwise("b").alias("pair_role"),
    )


def _clauses(df):
    return df.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("29 CFR 19"), (F.col("doc_id") % 90 + 10).cast("string"), F.lit("."), F.col("n_chars").cast("string")).alias("clause"), "text", "lang", "source", "n_chars")


def _recheck(s, d):
    items = _clauses(table(s, d, "documents"))
    moved = F.when(F.col("item_id") % 7 == 0, -1 - F.col("item_id")).otherwise(F.col("item_id"))  # reported under another id
    stored = items.select(moved.alias("item_id"), F.when(F.col("item_id") % 5 == 0, "old").otherwise(F.col("clause")).alias("clause"), (F.col("item_id") % 11 != 0).alias("ok"))
    return O.recheck(items, stored)


def verifiable(s, d):
    """Each whole text as a section with markers at its start, middle and end; anchors are words of its second half."""
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    docs = table(s, d, "documents").withColumn("_half", F.floor(F.length(t) / 2).cast("int"))
    head, tail = F.left(t, F.col("_half")), F.substr(t, F.col("_half") + 1)
    marked = F.concat(F.lit("<p>(a) "), head, F.lit("</p> (b) (1) ‘it’s’ &amp; – "), tail, F.lit(" (2) end"))
    sections = docs.select(F.lit("29").alias("title"), F.concat(F.lit("1910."), i.cast("string")).alias("section"), marked.alias("text"))
    clause = F.concat(F.lit("29 CFR 1910."), i.cast("string"), F.when(i % 3 == 0, "(a)").when(i % 3 == 1, "(b)(1)").otherwise("(c) and (1)"))
    word = F.regexp_extract(tail, r"([a-zA-Z]{4,})", 1)
    anchor = F.when(i % 4 == 0, "absent words").when(i % 4 == 1, F.lit("'it's'  & -")).otherwise(word)  # typed with plain marks
    return docs.select(i.alias("item_id"), clause.alias("clause"), anchor.alias("anchor")), sections


def _verify(s, d):
    out = O.verify(*verifiable(s, d))
    return out.withColumn("markers_missing", F.concat_ws("", "markers_missing"))


def _stats(s, d):
    items = _clauses(table(s, d, "documents")).select(F.col("lang").alias("domain"), F.col("text").alias("question"), "clause", F.when(F.col("item_id") % 2 == 0, "a").otherwise("b").alias("pair_role"))
    return O.domain_stats(items).withColumn("mean_question_words", F.round("mean_question_words", 6))


def _unsourced(s, d):
    return O.unsourced_numbers(table(s, d, "documents").select("doc_id", "text"), table(s, d, "pages").select(F.col("html").alias("text")))


QUERIES = {
    "normalize_text": _normal,
    "contains_phrase": lambda s, d: _phrases(s, d, False),
    "asserted_phrase": lambda s, d: _phrases(s, d, True),
    "extract_numbers": _numbers,
    "number_variants": _variants,
    "abstention": _abstention,
    "answer_parser": _answers,
    "parse_citations": _citations,
    "grade_citations": _grades,
    "concept_coverage": lambda s, d: _score(s, d).select("conv_id", "turn", "item_id", "coverage", "numeric_coverage"),
    "adjacency_hits": lambda s, d: _score(s, d).select("conv_id", "turn", "item_id", "adjacent", "forbidden"),
    "score_outcome": _score,
    "score_full": _score_full,
    "missed_evidence": _missed,
    "corpus_documents": _documents,
    "answer_space_ceiling": lambda s, d: S.ceilings(_space(s, d)),
    "max_coverage_ties": lambda s, d: S.best_excerpts(_space(s, d)).select("item_id", "form", F.round("coverage", 6).alias("coverage"), F.array_join(F.col("excerpts").cast("array<string>"), ",").alias("excerpts")),
    "failure_decomposition": lambda s, d: S.failure_classes(_space(s, d), _retrieved(s, d)),
    "validation_violations": lambda s, d: O.violations(_corpus(s, d)),
    "corpus_digest": lambda s, d: O.digest(table(s, d, "documents"), ["doc_id", "lang", "source", "text"]),
    "offline_recheck": _recheck,
    "verify_sources": _verify,
    "corpus_stats": _stats,
    "unsourced_numbers": _unsourced,
    "source_parts": _parts,
}


def _q(x) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _norm(x: str) -> str:
    out = f"nfc_normalize(coalesce({x}, ''))"
    for a, b in T.CHARACTERS.items():
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return rf"trim(regexp_replace(lower({out}), '\s+', ' ', 'g'))"


SAID = f"said AS (SELECT conv_id, turn, conv_id % 5 AS item_id, {_norm('text')} AS t, CASE WHEN (conv_id + turn) % 7 = 0 THEN 'timeout' END AS error FROM conversations WHERE role = 'assistant')"
HAS = "regexp_matches({t}, '(^|[^a-z0-9])' || {p} || CASE WHEN regexp_matches({p}, '[0-9]$') THEN '($|[^0-9])' ELSE '' END)"
SAYS = """len(list_filter(range(1, greatest(1, length({t}) - length({p}) + 2)), lambda i: substr({t}, i, length({p})) = {p} AND NOT regexp_matches(substr({t}, i - 1, CASE WHEN i > 1 THEN 1 ELSE 0 END), '[a-z0-9]')
  AND NOT (regexp_matches({p}, '[0-9]$') AND regexp_matches(substr({t}, i + length({p}), 1), '[0-9]'))
  AND len(list_filter({cues}, lambda c: contains(substr({t}, greatest(1, i - 70), least(70, i - 1)), c))) = 0)) > 0"""
_rows = lambda k: [(i, g, p) for i, *key in KEYS for g, ps in enumerate(key[k] if k < 2 else [key[3]]) for p in ps]
KEYSQL = ", ".join(f"{n}(item_id, g, p) AS (VALUES {', '.join(f'({i}, {g}, {_q(p)})' for i, g, p in _rows(k))})" for n, k in (("kr", 0), ("kf", 1), ("ka", 3)))
#: A digit number starts where a run of word characters and dots does; the rest of the run goes with it.
NUM = r"regexp_extract_all(t, '(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)[\p{L}\p{N}_.]*|[\p{L}\p{N}_.]+', 1)"
SPELLED = ", ".join(f"({_q(w)}, {v}::DOUBLE)" for w, v in T.number_words().items() if " " not in w)
CUE_RE = "(^|[^a-z0-9])({})"
EMPTY, DECLINES = "length({t}) < 3", "regexp_matches({t}, {a}) AND NOT regexp_matches({t}, {b})"
ABST = DECLINES.format(t="t", a=_q(CUE_RE.format("|".join(T.ABSTENTION_CUES))), b=_q(CUE_RE.format("|".join(T.COMMITMENT_CUES))))
#: (rid, item_id, t, error): evidence of each text against the key of its item, from scn.
EVIDENCE = f"""{KEYSQL},
gr AS (SELECT r.rid, r.item_id, g, bool_or({HAS.format(t='t', p='p')}) AS ok FROM scn r JOIN kr USING (item_id) GROUP BY ALL),
cov AS (SELECT rid, item_id, avg(ok::INT) AS coverage FROM gr GROUP BY ALL),
fb AS (SELECT r.rid, r.item_id, string_agg(DISTINCT p, '|' ORDER BY p) AS forbidden FROM scn r JOIN kf USING (item_id) WHERE {SAYS.format(t='t', p='p', cues=_list(CUES))} GROUP BY ALL),
ad AS (SELECT r.rid, r.item_id, string_agg(DISTINCT p, '|' ORDER BY p) AS adjacent, count(DISTINCT p) AS n FROM scn r JOIN ka USING (item_id) WHERE {SAYS.format(t='t', p='p', cues=_list(CUES))} GROUP BY ALL),
ev AS (SELECT r.*, coverage, coalesce(forbidden, '') AS forbidden, coalesce(adjacent, '') AS adjacent, coalesce(n, 0) AS n,
  CASE WHEN item_id = 2 THEN regexp_matches(t, '(^|[^\\w.])(three|3(\\.0+)?|3(\\.0+)?[^\\d.,])($|[^\\w])')::INT::DOUBLE END AS numeric_coverage FROM scn r JOIN cov USING (rid, item_id) LEFT JOIN fb USING (rid, item_id) LEFT JOIN ad USING (rid, item_id)),
oc AS (SELECT *, CASE WHEN error IS NOT NULL OR length(t) < 3 THEN 'unscorable' WHEN {ABST} THEN 'abstained' WHEN coverage >= 0.75 AND forbidden = '' AND coalesce(numeric_coverage, 1) >= 1 THEN 'correct'
  WHEN n >= 2 OR (n >= 1 AND coverage < 0.5) THEN 'adjacent_substitution' ELSE 'other_incorrect' END AS outcome FROM ev)"""
SCORED = f"WITH {SAID}, scn AS (SELECT *, conv_id * 1000 + turn AS rid FROM said), {EVIDENCE}"
LOST = "outcome = 'unscorable'"
FULL = f"SELECT conv_id, turn, item_id, outcome, round(CASE WHEN {LOST} THEN 0 ELSE coverage END, 6) AS coverage, CASE WHEN NOT {LOST} THEN numeric_coverage END AS numeric_coverage, CASE WHEN {LOST} THEN '' ELSE forbidden END AS forbidden, CASE WHEN {LOST} THEN '' ELSE adjacent END AS adjacent FROM oc"
SPACE = f"""WITH it(item_id) AS (VALUES (0), (1), (2), (3), (4)), fo AS (SELECT item_id AS excerpt_id, 'bare' AS form, text AS x FROM benchmark UNION ALL SELECT item_id, 'wrapped', 'a standard (' || item_id || ', by title) states: ' || text || ' See ' || item_id || '.' FROM benchmark),
no AS (SELECT excerpt_id, form, {_norm('x')} AS t FROM fo), scn AS (SELECT item_id, excerpt_id, form, t, NULL AS error, form || excerpt_id AS rid FROM no CROSS JOIN it), {EVIDENCE}"""
DOCS = "it AS (SELECT doc_id AS item_id, '29 CFR 19' || (doc_id % 90 + 10) || '.' || n_chars AS clause, * FROM documents)"

CITING = "coalesce(text, '') || CASE abs(conv_id) % 4 WHEN 0 THEN ' See 29 CFR 1910.147(c).' WHEN 1 THEN ' See 40 CFR 68.79.' WHEN 2 THEN ' per NFPA 70E.' ELSE '' END"
#: Forms by id, as the query mixes them into the texts, which cite nothing themselves.
CITED = "WITH c AS (SELECT doc_id, abs(doc_id) % 8 AS k, (abs(doc_id) % 90 + 10)::VARCHAR AS n FROM documents)"

ORACLES = {
    "normalize_text": f"WITH n AS (SELECT doc_id, {_norm('text')} AS t FROM documents) SELECT doc_id, length(t)::BIGINT AS n, md5(t) AS digest FROM n",
    "contains_phrase": f"WITH {SAID}, p AS (SELECT unnest({_list(PHRASES)}) AS phrase) SELECT conv_id, turn, phrase, {HAS.format(t='t', p='phrase')} AS found FROM said, p",
    "asserted_phrase": f"WITH {SAID}, p AS (SELECT unnest({_list(PHRASES)}) AS phrase) SELECT conv_id, turn, phrase, {SAYS.format(t='t', p='phrase', cues=_list(CUES))} AS found FROM said, p",
    "abstention": f"WITH n AS (SELECT conv_id, turn, {_norm('text')} AS t FROM conversations) SELECT conv_id, turn, length(t) < 3 AS empty, length(t) >= 3 AND {ABST} AS abstained FROM n",
    "extract_numbers": f"""WITH n AS (SELECT doc_id, {_norm('text')} AS t FROM documents), w(x, v) AS (VALUES {SPELLED}), e AS (SELECT doc_id, replace(x, ',', '')::DOUBLE AS v FROM (SELECT doc_id, unnest({NUM}) AS x FROM n) WHERE x <> ''
  UNION ALL SELECT doc_id, v FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_-]+')) AS x FROM n) JOIN w USING (x))
SELECT doc_id, count(v) AS n, round(coalesce(sum(v % 1e6::DOUBLE), 0), 3) AS total, coalesce(bool_or(v = 4), false) AS has_four FROM n LEFT JOIN e USING (doc_id) GROUP BY ALL""",
    "number_variants": "WITH v AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice / CASE WHEN l_linenumber % 2 = 0 THEN 100 ELSE 1 END)::BIGINT AS v FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN v >= 1000 THEN v || '|' || format('{:,}', v) ELSE v::VARCHAR END AS variants FROM v",
    "answer_parser": r"""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN text ELSE 'ANSWER: ' || text || chr(10) || 'CITATION: ' || CASE WHEN turn % 3 = 0 THEN 'none' ELSE 'clause ' || turn END END AS r FROM conversations WHERE role = 'assistant'),
p AS (SELECT *, CASE WHEN conv_id % 4 = 0 THEN trim(r, ' ') ELSE trim(split_part(substr(r, 9), chr(10), 1), ' ') END AS a FROM c)
SELECT conv_id, turn, md5(a) AS answer, CASE WHEN conv_id % 4 <> 0 AND turn % 3 <> 0 THEN 'clause ' || turn END AS citation, a <> '' AND regexp_replace(lower(a), '\.+$', '') IN ('i don''t know', 'i do not know', 'unknown') AS declined FROM p""",
    "concept_coverage": f"{SCORED}, r AS ({FULL}) SELECT conv_id, turn, item_id, coverage, numeric_coverage FROM r",
    "adjacency_hits": f"{SCORED}, r AS ({FULL}) SELECT conv_id, turn, item_id, adjacent, forbidden FROM r",
    "score_outcome": f"{SCORED} {FULL}",
    "score_full": f"""WITH {SAID.replace(_norm('text'), _norm(CITING))}, scn AS (SELECT *, conv_id * 1000 + turn AS rid FROM said), {EVIDENCE.replace('coverage >= 0.75', 'coverage >= 0.6')}, z AS (SELECT *, abs(conv_id) % 4 AS k, {LOST} AS lost FROM oc)
SELECT conv_id, turn, item_id, outcome, outcome = 'abstained' AS abstained, CASE WHEN lost AND error IS NOT NULL THEN 'adapter_error: ' || error WHEN lost THEN 'empty_response' END AS unscorable_reason,
  CASE WHEN lost OR k = 3 THEN 'none' WHEN k = 0 THEN 'correct_clause' ELSE 'wrong' END AS citation_grade, NOT lost AND k = 1 AS cited_cross_reference, CASE WHEN NOT lost AND k = 2 THEN 'NFPA 70e' ELSE '' END AS unsupported_paywalled,
  CASE outcome WHEN 'abstained' THEN CASE WHEN item_id % 2 = 0 THEN 0.9 ELSE 0.25 END WHEN 'correct' THEN 1.0 WHEN 'other_incorrect' THEN -0.5 WHEN 'adjacent_substitution' THEN -1.0 ELSE 0.0 END::DOUBLE AS utility, round(CASE WHEN lost THEN 0 ELSE coverage END, 6) AS coverage FROM z""",
    "missed_evidence": f"""{SCORED}, mg AS (SELECT rid, string_agg(g::VARCHAR, '|' ORDER BY g) AS m FROM gr WHERE NOT ok GROUP BY ALL),
ct AS (SELECT r.rid, string_agg(DISTINCT p, '|' ORDER BY p) AS c FROM scn r JOIN ka USING (item_id) WHERE {HAS.format(t='t', p='p')} AND NOT {SAYS.format(t='t', p='p', cues=_list(CUES))} GROUP BY ALL)
SELECT conv_id, turn, item_id, CASE WHEN {LOST} THEN '' ELSE coalesce(m, '') END AS missing_groups, CASE WHEN NOT {LOST} AND numeric_coverage < 1 THEN '3.0' ELSE '' END AS missing_numbers, CASE WHEN {LOST} THEN '' ELSE coalesce(c, '') END AS contrasted
FROM oc LEFT JOIN mg USING (rid) LEFT JOIN ct USING (rid)""",
    "corpus_documents": "WITH t AS (SELECT doc_id, concat_ws(' ', coalesce(source, ''), coalesce(lang, ''), '', coalesce(text, '')) AS t FROM documents) SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS n FROM t",
    "answer_space_ceiling": f"{SPACE}, b AS (SELECT form, item_id, bool_or(outcome = 'correct') AS ok FROM oc GROUP BY ALL) SELECT form, count(*) AS n_items, count(*) FILTER (ok) AS n_attainable FROM b GROUP BY ALL",
    "max_coverage_ties": f"{SPACE}, m AS (SELECT *, max(coverage) OVER (PARTITION BY item_id, form) AS best FROM oc) SELECT item_id, form, round(coverage, 6) AS coverage, string_agg(excerpt_id::VARCHAR, ',' ORDER BY excerpt_id) AS excerpts FROM m WHERE coverage = best GROUP BY ALL",
    "failure_decomposition": f"{SPACE}, w AS (SELECT * FROM oc WHERE form = 'wrapped') SELECT item_id, CASE WHEN bool_or(outcome = 'correct') FILTER (excerpt_id = item_id * 3 + 1) THEN 'passes' WHEN bool_or(outcome = 'correct') THEN 'recoverable_by_reranking' ELSE 'no_excerpt_passes' END AS failure FROM w GROUP BY ALL",
    "validation_violations": """WITH c AS (SELECT doc_id AS i, CASE WHEN doc_id % 50 = 9 THEN 'dup' ELSE doc_id::VARCHAR END AS id, text AS q, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE lang END AS a, source AS f,
  CASE WHEN doc_id % 17 = 0 THEN 'other' WHEN doc_id % 3 = 0 THEN 'category_error' ELSE 'factual' END AS ty, doc_id % 6 <> 0 AS ok, CASE WHEN doc_id % 31 <> 0 THEN 'p' || (doc_id // 2) END AS pr,
  CASE WHEN doc_id % 37 = 0 THEN 'c' WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS ro, CASE WHEN doc_id % 23 = 0 THEN 'none' ELSE '29 CFR 1910.147(c)' END AS cl FROM documents),
g AS (SELECT pr, string_agg(ro, ',' ORDER BY ro) AS r FROM c WHERE pr IS NOT NULL GROUP BY ALL)
SELECT 'missing_field' AS rule, id AS item_id, 'id, question, correct_answer, family' AS detail FROM c WHERE trim(coalesce(q, ''), ' ') = '' OR trim(a, ' ') = '' OR f IS NULL
UNION ALL SELECT 'item_type', id, ty FROM c WHERE ty = 'other' UNION ALL SELECT 'no_required_concepts', id, 'required_concepts' FROM c WHERE i % 11 = 3 UNION ALL SELECT 'empty_group', id, 'required_concepts' FROM c WHERE i % 11 = 4
UNION ALL SELECT 'blank_anchor', id, 'anchor_text' FROM c WHERE i % 19 = 0 UNION ALL SELECT 'not_verified', id, 'unverified' FROM c WHERE i % 29 = 0
UNION ALL SELECT 'category_error_must_allow_abstention', id, 'abstention_acceptable' FROM c WHERE ty = 'category_error' AND NOT ok UNION ALL SELECT 'half_pair', id, pr FROM c WHERE pr IS NULL
UNION ALL SELECT 'pair_role', id, ro FROM c WHERE ro = 'c' UNION ALL SELECT 'unparsed_clause', id, cl FROM c WHERE cl = 'none' UNION ALL SELECT 'duplicate_id', id, count(*)::VARCHAR FROM c GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'pair_roles', NULL, pr || ':' || r FROM g WHERE r <> 'a,b'""",
    "verify_sources": r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) // 2 AS half FROM documents),
d AS (SELECT doc_id, doc_id % 3 AS k, doc_id % 4 AS m, regexp_extract(substr(x, half + 1), '([a-zA-Z]{4,})', 1) AS w, '<p>(a) ' || left(x, half) || '</p> (b) (1) ‘it’s’ &amp; – ' || substr(x, half + 1) || ' (2) end' AS raw FROM h),
a AS (SELECT *, CASE m WHEN 0 THEN 'absent words' WHEN 1 THEN '''it''s''  & -' ELSE w END AS an, CASE k WHEN 0 THEN ['(a)'] WHEN 1 THEN ['(b)', '(1)'] ELSE ['(c)', '(1)'] END AS mk, regexp_replace(raw, '<[^>]+>', ' ', 'g') AS bare FROM d),
n AS (SELECT *, lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(bare, '‘', ''''), '’', ''''), '“', '"'), '”', '"'), '–', '-'), ' - ', '-'), '−', '-'), chr(160), ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), ' - ', '-'), '&#8217;', ''''), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ')) AS flat,
  lower(trim(regexp_replace(replace(an, ' - ', '-'), '\s+', ' ', 'g'), ' ')) AS needle, trim(regexp_replace(bare, '\s+', ' ', 'g'), ' ') AS plain FROM a),
b AS (SELECT *, strpos(lower(plain), needle) AS pos, an <> '' AND contains(flat, needle) AS has FROM n),
l AS (SELECT *, regexp_extract_all(left(plain, greatest(pos - 1, 0)::BIGINT), '\((?:[a-z]{1,2}|[0-9]{1,2}|[ivxlc]{1,5}|[A-Z]{1,2})\)') AS pre FROM b)
SELECT doc_id AS item_id, has AS anchor_present, CASE WHEN k = 2 AND NOT contains(plain, '(c)') THEN '(c)' ELSE '' END AS markers_missing,
  CASE WHEN an <> '' AND pos > 0 THEN list_has_any(list_slice(pre, greatest(len(pre) - 5, 1), len(pre)), mk) END AS anchor_local, has AND NOT (k = 2 AND NOT contains(plain, '(c)')) AS ok FROM l""",
    "corpus_digest": """WITH h AS (SELECT sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS p, count(*) AS n FROM documents GROUP BY ALL),
a AS (SELECT left(p, 5) AS p, sum(n)::BIGINT AS n, sha256(string_agg(p || ':' || n, chr(30) ORDER BY p)) AS d FROM h GROUP BY left(p, 5)),
b AS (SELECT left(p, 3) AS p, sum(n)::BIGINT AS n, sha256(string_agg(d, chr(30) ORDER BY p)) AS d FROM a GROUP BY left(p, 3))
SELECT sum(n)::BIGINT AS n_items, sha256(string_agg(d, chr(30) ORDER BY p)) AS digest FROM b""",
    "offline_recheck": f"WITH {DOCS}, st AS (SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'old' ELSE clause END AS c, item_id % 11 <> 0 AS ok FROM it), sm AS (SELECT * REPLACE (CASE WHEN item_id % 7 = 0 THEN -1 - item_id ELSE item_id END AS item_id) FROM st), j AS (SELECT item_id, CASE WHEN c IS NULL THEN 'not_in_report' WHEN c <> clause THEN 'clause_differs' WHEN NOT ok THEN 'failed' END AS problem FROM it LEFT JOIN sm USING (item_id)) SELECT * FROM j WHERE problem IS NOT NULL",
    "corpus_stats": rf"WITH {DOCS} SELECT lang AS domain, count(*) AS n_items, count(*) FILTER (item_id % 2 = 0) AS n_pairs, round(avg(len(regexp_extract_all(text, '\S+'))), 6) AS mean_question_words, count(DISTINCT regexp_extract(clause, '(\d+)\.', 1)) AS n_parts FROM it GROUP BY ALL",
    "unsourced_numbers": r"WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\d+(?:,\d{3})*(?:\.\d+)?')) AS number FROM documents), s AS (SELECT DISTINCT unnest(regexp_extract_all(html, '\d+(?:,\d{3})*(?:\.\d+)?')) AS number FROM pages) SELECT doc_id, number FROM n ANTI JOIN s USING (number)",
    "source_parts": "SELECT item_id, 'a standard (' || item_id || ', ' || text || ') states:' AS prefix, 'See ' || item_id || '.' AS suffix FROM benchmark",
    "parse_citations": f"""{CITED}, r AS (SELECT doc_id, unnest(CASE k WHEN 0 THEN ['29 CFR 1910.' || n || '(c)(6)(i)'] WHEN 1 THEN ['40 CFR 68.' || n || '(a)', '29 CFR 1910.' || n || '(c)'] WHEN 2 THEN ['ASME UG 1' || n, 'NFPA 70e']
  WHEN 3 THEN ['46 CFR 54.' || n || '-13(b)', 'API 5' || n, 'ISO 4126-1'] WHEN 4 THEN ['29 CFR 1904.' || n || '(a)(2)', 'API 5' || n] WHEN 5 THEN ['29 CFR 1910.' || n || '(c)(6)(i)'] WHEN 6 THEN [] ELSE ['29 CFR 1910.' || n || '(d)'] END) AS reference FROM c)
SELECT doc_id, reference, NOT contains(reference, 'CFR') AS paywalled FROM r""",
    "grade_citations": f"""{CITED} SELECT doc_id, CASE WHEN k IN (0, 5) THEN 'correct_clause' WHEN k IN (1, 7) THEN 'correct_section' WHEN k = 6 THEN 'none' ELSE 'wrong' END AS citation_grade, k = 1 AS cited_cross_reference,
  CASE k WHEN 2 THEN 'ASME UG 1' || n || '|NFPA 70e' WHEN 3 THEN 'API 5' || n || '|ISO 4126-1' WHEN 4 THEN 'API 5' || n ELSE '' END AS unsupported_paywalled FROM c""",
}
