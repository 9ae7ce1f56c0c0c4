"""Secret scans with multipart credential linking.

Strong spans stand alone: assignments to secret-like names, access key ids and long hex runs. Weak candidates (a
random-looking token, a user or client id, an endpoint) mean little alone; each text's candidates are joined as
intervals with the parts around them, within scopes (paragraphs, which blank lines part), and one is reported only where
its complements co-occur: a secret needs an identifier, an identifier needs a secret, an endpoint needs both. Strong
spans are parts too: access key ids are identifiers, assigned values and hex runs are secrets.

The join is a sweep over sorted positions inside one document, so documents stay where they are: no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.batches import each

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_identifier", "weak_endpoint")

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Weak candidates. A token counts if it mixes cases and digits and has this much entropy per character.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
TOKEN_ENTROPY = 3.5
IDENTIFIER = re.compile(r"""(?ai:(?:user|user_?name|login|account|client_?id|access_?key(?:_?id)?))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.A)
IDENTIFIER_HINTS = ("user", "login", "account", "client", "access")
#: An endpoint is a URL (found by what follows its scheme, see ``endpoints``) or a host that is assigned.
AFTER_SCHEME = re.compile(r"""://[^\s"'<>]{4}""", re.A)
URL_REST = re.compile(r"""[^\s"'<>]*""", re.A)
HOST = re.compile(r"""(?ai:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+\.[A-Za-z0-9.:/-]+""", re.A)
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
SCHEME = LETTERS | frozenset("0123456789+.-")
ENDPOINT_HINTS = ("://", "host", "endpoint", "server")

#: What parts two scopes: a line with nothing but blanks.
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Strong spans, leftmost and non-overlapping for each kind, as (start, end, kind) in code points."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def _random_looking(token: str) -> bool:
    if not (re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token)):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in map(token.count, set(token))) >= TOKEN_ENTROPY


class _Starts:
    """Sorted intervals of one role; ``meets`` asks whether one overlaps [low, high) in a binary search."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.spans = sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.ends: list[int] = []
        for _, e in self.spans:
            self.ends.append(max(e, self.ends[-1]) if self.ends else e)

    def meets(self, low: int, high: int) -> bool:
        k = bisect_left(self.starts, high)
        return k > 0 and self.ends[k - 1] > low


def _url(text: str, at: int) -> tuple[int, int] | None:
    """The first URL at or after ``at``. Its scheme is read backwards from its ://, so each character of a run is read once."""
    m = AFTER_SCHEME.search(text, at)
    while m:
        k, start = m.start(), None
        while k > at and text[k - 1] in SCHEME:
            k -= 1
            if text[k] in LETTERS:
                start = k
        if start is not None:
            return start, URL_REST.match(text, m.end()).end()
        m = AFTER_SCHEME.search(text, m.start() + 3)
    return None


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs and assigned hosts, leftmost and non-overlapping, in time that follows the text's length."""
    out, at = [], 0
    url, host = _url(text, 0), HOST.search(text)
    while url or host:
        first = url if url and (not host or url[0] <= host.start()) else host.span()
        out.append(first)
        at = first[1]
        if url and url[0] < at:
            url = _url(text, at)
        if host and host.start() < at:
            host = HOST.search(text, at)
    return out


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak candidates whose complements co-occur in their scope. Candidates that overlap a strong span are part of it."""
    low = text.lower()
    strong_at = _Starts([(s, e) for s, e, _ in strong])
    free = lambda s, e: not strong_at.meets(s, e)
    identifiers = [(m.start(), m.end()) for m in IDENTIFIER.finditer(text) if free(m.start(), m.end())] if any(h in low for h in IDENTIFIER_HINTS) else []
    strong_identifiers = [(s, e) for s, e, k in strong if k == "access"]
    strong_secrets = [(s, e) for s, e, k in strong if k != "access"]
    if not (identifiers or strong_identifiers):
        return []  # every weak kind needs an identifier, weak or strong
    taken = _Starts(identifiers)
    secrets = [(m.start(), m.end()) for m in TOKEN.finditer(text) if free(m.start(), m.end()) and not taken.meets(m.start(), m.end()) and _random_looking(m[0])]
    if not (secrets or strong_secrets):
        return []
    at_hosts = [x for x in endpoints(text) if free(*x)] if any(h in low for h in ENDPOINT_HINTS) else []
    breaks = [m.start() for m in BLANK_LINE.finditer(text)]
    all_ids, all_secrets = _Starts(identifiers + strong_identifiers), _Starts(secrets + strong_secrets)

    def scope(s: int, e: int) -> tuple[int, int]:
        before, after = bisect_left(breaks, s), bisect_left(breaks, e)
        return breaks[before - 1] if before else 0, breaks[after] if after < len(breaks) else len(text)

    out = [(s, e, "weak_secret") for s, e in secrets if all_ids.meets(*scope(s, e))]
    out += [(s, e, "weak_identifier") for s, e in identifiers if all_secrets.meets(*scope(s, e))]
    out += [(s, e, "weak_endpoint") for s, e in at_hosts if all_ids.meets(*scope(s, e)) and all_secrets.meets(*scope(s, e))]
    return out


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in _ordered(spans))


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(strong, weak) spans of one text; null counts as empty."""
    text = text or ""
    strong = base_spans(text)
    return strong, weak_spans(text, strong)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every reported span, overlapping ones together, replaced by a mark."""
    if not text:
        return text
    strong, weak = find(text)
    out, at = [], 0
    for s, e, _ in sorted(strong + weak):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if out else text


SCANNED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row, repeated or not, over whole texts.

    Null and empty texts have no spans: counts 0, the digest of the empty string, spans ''. Other columns of ``docs``
    are not read. Memory is one Arrow batch; positions are code points with exclusive ends.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {SCANNED}"
    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                strong, weak = find(value.as_py())
                kinds = [k for _, _, k in strong]
                digest = hashlib.sha256(joined(strong).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, joined(strong + weak)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return docs.select(id_col, text).mapInArrow(run, schema)


@F.arrow_udf(T.StringType())
def redacted(texts: pa.Array) -> pa.Array:
    """Column form of ``redact``; null stays null."""
    return each(redact, texts.type, texts)


def op2_query(docs: DataFrame) -> DataFrame:
    return scan(docs)
