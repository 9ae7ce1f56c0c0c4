"""Filter interaction audit: what each filter removes, in every order of the filters.

Texts are routed by fingerprint: documents go to the partition of their text's xxhash, where equal hashes form a chain of
(full text, least id), so texts are told apart by themselves and a hash collision only makes a chain longer. A row whose
text a smaller id has is a duplicate. Map tasks keep such chains too and send each distinct text once (a bounded amount
of text at a time), with its least id; their other rows are settled there and travel without text. So a text that a third
of all rows share arrives a few times from a map task, and a task holds the distinct texts of its own partition, never a
group of copies.

Which filters a document fails is a mask of bits. Masks meet the labels by id, and combineByKey merges them into count
vectors, one number a mask, for each part. All orders follow from a part's vector alone: a filter removes what fails it
and passes all filters before it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.scratch import saved

UPPER, MARKS = bytes(range(65, 91)), b"#$%&*|"

#: Filters on one text by letter: each gets (text, its UTF-8 bytes, its words) and says whether the text fails.
FILTERS: dict[str, Callable[[str, bytes, list[bytes]], bool]] = {
    "A": lambda text, raw, words: len(words) < 100,
    "B": lambda text, raw, words: 100 * len(set(words)) < 80 * len(words),
    "C": lambda text, raw, words: 100 * (len(raw) - len(raw.translate(None, UPPER))) > 10 * len(text),
    "D": lambda text, raw, words: len(raw.translate(None, MARKS)) < len(raw),
}
#: The filter that fails a text which a smaller id has too.
DUPLICATE = "E"
#: Characters of text that a map task's chains hold before it sends them, and that it sends at once.
HELD, SENT = 1 << 26, 1 << 22
#: With more filters the n! orders would be too many rows.
MOST_FILTERS = 7


def fails(text: str, filters: Iterable[Callable]) -> int:
    """The mask of the filters that a text fails, first filter lowest. Words are runs of anything but the six ASCII spaces."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    return sum(bool(f(text, raw, words)) << k for k, f in enumerate(filters))


def fingerprint(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Chains:
    """For each fingerprint the texts that have it, each with its least id, its mask and its rows of that id by part."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}

    def add(self, key: int, text: str, doc: object, mask: int, parts: dict[str, int]) -> tuple[object, int, dict[str, int]] | None:
        """Takes rows of one id; returns the rows (id, mask, parts) that now are duplicates, if any."""
        chain = self.by_print.setdefault(key, [])
        for link in chain:
            if link[0] == text:
                if doc == link[1]:
                    for p, n in parts.items():
                        link[3][p] = link[3].get(p, 0) + n
                    return None
                if doc > link[1]:
                    return doc, mask, parts
                out = (link[1], link[2], link[3])
                link[1:] = [doc, mask, dict(parts)]
                return out
        chain.append([text, doc, mask, dict(parts)])
        return None

    def links(self) -> Iterator[tuple[int, list]]:
        return ((key, link) for key, chain in self.by_print.items() for link in chain)


def _sent(filters: list[Callable], digest: Callable[[str], int], duplicate: int, schema: pa.Schema):
    """Map side: rows (key, text, id, part, mask, n), with the text for least ids and without it for settled rows."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def links(chains: Chains) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for key, (text, doc, mask, parts) in chains.links():
            rows += [(key, text, doc, part, mask, n) for part, n in parts.items()]
            size += len(text)
            if size > SENT:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains, nameless, held = Chains(), Counter(), 0
        for b in batches:
            done = []
            for doc, part, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, part = text or "", part or ""
                mask = fails(text, filters)
                if doc is None:  # no id is smaller than none, nor none than any
                    nameless[part, mask] += 1
                    continue
                if late := chains.add(digest(text) >> 1, text, doc, mask, {part: 1}):
                    done += [(fingerprint(str(late[0])) >> 1, None, late[0], p, late[1] | duplicate, n) for p, n in late[2].items()]
                else:
                    held += len(text)
            if done:
                yield batch(done)
            if held > HELD:  # the reduce side takes any number of links of a text
                yield from links(chains)
                chains, held = Chains(), 0
        if nameless:
            yield batch([(fingerprint(part) >> 1, None, None, part, mask, n) for (part, mask), n in nameless.items()])
        yield from links(chains)

    return run


def _settled(duplicate: int):
    """Reduce side: (id, part, mask, rows) of everything that arrived."""

    def run(arrived: Iterable[tuple]) -> Iterator[tuple]:
        chains = Chains()
        rows = lambda doc, mask, parts: ((doc, p, mask, n) for p, n in parts.items())
        for key, (text, doc, part, mask, n) in arrived:
            if text is None:
                yield doc, part, mask, n
            elif late := chains.add(key, text, doc, mask, {part: n}):
                yield from rows(late[0], late[1] | duplicate, late[2])
        for _, (_, doc, mask, parts) in chains.links():
            yield from rows(doc, mask, parts)

    return run


def masks(docs: DataFrame, id_col: str, part: str, text: str, filters: list[Callable], digest: Callable[[str], int] = fingerprint) -> DataFrame:
    """(_id, part, mask, n): how many rows of an id and part have that mask; the duplicate filter is the highest bit.

    What the map side sends is written, so a task that is run again cannot settle other rows than those already read.
    """
    spark, duplicate = docs.sparkSession, 1 << len(filters)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(part).cast("string").alias("part"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["_id"].dataType
    sent = T.StructType([T.StructField("key", T.LongType()), T.StructField("text", T.StringType()), T.StructField("_id", kind), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    source = saved(rows.mapInArrow(_sent(filters, digest, duplicate, to_arrow_schema(sent)), sent), "audit-sent").rdd.map(lambda r: (r[0], tuple(r[1:])))
    partitions = max(source.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = source.partitionBy(partitions, lambda key: key).mapPartitions(_settled(duplicate), preservesPartitioning=True)
    schema = T.StructType([sent["_id"], sent["part"], sent["mask"], sent["n"]])
    # ids that repeat, and null, meet the labels as one row a part and mask
    return spark.createDataFrame(found, schema, verifySchema=False).groupBy("_id", "part", "mask").agg(F.sum("n").alias("n"))


def report(letters: str, vector: np.ndarray) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part.

    ``vector`` has a row each for all, good and toxic documents and a column a mask.
    """
    every, good, toxic = vector
    mask = np.arange(1 << len(letters))
    orders = ["".join(o) for o in permutations(letters)]
    failing = np.bitwise_count(mask.astype(np.uint32)).astype(np.int64)
    share = {f: int((every * np.where(mask >> k & 1, len(orders) // np.maximum(failing, 1), 0)).sum()) for k, f in enumerate(letters)}
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << letters.index(f)
            own, gone = (mask & bit) > 0, (mask & before) > 0
            here, before = own & ~gone, before | bit
            numbers = (every[(mask & before) == 0], every[here], every[own & gone], every[mask == bit], good[here], toxic[here])
            yield order, step, *(int(x.sum()) for x in numbers), share[f]


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part: str = "lang", text: str = "text", filters: dict[str, Callable] | None = None, digest: Callable[[str], int] = fingerprint) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of ``report``.

    ``filters`` map letters to tests of one text (FILTERS, the duplicate filter is always added). Null texts are empty,
    null parts are the empty string; both count. Repeated rows count each for itself: a row is a duplicate if its text
    also stands under a smaller id, so rows of one id are none of each other. A null id is neither a duplicate nor
    makes one, and has no labels. Of several label rows of an id, any quality or toxic of 1 holds; ids in ``labels``
    without a document, and documents without labels, count as neither. An empty table gives none. Columns besides id,
    part, text and ``labels``' id, quality and toxic are not read. A task holds the distinct texts of its partition.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join(filters) + DUPLICATE
    if len(letters) > MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"at most {MOST_FILTERS - 1} filters with different letters other than {DUPLICATE}: {list(filters)}")
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    joined = masks(docs, id_col, part, text, list(filters.values()), digest).join(known, "_id", "left").select("part", "mask", "n", "good", "toxic")
    size = 1 << len(letters)

    def put(vector: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        vector[:, mask] += n, n * (good or 0), n * (toxic or 0)
        return vector

    vectors = joined.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: put(np.zeros((3, size), np.int64), row), put, lambda a, b: a + b)
    rows = vectors.flatMap(lambda kv: ((kv[0], *line) for line in report(letters, kv[1])))
    return docs.sparkSession.createDataFrame(rows, REPORT, verifySchema=False)


def op12_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs.select("doc_id", "lang", "text"), labels)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > least THEN 16 ELSE 0 END) AS mask,
        coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(f, bit)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step::INT AS step, f, bit, (SELECT coalesce(sum(x.bit), 0) FROM f x WHERE contains(left(filter_order, step::INT - 1), x.f)) AS before
    FROM o, range(1, 6) AS g(step), f WHERE substr(filter_order, step::INT, 1) = f),
p AS (SELECT part, mask, n, good, toxic, bit_count(mask::INT) AS k FROM c),
sh AS (SELECT part, bit, sum(CASE WHEN mask::INT & bit > 0 THEN n * (120 // greatest(k, 1)) ELSE 0 END)::BIGINT AS shapley FROM p, f GROUP BY ALL)
SELECT p.part, filter_order, step, (sum(CASE WHEN mask::INT & (before::INT | s.bit) = 0 THEN n ELSE 0 END))::BIGINT AS kept,
    (sum(CASE WHEN mask::INT & before::INT = 0 AND mask::INT & s.bit > 0 THEN n ELSE 0 END))::BIGINT AS removed,
    (sum(CASE WHEN mask::INT & before::INT > 0 AND mask::INT & s.bit > 0 THEN n ELSE 0 END))::BIGINT AS redundant,
    (sum(CASE WHEN mask = s.bit THEN n ELSE 0 END))::BIGINT AS unique_fails,
    (sum(CASE WHEN mask::INT & before::INT = 0 AND mask::INT & s.bit > 0 THEN good ELSE 0 END))::BIGINT AS good_lost,
    (sum(CASE WHEN mask::INT & before::INT = 0 AND mask::INT & s.bit > 0 THEN toxic ELSE 0 END))::BIGINT AS toxic_lost, any_value(shapley) AS shapley
FROM p, s JOIN sh ON sh.bit = s.bit WHERE sh.part = p.part GROUP BY p.part, filter_order, step
"""
