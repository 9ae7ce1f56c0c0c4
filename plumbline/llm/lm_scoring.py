"""Scoring whole documents with language models learned from the corpus.

Two models share one count of all training tokens: a smoothed unigram base, and a gated recurrent model over the most
frequent words, the end of a text and a few classes of all other words by their ending, within which a word is drawn
by its count. Every document but the held-out ones is counted and trained on.

Counting: tasks count words in bounded tables, Spark sums them. The most frequent words, at most KNOWN_WORDS however
large the corpus, go to the workers; what a document has beyond them is joined to the table of counts by word.
Symbols: with the words known, each text is read once more and written as symbols of two bytes, with its base score and
its rare words; training and scoring read those.
Training: rounds of local passes, each partition starting from the same parameters, which are then averaged in two
steps (groups of partitions on the executors, then the groups). The driver sees one set of parameters a group.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import gru
from plumbline.llm.scratch import saved

#: Held out: documents whose CRC-32 of the id as text leaves this remainder.
FOLDS, HELD_OUT = 7, 2
#: Words whose counts every worker has.
KNOWN_WORDS = 1 << 17
#: Symbols of the recurrent model: the end of a text, classes of other words, and the most frequent words.
SYMBOLS, ENDINGS = 2048, 16
END = b""
#: Training rounds by the share (in sixteenths) of the training documents that each takes; together all of them.
ROUNDS = (1, 3, 12)
#: A task's table of words is passed on when it has so many.
COUNTED = 400_000
#: Texts whose symbols a worker passes on at a time.
ROWS_AT_ONCE = 256
#: Tokens that a worker trains on or scores at a time.
CHUNK_TOKENS = 1 << 21


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; the end of the text is not among them."""
    return (text or "").encode("utf-8", "replace").lower().split()


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass
class Lexicon:
    """What workers know of the counts: total tokens and types, and the most frequent words by falling count."""

    total: int
    types: int
    words: list[bytes]
    counts: np.ndarray
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    index: dict[bytes, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": {}}

    def ready(self) -> Lexicon:
        if not self.index:
            self.index = {w: i for i, w in enumerate(self.words)}
        n = SYMBOLS - 1 - ENDINGS
        self.symbols = np.array([0 if w == END else 1 + ENDINGS + i if i < n else 1 + ending(w) for i, w in enumerate(self.words)], np.int64)
        logs = np.log10(self.counts + 1)
        self.base_logs = logs - self.unseen_log
        tails = np.log10(self.tail_tokens + self.tail_types + 1)
        self.rare_logs = -tails
        inside = (self.symbols > 0) & (self.symbols <= ENDINGS)
        self.own_logs = np.where(inside, logs - tails[np.clip(self.symbols - 1, 0, ENDINGS - 1)], 0)
        return self

    @property
    def unseen_log(self) -> float:
        """log10 of the base's denominator."""
        return float(np.log10(self.total + self.types + 1))

    def symbol_counts(self) -> np.ndarray:
        out = np.zeros(SYMBOLS)
        np.add.at(out, self.symbols[self.symbols == 0], self.counts[self.symbols == 0])
        out[1 : 1 + ENDINGS] = self.tail_tokens
        top = self.symbols > ENDINGS
        out[self.symbols[top]] = self.counts[top]
        return out

    def read(self, text: str | None) -> tuple[int, int, float, float, list[bytes], bytes]:
        """What ``encode`` says of a text: n_tokens, _known, _base, _own, _rare, symbols."""
        n, known, base, own, rare, symbols = (column[0].as_py() for column in self.read_all([text]))
        return n, known, base, own, rare, symbols

    def read_all(self, texts: list[str | None]) -> list[pa.Array]:
        """``read`` of each text, a column a value: the words of all go through one look-up."""
        words: list[bytes] = []
        stops = []  # where a text's end stands
        for text in texts:
            words += tokens(text)
            stops.append(len(words))
            words.append(END)
        stops = np.array(stops, np.int64)
        after = np.concatenate(([0], stops + 1))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        hit = at >= 0
        inside = ~hit
        inside[stops] = False
        where = np.flatnonzero(inside)
        rare = [words[i] for i in where.tolist()]
        ends = np.fromiter(map(ending, rare), np.int64, len(rare))
        symbols, base, own = np.zeros(len(words), "<u2"), np.full(len(words), -self.unseen_log), np.zeros(len(words))
        if len(self.words):
            found = at[hit]
            symbols[hit], base[hit], own[hit] = self.symbols[found], self.base_logs[found], self.own_logs[found]
        symbols[stops], symbols[where], own[where] = 0, 1 + ends, self.rare_logs[ends]
        total = lambda x: np.add.reduceat(x, after[:-1]) if texts else x
        offsets = lambda x: pa.array(x, pa.int32())
        return [
            pa.array(np.diff(after)), pa.array(total(hit.astype(np.int64))), pa.array(total(base)), pa.array(total(own)),
            pa.ListArray.from_arrays(offsets(np.searchsorted(where, after)), pa.array(rare, pa.binary())),
            pa.Array.from_buffers(pa.binary(), len(texts), [None, offsets(2 * after).buffers()[1], pa.py_buffer(symbols)]),
        ]


def count_words(texts: DataFrame) -> DataFrame:
    """(word binary, ending, c) over the one text column; the end of a text counts as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def passed() -> pa.RecordBatch:
            words = list(held)
            out = [pa.array(words, pa.binary()), pa.array([ending(w) for w in words], pa.int32()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["word", "ending", "c"])

        for b in batches:
            for value in b.column(0):
                held.update(tokens(value.as_py()))
                held[END] += 1
                if len(held) > COUNTED:
                    yield passed()
        yield passed()

    return texts.mapInArrow(run, "word binary, ending int, c long").groupBy("word", "ending").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame, known: int | None = None) -> Lexicon:
    """The bounded part of the counts. Which words are frequent enough comes from counts of counts on a log scale."""
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    by_end = {r["ending"]: (r["t"], r["n"]) for r in counts.where(F.col("word") != F.lit(END)).groupBy("ending").agg(F.sum("c").alias("t"), F.count("*").alias("n")).collect()}
    scale = F.floor(F.log2("c") * 64)
    levels = sorted(counts.groupBy(scale.alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect(), reverse=True)
    least, room = None, KNOWN_WORDS if known is None else known
    for _, n, c in levels:
        if n > room:
            break
        least, room = c, room - n
    rows = counts.where(F.col("c") >= F.lit(least)).select("word", "c").collect() if least is not None else []
    rows = sorted(((bytes(w), c) for w, c in rows), key=lambda r: (-r[1], r[0]))
    tails = np.array([by_end.get(k, (0, 0)) for k in range(ENDINGS)], float).reshape(ENDINGS, 2)
    for i, (w, c) in enumerate(rows[: SYMBOLS - 1 - ENDINGS]):
        if w != END and i < SYMBOLS - 1 - ENDINGS:
            tails[ending(w)] -= (c, 1)
    return Lexicon(total, types, [w for w, _ in rows], np.array([c for _, c in rows], float), tails[:, 0], tails[:, 1])


def encode(docs: DataFrame, words: Lexicon) -> DataFrame:
    """(_id, _fold, _part, n_tokens, _known, _base, _own, _rare, symbols) of docs (text, _id, _fold, _part).

    symbols are the text's, its end included, as little-endian uint16. _known tokens are among the lexicon's words and
    _base is their base score and the constant part of the others'; _own is what the drawing of words within classes
    adds to the model's score, but for the counts of the rare words, which are listed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)  # KNOWN_WORDS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.ready()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *known.read_all(part.column(0).to_pylist())], names=names)

    names = ["_id", "_fold", "_part", "n_tokens", "_known", "_base", "_own", "_rare", "symbols"]
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names[:3])
    return docs.select("text", *names[:3]).mapInArrow(run, f"{kept}, n_tokens long, _known long, _base double, _own double, _rare array<binary>, symbols binary")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], pa.Table]]:
    """(symbols of each row, the other columns) in chunks of CHUNK_TOKENS or a batch more; symbols come last."""
    held, docs, n = [], [], 0
    for b in batches:
        own = [np.frombuffer(x.as_buffer(), "<u2").astype(np.int32) for x in b.column(b.num_columns - 1)]
        held.append(b.select(range(b.num_columns - 1)))
        docs += own
        n += sum(map(len, own))
        if n >= CHUNK_TOKENS:
            yield docs, pa.Table.from_batches(held)
            held, docs, n = [], [], 0
    if docs:
        yield docs, pa.Table.from_batches(held)


def fit(training: DataFrame, words: Lexicon, rounds: tuple[int, ...] = ROUNDS) -> gru.Params:
    """Parameters learned from all rows of ``training`` (_part in 0..15, symbols)."""
    spark = training.sparkSession
    p = gru.fresh(SYMBOLS)
    gru.set_biases(p, words.ready().symbol_counts())
    seen = [np.full_like(a, 1e-6) for a in p]
    low = 0
    for share in rounds:
        start = spark.sparkContext.broadcast((gru.packed(p), gru.packed(seen)))

        def local(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            like, n = gru.fresh(SYMBOLS), 0
            own, sums = (gru.unpacked(x, like) for x in start.value)
            for docs, _ in _chunks(batches):
                gru.train(own, sums, docs)
                n += sum(map(len, docs))
            if n:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([gru.packed([*own, *sums])], pa.binary())], names=["part", "n", "p"])

        def mean(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["part"].to_pylist(), table["n"].to_pylist(), table["p"], strict=True), key=lambda r: r[0])
            n = sum(r[1] for r in rows)
            total = sum(np.frombuffer(r[2].as_py(), "<f4").astype(float) * (r[1] / n) for r in rows)
            return pa.table({"part": [rows[0][0]], "n": [n], "p": [total.astype("<f4").tobytes()]})

        taken = training.where(F.col("_part").between(low, low + share - 1)).select("symbols")
        low += share
        groups = max(1, round(taken.rdd.getNumPartitions() ** 0.5)) if share else 1
        kind = "part long, n long, p binary"
        found = taken.mapInArrow(local, kind).groupBy(F.col("part") % groups).applyInArrow(mean, kind).collect()
        if found:
            flat = np.frombuffer(mean(pa.table({k: [r[k] for r in found] for k in ("part", "n", "p")}))["p"][0].as_py(), "<f4")
            both = gru.unpacked(flat, [*p, *seen])
            p, seen = both[: len(p)], both[len(p) :]
        start.destroy()
    return p


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Null and empty texts are the end alone. Repeated rows count, train and are scored each for itself; a null id
    counts as the empty text in the fold. Without training documents every count is zero. Scores are log10; a factor of
    the model's below 1e-300 counts as that.
    """
    rest = fold(id_col)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"), rest.alias("_fold"))
    counts = saved(count_words(base.where(F.col("_fold") != HELD_OUT).select("text")), "lm-counts")
    words = lexicon(counts)
    part = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("round")), F.lit(16))
    held = saved(encode(base.withColumn("_part", part), words).withColumn("_row", F.monotonically_increasing_id()), "lm-symbols")
    p = fit(held.where(F.col("_fold") != HELD_OUT).select("symbols", "_part"), words)
    params = docs.sparkSession.sparkContext.broadcast(gru.packed(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = gru.unpacked(params.value, gru.fresh(SYMBOLS))
        for docs, rows in _chunks(batches):
            found = gru.score(model, docs) / np.log(10)
            yield from rows.append_column("_model", pa.array(found)).to_batches()

    names = ["_row", "_id", "_fold", "n_tokens", "_known", "_base", "_own"]
    schema = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in names)
    scored = held.select(*names, "symbols").mapInArrow(run, f"{schema}, _model double")
    rare = held.select("_row", F.explode("_rare").alias("_word")).join(counts.select(F.col("word").alias("_word"), "c"), "_word")
    sums = rare.groupBy("_row").agg(F.sum(F.log10(F.col("c") + 1)).alias("_logs"), F.count("*").alias("_found"))
    out = scored.join(sums, "_row", "left")
    more = F.coalesce("_logs", F.lit(0.0))
    return out.select(
        F.col("_id").alias(id_col), (F.col("_fold") == HELD_OUT).alias("held_out"), "n_tokens", (F.col("_known") + F.coalesce("_found", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), (F.col("_base") + more).alias("base_score"), (F.col("_model") + F.col("_own") + more).alias("score"),
    )


def op8_query(docs: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text"))
