"""Packing token sequences by minimum bin slack.

Every document becomes token ids and an end id, is cut at multiples of the capacity, and leaves a remainder. What is
packed are the remainders' lengths, not documents: a histogram with fewer entries than the capacity. For each window
the longest length left is taken, and a bitset subset-sum over the multiset of the others finds the fill closest to
capacity; backtracking gives how often each length is used. The same window is then repeated as often as the counts
allow, so the plan's size depends on the number of lengths, not of documents. Where no multiset fills a window, a
longer remainder is cut to fill it; what is left at the end is cut at powers of two, which need no padding.

The plan says which ranks (the how-manieth document of its length) go where. Ranks come from windows over (length,
hash bucket) groups and the buckets' counts, so a length shared by many documents is still ranked in many tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.scratch import saved

CAPACITY = 4096
END_ID = 2
BUCKETS = 1024
#: Words whose ids a worker remembers; when there are more it forgets all but the first, which are mostly common ones.
CACHE_WORDS, KEPT_WORDS = 250_000, 80_000

#: One row of the plan: documents of remainder length0 with rank_from <= rank < rank_from + n put their tokens
#: [start, start + length) of the remainder at offset base + slot * length of sequence seq + item // per, where
#: item = first + rank - rank_from and slot = item % per. depth counts the cuts before this piece.
PLAN_FIELDS = ("length0", "depth", "rank_from", "n", "start", "length", "seq", "per", "base", "first")


def fullest(counts: list[int], lengths: list[int], room: int) -> tuple[int, dict[int, int]]:
    """(fill, {length: times}) of the sub-multiset with the largest sum up to ``room``.

    lengths: those with counts, descending. Bit s of the set says that s can be reached; a length's count enters in
    chunks of 1, 2, 4, ..., so each chunk is one shift. Stops once the room is filled.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        left, chunk = min(counts[n], room // n), 1
        while left > 0 and not reach >> room & 1:
            k = min(chunk, left)
            steps.append((n, k, reach))
            reach |= reach << (k * n) & mask
            left, chunk = left - k, chunk * 2
        if reach >> room & 1:
            break
    fill = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            used[n] = used.get(n, 0) + k
            at -= k * n
    return fill, used


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, ...]], int]:
    """(rows of PLAN_FIELDS, number of sequences) that place every remainder of the histogram {length: count}."""
    counts, runs = [0] * (capacity + 1), [deque() for _ in range(capacity + 1)]
    for n, c in histogram.items():
        counts[n] = c
        runs[n].append((n, 0, 0, c, 0))  # length0, depth, rank_from, n, start
    rows: list[tuple[int, ...]] = []
    seq = 0

    def take(n: int, items: int) -> Iterator[tuple[int, int, int, int, int]]:
        counts[n] -= items
        while items:
            length0, depth, rank, size, start = runs[n].popleft()
            if size > items:
                runs[n].appendleft((length0, depth, rank + items, size - items, start))
                size = items
            items -= size
            yield length0, depth, rank, size, start

    def place(n: int, items: int, length: int, per: int, base: int) -> None:
        """Puts the first ``length`` tokens of ``items`` pieces of length n down; the rest of each goes back."""
        first = 0
        for length0, depth, rank, size, start in list(take(n, items)):
            rows.append((length0, depth, rank, size, start, length, seq, per, base, first))
            first += size
            if length < n:
                runs[n - length].append((length0, depth + 1, rank, size, start + length))
                counts[n - length] += size

    while lengths := [n for n in range(capacity, 0, -1) if counts[n]]:
        top = lengths[0]
        counts[top] -= 1
        fill, used = fullest(counts, lengths, capacity - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        fill += top
        gap = capacity - fill
        donor = next((n for n in lengths if n > gap and counts[n] > used.get(n, 0)), 0) if gap else 0
        times = min(counts[n] // (k + (n == donor)) for n, k in used.items())
        if donor and donor not in used:
            times = min(times, counts[donor])
        if gap and not donor:  # all that is left: cut at powers of two
            offset, room = 0, 1 << (fill.bit_length() - 1)
            for n in sorted(used, reverse=True):
                for _ in range(used[n]):
                    ((length0, depth, rank, _, start),) = take(n, 1)
                    rest = n
                    while rest:
                        size = min(rest, room - offset)
                        rows.append((length0, depth, rank, 1, start, size, seq, 1, offset, 0))
                        depth, start, offset, rest, fill = depth + 1, start + size, offset + size, rest - size, fill - size
                        if offset == room:
                            seq, offset, room = seq + 1, 0, 1 << max(fill.bit_length() - 1, 0)
            continue
        base = 0
        for n in sorted(used, reverse=True):
            place(n, times * used[n], n, used[n], base)
            base += n * used[n]
        if donor:
            place(donor, times, gap, 1, base)
        seq += times
    return rows, seq


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts by a lower-casing tokenizer that drops white space, so each word's ids can be looked up.

    What is remembered are lower-cased words without the marks at their end: such marks are always tokens of their
    own after a letter or digit. Words of plain Latin letters need neither the tokenizer's normal form nor its
    splitting: their pairs merge by rank alone, and a ranked encoder of the same vocabulary does that many times as
    fast. In it the end of a word is a character of its own, which only occurs there. The two agreed on each of a
    million words of text and of random letters; a test compares them.

    Special tokens are matched as they stand, in the raw text and before anything else, so a text is first cut at them.
    What lies between is read without special tokens: a lower-cased ``<|ENDOFTEXT|>`` is text, as it is in the whole.
    """

    MARKS = b".,;:!?"
    WORD_END = "</w>"
    STOP = "\x7f"

    def __init__(self, path: str) -> None:
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        byte_of, stop = byte_characters(), self.STOP.encode()
        ranks: dict[bytes, int] = {}
        for token, i in vocabulary.items():
            if token not in self.special:
                core = token.removesuffix(self.WORD_END)
                ranks[bytes(byte_of[c] for c in core) + (stop if core != token else b"")] = i
        self.ranked = Encoding("words", pat_str=f"[^{self.STOP}]+{self.STOP}", mergeable_ranks=ranks, special_tokens={})
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for t, i in ranks.items() if t.endswith(stop) and len(t) > 1]] = True
        self.known: dict[bytes, bytes] = {}

    def encode(self, words: list[bytes]) -> None:
        """Remembers the ids of lower-cased words as they are."""
        plain = [w for w in words if w.isalpha()]  # bytes: ASCII letters only
        lows, other = [w.decode() for w in plain], []
        for w in words if len(plain) < len(words) else ():
            if not w.isalpha():
                low = (text := w.decode()).lower()
                if low.isalpha() and max(low) < "\u0250":
                    plain.append(w)
                    lows.append(low)
                else:
                    other.append((w, text))
        known = self.known
        if plain:
            ids = np.array(self.ranked.encode_ordinary(self.STOP.join(lows) + self.STOP), np.uint32)
            data, cuts = ids.tobytes(), ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            known.update(zip(plain, [data[a:b] for a, b in zip([0, *cuts], cuts)], strict=True))
        for (w, _), e in zip(other, self.tokenizer.encode_batch_fast([text for _, text in other], add_special_tokens=False), strict=True):
            known[w] = array("I", e.ids).tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Remembers words, those with marks at their end as their parts together."""
        known, marks = self.known, self.MARKS
        cores = {w: core for w in words if len(core := w.rstrip(marks)) < len(w) and self.ends_plainly(core)}
        new = {core for core in cores.values() if core not in known} | {t for w, core in cores.items() if (t := w[len(core) :]) not in known}
        self.encode([*new.difference(words), *(w for w in words if w not in cores)])
        for w, core in cores.items():
            known[w] = known[core] + known[w[len(core) :]]

    @staticmethod
    def ends_plainly(core: bytes) -> bool:
        """Whether the last character is a Latin letter or an ASCII digit, which marks after it never join."""
        if core[-1:].isalnum():
            return True
        last = core[-3:].decode("utf-8", "ignore")[-1:]
        return last.isalpha() and last < "\u0250"

    def ids(self, text: str | None, end_id: int | None = END_ID) -> np.ndarray:
        text = text or ""
        if any(t in text for t in self.special):
            parts = [self.special.get(x) or self.plain(x) for x in self.cut.split(text) if x]
        else:
            parts = [self.plain(text)]
        if end_id is not None:
            parts.append(array("I", [end_id]).tobytes())
        return np.frombuffer(b"".join(parts), np.uint32)

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six ASCII spaces only
        if len(self.known) > CACHE_WORDS:
            self.known = dict(islice(self.known.items(), KEPT_WORDS))
        parts = list(map(self.known.get, words))
        if None in parts:
            missing = [i for i, x in enumerate(parts) if x is None]
            self.learn({words[i] for i in missing})
            for i in missing:
                parts[i] = self.known[words[i]]
        return b"".join(parts)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, with what it has learned in earlier tasks."""
    return Encoder(path)


TOKENS = "n_tokens long, crcs array<long>, ids binary"


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(id, n_tokens, crcs, ids): ids as little-endian uint32 without leading zero bytes packed as uint16 where they fit.

    crcs has the CRC-32 of each piece of ``capacity`` tokens and of the remainder. Null text: only the end id.
    """
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {TOKENS}"
    names = [id_col, "n_tokens", "crcs", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for value in part.column(1):
                    ids = known.ids(value.as_py(), end_id)
                    crcs = [zlib.crc32(ids[k : k + capacity].tobytes()) for k in range(0, len(ids), capacity)]
                    rows.append((len(ids), crcs, ids.astype("<u2").tobytes() if ids.max(initial=0) < 1 << 16 else b"\0" + ids.tobytes()))
                n, crcs, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.binary())], names=names)

    return docs.select(id_col, text).mapInArrow(run, schema)


def unpack_ids(data: bytes) -> np.ndarray:
    """The ids of a row of ``tokenize``: even-sized data holds uint16, odd-sized a zero byte and then uint32."""
    return np.frombuffer(data, "<u4", offset=1) if len(data) % 2 else np.frombuffer(data, "<u2")


def _ranked(tokens: DataFrame, capacity: int) -> DataFrame:
    """tokens (_row, doc_id, n_tokens, crcs) with _rem, _rank (within _rem) and _full_before (full pieces in rows before)."""
    rem, full = (F.col("n_tokens") % capacity).alias("_rem"), F.floor(F.col("n_tokens") / capacity).alias("_full")
    b = F.pmod(F.xxhash64("_row"), F.lit(BUCKETS)).alias("_b")
    narrow = tokens.select("_row", "doc_id", "n_tokens", "crcs", rem, full, b)
    counts = narrow.groupBy("_rem", "_b").agg(F.count("*").alias("_n"), F.sum("_full").alias("_f"))
    before = W.partitionBy("_rem").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_rem", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rank0"))
    by_bucket = counts.groupBy("_b").agg(F.sum("_f").alias("_f"))
    starts = by_bucket.select("_b", F.coalesce(F.sum("_f").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_full0"))
    offsets = offsets.join(starts, "_b").select(F.col("_rem").alias("_r"), F.col("_b").alias("_k"), "_rank0", "_full0")
    in_bucket = W.partitionBy("_b").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    in_both = W.partitionBy("_b", "_rem").orderBy("_row")
    run = narrow.withColumn("_in_full", F.coalesce(F.sum("_full").over(in_bucket), F.lit(0))).withColumn("_in_rank", F.row_number().over(in_both) - 1)
    out = run.join(offsets, F.expr("_rem = _r AND _b = _k"))
    return out.select("_row", "doc_id", "n_tokens", "crcs", "_rem", (F.col("_rank0") + F.col("_in_rank")).cast("long").alias("_rank"), (F.col("_full0") + F.col("_in_full")).cast("long").alias("_full_before"))


PIECES = "_row long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    with_ids adds the piece's ids (array<int>). Every id lies in one piece, sequences have no gaps. Null and empty
    texts are one end id. Repeated rows and null ids are documents of their own. Ties are broken by the row's place in
    the written token table, so all reads agree. An empty table has no pieces.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs.select("doc_id", text), tokenizer_path, text=text, capacity=capacity).withColumn("_row", F.monotonically_increasing_id())
    held = saved(tokens, "pack-tokens")
    remainders = held.select((F.col("n_tokens") % capacity).alias("r")).where("r > 0").groupBy("r").count()
    rows, windows = make_plan({r: n for r, n in remainders.collect()}, capacity)  # fewer rows than the capacity
    table = np.array(rows, np.int64).reshape(-1, len(PLAN_FIELDS))
    plan = spark.sparkContext.broadcast([np.ascontiguousarray(x[np.lexsort((x[:, 2], x[:, 0]))]) for d in range(table[:, 1].max(initial=-1) + 1) if len(x := table[table[:, 1] == d])])
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            out = []
            n, rem, rank, row, before = (f.column(c).to_numpy() for c in ("n_tokens", "_rem", "_rank", "_row", "_full_before"))
            full = n // capacity
            which = np.repeat(np.arange(len(n)), full)
            k = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full)
            crcs, of = f.column("crcs").flatten().to_numpy(), f.column("crcs").offsets.to_numpy().astype(np.int64)
            of = of - of[:1]
            out.append((which, k * capacity, np.full(len(k), capacity), crcs[of[which] + k], windows + before[which] + k, np.zeros(len(k), np.int64)))
            for p in plan.value:
                keys, want = (p[:, 0] << 48) + p[:, 2], (rem << 48) + rank
                at = np.clip(np.searchsorted(keys, want, "right") - 1, 0, None)
                hit = np.flatnonzero((p[at, 0] == rem) & (rank >= p[at, 2]) & (rank < p[at, 2] + p[at, 3]))
                q = p[at[hit]]
                item = q[:, 9] + rank[hit] - q[:, 2]
                start = full[hit] * capacity + q[:, 4]
                whole = (q[:, 4] == 0) & (q[:, 5] == rem[hit])
                crc = np.full(len(hit), -1)
                crc[whole] = crcs[of[hit[whole] + 1] - 1]
                out.append((hit, start, q[:, 5], crc, q[:, 6] + item // q[:, 7], q[:, 8] + item % q[:, 7] * q[:, 5]))
            which, start, length, crc, seq, offset = (np.concatenate(x) for x in zip(*out, strict=True))
            made = [*map(pa.array, (row[which], start, length)), pa.array(crc, mask=crc < 0), *map(pa.array, (n[which], seq, offset)), f.column("doc_id").take(pa.array(which))]
            yield pa.RecordBatch.from_arrays(made, names=["_row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "doc_id"])

    pieces = _ranked(held, capacity).mapInArrow(cut, f"{PIECES}, doc_id {id_type}")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    own = [c for c in columns if c != "ids_crc32"]

    names = [*columns, "ids"] if with_ids else columns

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                f = batch.slice(at, 256)
                parts = [unpack_ids(d.as_buffer())[s : s + n].astype("<u4") for d, s, n in zip(f.column("_ids"), f.column("start").to_pylist(), f.column("length").to_pylist(), strict=True)]
                made = {c: f.column(c) for c in own} | {"ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in parts], pa.int64())}
                if with_ids:
                    made["ids"] = pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([made[c] for c in names], names=names)

    schema = f"doc_id {id_type}, {PIECES.replace('_row long, ', '')}" + ", ids array<int>" * with_ids
    ids = held.select("_row", F.col("ids").alias("_ids"))
    if with_ids:
        return pieces.join(ids, "_row").select(*own, "_ids").mapInArrow(sliced, schema)
    pieces = saved(pieces, "pack-pieces")
    late = pieces.where("ids_crc32 IS NULL").join(ids, "_row").select(*own, "_ids").mapInArrow(sliced, schema)
    return pieces.where("ids_crc32 IS NOT NULL").select(*columns).unionByName(late.select(*columns))


def default_tokenizer() -> str:
    """The vocabulary file that the machine offers; nothing of it is kept in this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_query(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    return pack(docs.select("doc_id", "text"), tokenizer_path or default_tokenizer())
