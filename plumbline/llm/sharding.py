"""Sharding by extendible hashing.

A bucket is a prefix of a key's hash bits. Buckets start as one; only those above the byte limit split on another
bit. Twelve bits are handled a round: sums of bytes for each 12-bit cell of an open bucket give the sums at all
depths between, the least depth that fits is the shard's, and a directory maps each cell to its shard. Cells that do
not fit at the twelfth bit stay open for the next round, so only oversized parts are read again. Everything is a
DataFrame, the directory too: its size follows the number of shards, not the driver's memory.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.scratch import saved

BITS = 12
#: Rounds on the key's 60 hash bits, then as many on 60 bits that differ between rows of one key.
ROUNDS = 10
LIMIT_BYTES = 1 << 20


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(key, n_bytes, shard, depth, shard_bytes, shard_docs): every row with the shard it goes to.

    shard is the bit prefix ('' while all fits in one), n_bytes the UTF-8 size of the text (null: 0). A shard is above
    the limit only if it is one document that is. Rows of one key (repeated rows, null keys) share the key's 60 bits;
    if they are too many for one shard, bits drawn for each row when it was written tell them apart. An empty table
    gives none.
    """
    bits = lambda x: F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")
    own = bits(F.coalesce(F.col(key).cast("string"), F.lit("null")))
    extra = bits(F.concat(F.lit("row"), F.monotonically_increasing_id().cast("string")))
    narrow = docs.select(F.col(key).alias("_key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), own.alias("_h"), extra.alias("_x"))
    held = saved(narrow, "shard-keys").withColumn("_open", F.lit(""))
    done: list[DataFrame] = []
    for k in range(ROUNDS):
        word, at = ("_h", k) if k < ROUNDS // 2 else ("_x", k - ROUNDS // 2)
        cell = F.shiftright(F.col(word), 60 - BITS * (at + 1)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
        rows = held.withColumn("_cell", cell)
        cells = rows.groupBy("_open", "_cell").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        depths = cells.select("_open", "b", "n", F.explode(F.expr(f"transform(sequence(0, {BITS}), d -> named_struct('d', d, 'p', shiftright(_cell, {BITS} - d)))")).alias("at"))
        sums = depths.groupBy("_open", F.col("at.d").alias("d"), F.col("at.p").alias("p")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fits = sums.where((F.col("b") <= limit_bytes) | (F.col("n") == 1))
        parents = fits.select(F.col("_open").alias("_o"), (F.col("d") + 1).alias("_d"), F.col("p").alias("_p"))
        leaves = fits.join(parents, F.expr("_open = _o AND d = _d AND shiftright(p, 1) = _p"), "left_anti")
        suffix = F.when(F.col("d") == 0, F.lit("")).otherwise(F.expr("lpad(bin(p), d, '0')"))
        directory = leaves.select(
            F.col("_open").alias("_o"), F.explode(F.expr(f"sequence(shiftleft(p, {BITS} - d), shiftleft(p + 1, {BITS} - d) - 1)")).alias("_c"),
            F.concat("_open", suffix).alias("shard"), F.col("b").alias("shard_bytes"), F.col("n").alias("shard_docs"),
        )
        placed = saved(rows.join(directory, F.expr("_open = _o AND _cell = _c"), "left").drop("_o", "_c"), "shard-round")
        done.append(placed.where("shard IS NOT NULL"))
        if placed.where("shard IS NULL").isEmpty():
            break
        held = placed.where("shard IS NULL").select("_key", "n_bytes", "_h", "_x", F.concat("_open", F.lpad(F.bin(F.col("_cell").cast("long")), BITS, "0")).alias("_open"))
    else:
        raise ValueError(f"rows that {ROUNDS * BITS} bits do not tell apart exceed {limit_bytes} bytes")
    out = reduce(DataFrame.unionByName, done)
    return out.select(F.col("_key").alias(key), "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs")


def op6_query(docs: DataFrame) -> DataFrame:
    return shard(docs.select("doc_id", "text"))


OP6_SQL = f"""
WITH n AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
b AS (SELECT *, CASE WHEN d = 0 THEN '' ELSE right(lpad(bin(h), 60, '0'), 60)[1:d] END AS p FROM n, range(0, 61) AS r(d)),
s AS (SELECT d, p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM b GROUP BY d, p HAVING sum(n_bytes) <= {LIMIT_BYTES} OR count(*) = 1)
SELECT doc_id, n_bytes, p AS shard, d::INTEGER AS depth, shard_bytes, shard_docs FROM b JOIN s USING (d, p)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d) = 1
"""
