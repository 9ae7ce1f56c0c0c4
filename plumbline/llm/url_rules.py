"""URL filters: host-suffix and path-prefix expressions joined to rules by short hash prefix, then full digest.

A URL expands into one expression for each host suffix (by labels) and each path prefix whose length some rule uses.
Expressions and rules meet on the first bytes of a SHA-256 digest; equal full digests confirm a hit; the longest rule
decides. Distinct (host, path) pairs are expanded, not pages, so a URL that many pages share is expanded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.scratch import saved
from plumbline.llm.skew import join_counted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (rule, verdict) of the registered query; a rule is a host followed by a path prefix.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

#: Hex digits of the short join key.
SHORT_HEX = 8
#: Rule tables up to this many rows are broadcast (about 20 MB); larger ones are shuffled.
BROADCAST_RULES = 100_000
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule string, verdict string")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Every row of ``pages`` (its other columns but host, path, rule, verdict kept) with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path, character by character; the
    longest rule wins, of equal strings the one that allows. Without a fitting rule: rule null, verdict ``default``.
    Null or malformed URLs have empty host and path, which no rule fits; they are set apart, and URLs that many pages
    share meet their verdict by broadcast. Repeated rows are judged alike; empty tables on either side give no rows or
    no hits.
    """
    digest = F.sha2(F.col("rule"), 256)
    best_of = rules.groupBy("rule").agg(F.min("verdict").alias("verdict"))  # 'allow' sorts before 'block'
    keyed = best_of.select("rule", "verdict", digest.alias("_rule_digest"), F.substring(digest, 1, SHORT_HEX).alias("_rule_short"))
    rule_host, rule_path = F.regexp_extract("rule", "^([^/]*)", 1), F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    shape = rules.agg(F.max(F.size(F.split(rule_host, r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length(rule_path))).alias("lengths"), F.count_distinct("rule").alias("n")).first()
    labels, lengths = shape["labels"] or 1, shape["lengths"] or [0]
    if shape["n"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    placed = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    with_host = (F.col("host") != "") | (F.col("path") != "")
    urls_of = placed.where(with_host).select("host", "path")
    urls = urls_of.distinct()
    pairs = urls.select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))).alias("_expression"))
    full = F.sha2("_expression", 256)
    hits = pairs.select("host", "path", full.alias("_digest"), F.substring(full, 1, SHORT_HEX).alias("_short"))
    hits = hits.join(keyed, F.col("_short") == F.col("_rule_short")).where("_digest = _rule_digest")
    won = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("_won"))
    counted = urls_of.groupBy("host", "path").agg(F.count("*").alias("_n")).join(won, ["host", "path"], "left")
    found = saved(counted.select(F.struct("host", "path").alias("_url"), "_n", "_won"), "url-verdicts")
    out = join_counted(placed.where(with_host).withColumn("_url", F.struct("host", "path")), found, "_url").drop("_url")
    out = out.unionByName(placed.where(~with_host).withColumn("_won", F.lit(None).cast(won.schema["_won"].dataType)))
    return out.withColumns({"rule": F.col("_won.rule"), "verdict": F.coalesce("_won.verdict", F.lit(default))}).drop("_won")


def op4_query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    return judge(pages.select("page_id", "url"), rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS r FROM pages),
r(rh, rp, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT p.r, rh || rp AS rule, verdict FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
    QUALIFY row_number() OVER (PARTITION BY p.r ORDER BY length(rh || rp) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.r = m.r
"""
