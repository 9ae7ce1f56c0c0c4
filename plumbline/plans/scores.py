"""Scored observations over the driver's events: the fact table on which the statistics are exercised.

An event is one response of an arm (event type) to an item (user); the events of an item are its repeats. The number k
in props decides outcome, citation grade and confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.session import table


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("arm"), F.col("user_id").alias("item_id"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    nth = F.row_number().over(W.partitionBy("arm", "item_id").orderBy("event_id")) - 1
    return events.withColumn("repeat", nth.cast("long")).selectExpr(
        "arm", "item_id", "repeat",
        "concat('d', item_id % 4) AS domain", "item_id DIV 4 AS family", "item_id DIV 2 AS pair_id",
        "IF(item_id % 2 = 0, 'a', 'b') AS pair_role",
        "element_at(array('high', 'medium', 'low'), cast(item_id % 3 + 1 AS int)) AS risk_tier",
        "IF(item_id % 10 = 9, 'category_error', 'factual') AS item_type",
        "item_id % 10 = 9 OR item_id % 7 = 0 AS abstention_acceptable",
        "CASE WHEN k < 40 THEN 'correct' WHEN k < 55 THEN 'adjacent_substitution' WHEN k < 80 THEN 'other_incorrect' WHEN k < 95 THEN 'abstained' ELSE 'unscorable' END AS outcome",
        "element_at(array('none', 'wrong', 'correct_section', 'correct_clause'), k % 4 + 1) AS citation_grade",
        "k % 23 = 0 AS paywalled",
        "IF(k % 17 = 0, NULL, (100 - k) / 100D) AS confidence",
        "k < 40 AS correct",
    )


#: The same relation in DuckDB SQL, to stand behind WITH.
SCORES_SQL = """
ev AS (SELECT event_type AS arm, user_id AS item_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS nth,
  regexp_extract(props, '"k": *([0-9]+)', 1)::INT AS k FROM events),
scores AS (SELECT arm, item_id, nth - 1 AS repeat, 'd' || (item_id % 4) AS domain, item_id // 4 AS family, item_id // 2 AS pair_id,
  CASE WHEN item_id % 2 = 0 THEN 'a' ELSE 'b' END AS pair_role, (['high', 'medium', 'low'])[item_id % 3 + 1] AS risk_tier,
  CASE WHEN item_id % 10 = 9 THEN 'category_error' ELSE 'factual' END AS item_type,
  item_id % 10 = 9 OR item_id % 7 = 0 AS abstention_acceptable,
  CASE WHEN k < 40 THEN 'correct' WHEN k < 55 THEN 'adjacent_substitution' WHEN k < 80 THEN 'other_incorrect' WHEN k < 95 THEN 'abstained' ELSE 'unscorable' END AS outcome,
  (['none', 'wrong', 'correct_section', 'correct_clause'])[k % 4 + 1] AS citation_grade, k % 23 = 0 AS paywalled,
  CASE WHEN k % 17 = 0 THEN NULL ELSE (100 - k) / 100.0::DOUBLE END AS confidence, k < 40 AS correct
  FROM ev)"""
