"""The driver's tables in the roles of an assessment: items, responses, students, codes.

Every function has its SQL beside it, as a common table expression for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    cr = size % 4 == 0
    return p.select(
        key.alias("item"),
        F.col("p_brand").alias("standard"),
        F.col("p_type").alias("domain"),
        (size % 3 + 1).cast("int").alias("credits"),
        F.when(cr, "cr").otherwise("mc").alias("type"),
        F.when(key % 3 == 0, "A").when(key % 3 == 1, "N").otherwise("R").alias("key"),
        ((size * 2 - 1).cast("double") / 100).alias("p_value"),
        F.when(cr & (key % 5 != 4), (key % 5).cast("double") / 4).alias("avg_points"),
        (key % 7 + 1995).cast("int").alias("year"),
        (size % 3 + 6).cast("int").alias("grade"),
        (size % 9 + 1).cast("int").alias("unit"),
        (key % 20 + 1).cast("int").alias("lesson"),
    )


ITEMS = """items AS (
  SELECT p_partkey AS item, p_brand AS standard, p_type AS domain, CAST(p_size % 3 + 1 AS INTEGER) AS credits,
         CASE WHEN p_size % 4 = 0 THEN 'cr' ELSE 'mc' END AS type,
         CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS key,
         CAST(p_size * 2 - 1 AS DOUBLE) / 100 AS p_value,
         CASE WHEN p_size % 4 = 0 AND p_partkey % 5 <> 4 THEN CAST(p_partkey % 5 AS DOUBLE) / 4 END AS avg_points,
         CAST(p_partkey % 7 + 1995 AS INTEGER) AS year, CAST(p_size % 3 + 6 AS INTEGER) AS grade,
         CAST(p_size % 9 + 1 AS INTEGER) AS unit, CAST(p_partkey % 20 + 1 AS INTEGER) AS lesson
  FROM part)"""


def responses(spark: SparkSession, sf_dir: str, customers: bool = False) -> DataFrame:
    """student, item, value (null: omitted); with ``customers`` also section and level.

    Some constructed responses carry a unit behind the number.
    """
    it = items(spark, sf_dir).select(F.col("item").alias("l_partkey"), "type", "credits")
    r = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(it, "l_partkey")
    points = F.concat((F.col("l_quantity").cast("int") % (F.col("credits") + 1)).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " pts").otherwise(""))
    value = F.when(F.col("l_linenumber") % 7 == 0, None).when(F.col("type") == "cr", points).otherwise(F.col("l_returnflag"))
    out = r.select(F.col("o_custkey").alias("student"), F.col("l_partkey").alias("item"), value.alias("value"))
    if customers:
        out = out.join(students(spark, sf_dir), "student")
    return out


RESPONSES = """raw_responses AS (
  SELECT o_custkey AS student, l_partkey AS item,
         CASE WHEN l_linenumber % 7 = 0 THEN NULL
              WHEN i.type = 'cr' THEN CAST(CAST(l_quantity AS INTEGER) % (i.credits + 1) AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN ' pts' ELSE '' END
              ELSE l_returnflag END AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN items i ON l_partkey = i.item),
scored AS (
  SELECT r.*, i.standard, i.domain, i.credits, i.type, i.key, i.p_value, i.avg_points, i.year,
         CASE WHEN i.type = 'mc' THEN CASE WHEN r.value = i.key THEN CAST(i.credits AS DOUBLE) ELSE 0.0 END
              ELSE coalesce(CAST(regexp_extract(r.value, '^[0-9]+') AS DOUBLE), 0.0) END AS points,
         r.value IS NOT NULL AS answered, i.type = 'mc' AND coalesce(r.value = i.key, false) AS correct
  FROM raw_responses r JOIN items i USING (item))"""


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("student"), F.col("c_mktsegment").alias("section"), ((F.col("c_acctbal") + 1000) / 2750 + 1).alias("level"))


STUDENTS = """students AS (
  SELECT c_custkey AS student, c_mktsegment AS section, (c_acctbal + 1000) / 2750 + 1 AS level FROM customer)"""


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(student, raw, level): a level that rises with the raw score, with unobserved scores."""
    p = table(spark, sf_dir, "part").where(F.col("p_size") % 4 != 3)
    return p.select(F.col("p_partkey").alias("student"), F.col("p_size").cast("long").alias("raw"), ((F.col("p_size") * 7 + 93).cast("double") / 100).alias("level"))


CURVE = """curve AS (
  SELECT CAST(p_size AS BIGINT) AS raw, CAST(p_size * 7 + 93 AS DOUBLE) / 100 AS level FROM part WHERE p_size % 4 <> 3 GROUP BY p_size)"""

STATS = """stats AS (
  SELECT item, any_value(standard) AS standard, any_value(domain) AS domain, any_value(credits) AS credits, any_value(type) AS type,
         any_value(year) AS year, count(*) AS n, count(*) FILTER (WHERE answered) AS answered, sum(points) AS earned,
         count(*) FILTER (WHERE correct) AS correct,
         count(*) FILTER (WHERE type = 'cr' AND answered AND points >= credits) AS full_credit,
         count(*) FILTER (WHERE type = 'cr' AND answered AND points = 0) AS zero_credit,
         sum(points) / (any_value(credits) * count(*)) AS rate,
         CASE WHEN any_value(type) = 'mc' THEN any_value(p_value) ELSE coalesce(any_value(avg_points) / any_value(credits), any_value(p_value)) END AS state
  FROM scored GROUP BY item),
item_stats AS (
  SELECT *, floor(rate * 1000 + 0.5) / 1000 AS class_p, floor(state * 1000 + 0.5) / 1000 AS state_p, floor((rate - state) * 1000 + 0.5) / 1000 AS gap FROM stats)"""
