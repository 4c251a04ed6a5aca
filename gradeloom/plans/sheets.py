"""Response sheets made from the driver's customers, one workbook per nation, and the published
tables that they are read against; each with its SQL.

Sheets are meant to be uneven: nations 7, 15 and 23 have shifted headers, 11 too few of them, 20
no column of levels, 21 section codes of single students, and in 6, 14 and 22 the level isn't a
function of the raw score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators.report import Data
from gradeloom.plans import roles

TESTS, QUESTIONS = 7, 14
HEAD = 3

#: Items of seven tests of fourteen questions.
SHEET_ITEMS = """sitems AS (
  SELECT 't' || t AS test, q AS item, 't' || t || '-' || lpad(CAST(q AS VARCHAR), 3, '0') AS id, CAST(6 + t % 3 AS INTEGER) AS grade, CAST(2020 + t AS INTEGER) AS year,
         'NY-' || (6 + t % 3) || '.' || ['RP', 'NS', 'EE', 'G', 'SP'][(q + 2 * t) % 5 + 1] || '.' || (1 + (q * (t + 1)) % 6) AS standard,
         ['RP', 'NS', 'EE', 'G', 'SP'][(q + 2 * t) % 5 + 1] AS domain, CASE WHEN q > 10 THEN 'cr' ELSE 'mc' END AS type,
         CASE WHEN q <= 10 THEN chr(CAST(65 + (q * 3 + t) % 4 AS INTEGER)) END AS key, CASE WHEN q > 10 THEN 2 ELSE 1 END AS credits,
         ((q * 7 + t * 5) % 90 + 5) / 100.0::DOUBLE AS p_value, CASE WHEN q > 10 AND q % 2 = 0 THEN ((q + t) % 20) / 10.0::DOUBLE END AS avg_points,
         q % 13 = 0 AS post_test, CASE WHEN q % 7 = 3 THEN 'Grade 5' WHEN q % 7 <> 5 THEN 'Grade ' || (6 + t % 3) || ' Math' END AS course,
         CASE WHEN q % 7 = 3 THEN 5 WHEN q % 7 <> 5 THEN 6 + t % 3 END AS placed, CASE WHEN q % 7 <> 5 THEN CAST((q + t) % 9 + 1 AS INTEGER) END AS unit, CASE WHEN q % 7 <> 5 AND q % 4 <> 2 THEN CAST(q % 5 + 1 AS INTEGER) END AS lesson,
         q % 4 <> 1 AS transcribed, CASE WHEN q > 10 AND q % 3 <> 0 THEN 'x' END AS answer
  FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS t), (SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS q))"""

#: What the sheets hold: nation n, student s, question q, value; level and section by student.
SHEET_BASE = """sbase AS (
  SELECT c_nationkey AS n, c_custkey AS s, q, 't' || c_nationkey % 7 AS test,
         CASE WHEN q <= 10 THEN CASE WHEN h < 2 + able THEN chr(CAST(65 + (q * 3 + t) % 4 AS INTEGER)) WHEN h < 9 THEN chr(CAST(65 + ((q * 3 + t) % 4 + 1 + h % 3) % 4 AS INTEGER)) END
              ELSE CASE WHEN (s0 + q) % 29 = 0 THEN 'x' WHEN able >= 6 THEN '2' WHEN able <= 1 THEN '0' WHEN g = 0 THEN '0' WHEN g = 1 THEN '1 pts' WHEN g = 2 THEN '2' END END AS value,
         CASE WHEN q <= 10 THEN CASE WHEN h < 2 + able THEN 1 ELSE 0 END ELSE CASE WHEN (s0 + q) % 29 = 0 THEN 0 WHEN able >= 6 THEN 2 WHEN able <= 1 OR g = 3 THEN 0 ELSE g END END AS points
  FROM (SELECT *, c_custkey AS s0, c_nationkey % 7 AS t, c_custkey % 8 AS able, (c_custkey * 31 + q * 17 + (c_custkey * q) % 13) % 10 AS h, (c_custkey + q * 5) % 4 AS g
        FROM customer, (SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS q))),
present AS (SELECT n, s, q, test, value, points FROM sbase WHERE value IS NOT NULL AND n <> 11),
sstudents AS (
  SELECT n, s, CASE WHEN n <> 21 AND (SELECT count(*) FROM (SELECT s2.s % 4, count(*) AS c FROM (SELECT DISTINCT n, s FROM present) s2 WHERE s2.n = x.n GROUP BY 1) WHERE c > 1) * 2 >= (SELECT count(DISTINCT s2.s % 4) FROM (SELECT DISTINCT n, s FROM present) s2 WHERE s2.n = x.n)
              AND (SELECT count(DISTINCT s2.s % 4) FROM (SELECT DISTINCT n, s FROM present) s2 WHERE s2.n = x.n) * 2 <= (SELECT count(*) FROM (SELECT DISTINCT n, s FROM present) s2 WHERE s2.n = x.n) THEN 'S' || s % 4 END AS section,
         CASE WHEN n <> 20 THEN 1 + raw * 0.19 + CASE WHEN n % 8 = 6 THEN s % 2 * 0.1 ELSE 0 END END AS level, raw
  FROM (SELECT n, s, CAST(sum(points) AS INTEGER) AS raw FROM present GROUP BY n, s) x)"""


def items(spark: SparkSession) -> DataFrame:
    t, q = F.col("t"), F.col("q")
    domain = F.element_at(F.array(*[F.lit(x) for x in ("RP", "NS", "EE", "G", "SP")]), ((q + 2 * t) % 5 + 1).cast("int"))
    grade = 6 + t % 3
    rows = spark.range(TESTS).select(F.col("id").alias("t"), F.explode(F.sequence(F.lit(1), F.lit(QUESTIONS))).alias("q"))
    placed = q % 7 != 5
    return rows.select(
        F.concat(F.lit("t"), t).alias("test"), q.alias("item"), F.format_string("t%d-%03d", t, q).alias("id"), grade.cast("int").alias("grade"), (2020 + t).cast("int").alias("year"),
        F.concat(F.lit("NY-"), grade, F.lit("."), domain, F.lit("."), 1 + (q * (t + 1)) % 6).alias("standard"), domain.alias("domain"), F.when(q > 10, "cr").otherwise("mc").alias("type"),
        F.when(q <= 10, F.char(65 + (q * 3 + t) % 4)).alias("key"), F.when(q > 10, 2).otherwise(1).alias("credits"), (((q * 7 + t * 5) % 90 + 5) / 100.0).alias("p_value"),
        F.when((q > 10) & (q % 2 == 0), ((q + t) % 20) / 10.0).alias("avg_points"), (q % 13 == 0).alias("post_test"),
        F.when(q % 7 == 3, "Grade 5").when(placed, F.concat(F.lit("Grade "), grade, F.lit(" Math"))).alias("course"), F.when(placed, ((q + t) % 9 + 1).cast("int")).alias("unit"),
        F.when(placed & (q % 4 != 2), (q % 5 + 1).cast("int")).alias("lesson"), F.lit(None).cast("string").alias("lesson_title"), (q % 4 != 1).alias("transcribed"), F.when((q > 10) & (q % 3 != 0), "x").alias("answer"),
    )


#: Curriculum: nine units a grade, five lessons a unit, and the table of what is taught where.
CURRICULUM = """sunits AS (
  SELECT grade, unit, 'Unit ' || unit AS title, CAST(unit * 4 - 3 AS INTEGER) AS start_week, unit % 2 = 0 AS mid_unit_assessment
  FROM (SELECT CAST(unnest([6, 7, 8]) AS INTEGER) AS grade), (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS unit)),
slessons AS (SELECT grade, unit, lesson, 'Lesson ' || unit || '.' || lesson AS title FROM sunits, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS lesson)),
staught AS (SELECT DISTINCT grade, standard, CAST(item % 4 + 1 AS INTEGER) AS unit FROM sitems WHERE item % 3 = 0)"""


def data(spark: SparkSession) -> Data:
    it = items(spark)
    unit = spark.range(1, 10).select(F.explode(F.array(*[F.lit(g) for g in (6, 7, 8)])).alias("grade"), F.col("id").cast("int").alias("unit"))
    units = unit.select("grade", "unit", F.concat(F.lit("Unit "), "unit").alias("title"), (F.col("unit") * 4 - 3).alias("start_week"), (F.col("unit") % 2 == 0).alias("mid_unit_assessment"))
    lessons = unit.withColumn("lesson", F.explode(F.sequence(F.lit(1), F.lit(3)))).select("grade", "unit", "lesson", F.concat(F.lit("Lesson "), "unit", F.lit("."), "lesson").alias("title"))
    taught = it.where("item % 3 = 0").select("grade", "standard", (F.col("item") % 4 + 1).alias("unit")).distinct()
    return Data(it, units, lessons, taught)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the sheets: titles, a header row, then a row per customer."""
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    t = n % TESTS
    c = roles.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("n"), F.col("c_custkey").alias("s"))
    long = c.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(QUESTIONS))))
    h, g = (s * 31 + q * 17 + (s * q) % 13) % 10, (s + q * 5) % 4
    odd = (s + q) % 29 == 0
    key = (q * 3 + t) % 4
    able = s % 8  # from one right answer in five to nine in ten
    mc = F.when(h < able + 2, F.char(65 + key)).when(h < 9, F.char(65 + (key + 1 + h % 3) % 4))
    cr = F.when(odd, "x").when(able >= 6, "2").when(able <= 1, "0").when(g == 0, "0").when(g == 1, "1 pts").when(g == 2, "2")
    points = F.when(q <= 10, F.when(h < able + 2, 1).otherwise(0)).otherwise(F.when(odd, 0).when(able >= 6, 2).when((able <= 1) | (g == 3), 0).otherwise(g))
    answers = long.select("n", "s", "q", F.when(q <= 10, mc).otherwise(cr).alias("value"), points.alias("points"))
    raw = answers.groupBy("n", "s").agg(F.sum("points").alias("raw"))
    level = F.round(1 + F.col("raw") * 0.19 + F.when(n % 8 == 6, s % 2 * 0.1).otherwise(0), 2)
    section = F.concat(F.lit("S"), F.when(n == 21, s).otherwise(s % 4))
    cell = lambda df, r, col, value: df.select("n", r.cast("int").alias("r"), F.lit(col).cast("int").alias("c") if isinstance(col, int) else col.cast("int").alias("c"), value.cast("string").alias("value"))
    below = s + HEAD + 1
    nations = c.select("n").distinct()
    heads = nations.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(QUESTIONS)))).where((n != 11) | (q <= 8)).withColumn("test", F.concat(F.lit("t"), t))
    asked = heads.withColumn("_i", F.when(n % 8 == 7, q % QUESTIONS + 1).otherwise(q))
    codes = items(spark).select("test", F.col("item").alias("_i"), F.substring("standard", 4, 20).alias("code"))
    parts = [
        cell(nations, F.lit(0), 0, F.lit("A title")),
        cell(nations, F.lit(HEAD), 0, F.lit("Student Name")),
        cell(nations, F.lit(HEAD), 1, F.lit("Class")),
        cell(nations, F.lit(HEAD), 2, F.when(n == 20, "Math Lv").otherwise("NYS Math")),
        cell(asked.join(F.broadcast(codes), ["test", "_i"]), F.lit(HEAD), q + 2, F.concat(F.lit("Q"), q, F.lit(" ("), "code", F.lit(")"))),
        cell(c, below, 0, F.lit("name")),
        cell(c, below, 1, section),
        cell(raw, below, 2, level),
        cell(answers.where((n != 11) | (q <= 8)), below, q + 2, F.col("value")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.select(F.format_string("n%02d.xlsx", n).alias("path"), F.lit(0).alias("sheet"), "r", "c", "value")
