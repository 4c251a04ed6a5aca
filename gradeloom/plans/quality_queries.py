"""Queries: rule tables, reconciliation, duplicates, privacy scans, agreement of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import agreement, quality
from gradeloom.plans import roles
from gradeloom.plans.registry import query, r3, with_parts
from gradeloom.plans.roles import ITEMS

def _rules() -> list[quality.Rule]:
    return [
        quality.Rule("mc-one-credit", F.col("credits") != 1, applies=F.col("type") == "mc"),
        quality.Rule("cr-has-average", F.col("avg_points").isNull(), "warn", applies=F.col("type") == "cr"),
        quality.Rule("p-in-range", ~F.col("p_value").between(0.01, 0.95)),
        quality.Rule("year-known", ~F.col("year").between(1995, 2001)),
        quality.Rule("essay", F.col("key").isNull(), applies=F.col("type") == "essay"),
    ]


VIOLATIONS = """violations AS (
  SELECT item, 'mc-one-credit' AS rule, 'fail' AS level FROM items WHERE type = 'mc' AND credits <> 1 UNION ALL
  SELECT item, 'cr-has-average', 'warn' FROM items WHERE type = 'cr' AND avg_points IS NULL UNION ALL
  SELECT item, 'p-in-range', 'fail' FROM items WHERE NOT p_value BETWEEN 0.01 AND 0.95)"""


@query(with_parts(ITEMS, VIOLATIONS) + "SELECT * FROM violations")
def quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality.violations(roles.items(spark, d), _rules(), "item")


@query(
    with_parts(ITEMS, VIOLATIONS, "rules AS (SELECT * FROM (VALUES ('mc-one-credit', 'fail', (SELECT count(*) FROM items WHERE type = 'mc')), ('cr-has-average', 'warn', (SELECT count(*) FROM items WHERE type = 'cr')), ('p-in-range', 'fail', (SELECT count(*) FROM items)), ('year-known', 'fail', (SELECT count(*) FROM items)), ('essay', 'fail', 0)) t(rule, level, checked))")
    + "SELECT rule, checked, coalesce(n, 0) AS broken, CASE WHEN checked = 0 THEN 'skip' WHEN coalesce(n, 0) = 0 THEN 'ok' ELSE level END AS status FROM rules LEFT JOIN (SELECT rule, count(*) AS n FROM violations GROUP BY rule) USING (rule)"
)
def quality_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return quality.outcomes(roles.items(spark, d), _rules())


@query("SELECT md5(text) AS digest, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    return quality.repeated(roles.table(spark, d, "documents"), "text").select(F.md5("text").alias("digest"), "n")


@query("SELECT p_brand AS k, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS names FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def contradictory_names(spark: SparkSession, d: str) -> DataFrame:
    p = roles.table(spark, d, "part").select(F.col("p_brand").alias("k"), "p_type")
    return quality.contradictory(p, "k", "p_type").select("k", F.array_join("values", "|").alias("names"))


@query(
    """WITH c AS (SELECT l_partkey AS k, l_returnflag AS letter, count(*) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY k) AS BIGINT) AS total FROM c)
SELECT k, letter, n, total FROM t WHERE n > total * 0.6"""
)
def lopsided_keys(spark: SparkSession, d: str) -> DataFrame:
    l_ = roles.table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_returnflag").alias("letter"))
    return quality.lopsided(l_, "letter", "k")


@query(
    with_parts(ITEMS, "got AS (SELECT year, count(*) AS items, CAST(sum(credits) AS BIGINT) AS credits FROM items GROUP BY year)", "plan AS (SELECT year, items + CASE WHEN year % 2 = 0 THEN 1 ELSE 0 END AS items, credits AS credits FROM got UNION ALL SELECT 2050, 3, 4)")
    + """SELECT * FROM (SELECT year, unnest(['items', 'credits']) AS field, unnest([coalesce(g.items, 0), coalesce(g.credits, 0)]) AS got, unnest([coalesce(p.items, 0), coalesce(p.credits, 0)]) AS expected FROM got g FULL JOIN plan p USING (year)) WHERE got <> expected"""
)
def count_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    got = roles.items(spark, d).groupBy("year").agg(F.count("*").alias("items"), F.sum("credits").alias("credits"))
    plan = got.withColumn("items", F.col("items") + F.when(F.col("year") % 2 == 0, 1).otherwise(0)).unionByName(spark.createDataFrame([(2050, 3, 4)], "year int, items long, credits long"))
    return quality.reconciled(got, plan, "year", "items", "credits")


@query("SELECT l_partkey AS part, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 5) GROUP BY 1")
def unresolved_references(spark: SparkSession, d: str) -> DataFrame:
    refs = roles.table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"))
    return quality.unresolved(refs, roles.table(spark, d, "part").where("p_size > 5"), "part", "p_partkey")


def _scan_sql(path: str, tests: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{path}' AS \"column\", '{kind}' AS kind, count(*) FILTER (WHERE {test}) AS n FROM v" for kind, test in (t.split(": ", 1) for t in tests))


_ID, _NAME = r"regexp_matches({0}, '\b\d{{9}}\b')", r"regexp_matches({0}, '\b[A-Z]{{2,}}, ?[A-Z]{{2,}}\b')"
_KINDS = lambda c: (f"identifier: {_ID.format(c)}", f"surname-forename: {_NAME.format(c)}", f"too-long: length({c}) > 300")


@query("WITH v AS (SELECT * FROM documents) SELECT * FROM (" + " UNION ALL ".join(_scan_sql(c, _KINDS(c)) for c in ("text", "lang", "source")) + ") WHERE n > 0")
def privacy_scan(spark: SparkSession, d: str) -> DataFrame:
    return quality.identity_findings(roles.table(spark, d, "documents"), cap=quality.LONGEST_TEXT)


@query(
    r"""WITH v AS (SELECT *, upper(left(n_name, 1 + CAST(n_nationkey % 3 AS INTEGER))) || CASE WHEN n_nationkey % 2 = 0 THEN ', ' ELSE ' ' END || 'AN' AS who, lpad(CAST(n_nationkey * 7919 AS VARCHAR), 8 + CAST(n_nationkey % 2 AS INTEGER), '1') AS code FROM nation)
SELECT * FROM ("""
    + " UNION ALL ".join([_scan_sql("a.list[].who", _KINDS("who")[:2]), _scan_sql("a.list[].code", _KINDS("code")[:2]), _scan_sql("m{key}", _KINDS("code")[:2]), _scan_sql("m{}", _KINDS("who")[:2]), _scan_sql("sections[]", (*_KINDS("code")[:2], "section-code: length(code) > 8"))])
    + ") WHERE n > 0"
)
def nested_privacy_scan(spark: SparkSession, d: str) -> DataFrame:
    """Names and numbers inside structs, arrays and maps."""
    k = F.col("n_nationkey")
    who = F.concat(F.upper(F.left("n_name", (k % 3 + 1).cast("int"))), F.when(k % 2 == 0, ", ").otherwise(" "), F.lit("AN"))
    code = F.lpad((k * 7919).cast("string"), (k % 2 + 8).cast("int"), F.lit("1"))
    n = roles.table(spark, d, "nation").select(
        F.struct(F.array(F.struct(who.alias("who"), code.alias("code"))).alias("list"), F.lit(1).alias("n")).alias("a"), F.create_map(code, who).alias("m"), F.array(code).alias("sections"), who.alias("lesson_title")
    )
    return quality.identity_findings(n, exempt=quality.PROSE)


@query(f"SELECT quality, toxic, count(*) AS n, {r3('count(*) / sum(count(*)) OVER ()')} AS rate FROM labels GROUP BY quality, toxic")
def agreement_tally(spark: SparkSession, d: str) -> DataFrame:
    return agreement.tally(roles.table(spark, d, "labels"), "quality", "toxic")


READINGS = "a AS (SELECT doc_id, quality AS v FROM labels), b AS (SELECT doc_id, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS v FROM documents WHERE doc_id % 3 <> 0)"


@query(
    with_parts(READINGS)
    + f"""SELECT outcome, count(*) AS n, {r3('count(*) / sum(count(*)) OVER ()')} AS rate FROM (
  SELECT CASE WHEN a.doc_id IS NULL THEN 'only-b' WHEN b.doc_id IS NULL THEN 'only-a' WHEN a.v = b.v THEN 'same' ELSE 'different' END AS outcome FROM a FULL JOIN b ON a.doc_id = b.doc_id) GROUP BY outcome"""
)
def two_readings(spark: SparkSession, d: str) -> DataFrame:
    a = roles.table(spark, d, "labels").select("doc_id", F.col("quality").alias("v"))
    b = roles.table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") > 300, 1).otherwise(0).alias("v"))
    return agreement.agreement(a, b, "doc_id", "v")


@query("SELECT l_orderkey AS k, count(*) AS readings, count(DISTINCT (l_returnflag, l_linestatus)) = 1 AS same FROM lineitem GROUP BY 1")
def identical_readings(spark: SparkSession, d: str) -> DataFrame:
    return agreement.identical_readings(roles.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k"), "k", "l_returnflag", "l_linestatus")
