"""Queries: facets, search, orders, registry rollups, shares, hierarchy, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import scalars
from gradeloom.operators import agreement, explore, hierarchy
from gradeloom.plans import roles
from gradeloom.plans.registry import query, r3, with_parts
from gradeloom.plans.roles import ITEMS
from gradeloom.sources import sinks

I = with_parts(ITEMS)  # noqa: E741


ROLLUP_SQL = f"""registry AS (SELECT DISTINCT standard FROM items UNION ALL SELECT 'Brand#none'),
standard_rollup AS (
  SELECT standard, count(item) AS n_items, CAST(coalesce(sum(credits), 0) AS BIGINT) AS credits, count(*) FILTER (WHERE type = 'cr') AS n_cr, count(DISTINCT year) AS n_years,
         {r3('sum(CAST(round(p_value * 10000) AS BIGINT)) / (10000 * count(p_value))')} AS mean_p, min(p_value) AS min_p, max(p_value) AS max_p
  FROM registry LEFT JOIN (SELECT * FROM items WHERE grade = 6) USING (standard) GROUP BY standard)"""


@query(I + "SELECT item, standard, year, type FROM items WHERE year IN (1996, 1999) AND domain IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part) AND type = 'mc'")
def facet_filter(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    ends = it.select("domain").agg(F.min("domain").alias("a"), F.max("domain").alias("b")).select(F.explode(F.array("a", "b")).alias("domain")).distinct()
    return explore.faceted(it, year=[1996, 1999], type=["mc"], unit=None).join(F.broadcast(ends), "domain").select("item", "standard", "year", "type")  # two rows


@query(I + "SELECT item FROM items WHERE unit % 4 = 0 OR unit IN (3, 5)")
def unit_facet(spark: SparkSession, d: str) -> DataFrame:
    units = F.when(F.col("unit") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("unit").cast("string"), F.lit("x")))
    return explore.faceted(roles.items(spark, d).select("item", units.alias("units")), units=["3", "5", None]).select("item")


@query(with_parts(ITEMS) + "SELECT standard, n, row_number() OVER (ORDER BY n = 0, standard) AS place FROM (SELECT standard, count(item) AS n FROM (SELECT DISTINCT standard FROM items UNION ALL SELECT 'Brand#00') LEFT JOIN (SELECT standard, item FROM items WHERE grade = 6) USING (standard) GROUP BY standard)")
def standards_order(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    registry = it.select("standard").distinct().unionByName(spark.createDataFrame([("Brand#00",)], "standard string"))
    rolled = explore.standard_rollup(registry, it.where("grade = 6")).select("standard", F.col("n_items").alias("n"))
    return explore.placed(rolled, (F.col("n") == 0).asc(), F.col("standard").asc())


@query(with_parts(ITEMS, ROLLUP_SQL) + "SELECT standard, n_items, mean_p FROM standard_rollup WHERE n_items >= 3 AND mean_p < 0.5")
def headline_hard(spark: SparkSession, d: str) -> DataFrame:
    return explore.hard_standards(_standard_rollup(spark, d)).select("standard", "n_items", "mean_p")


@query("SELECT p_partkey AS item, p_name AS name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '3')")
def haystack_search(spark: SparkSession, d: str) -> DataFrame:
    p = roles.table(spark, d, "part")
    return explore.searched(p, " 3 ", "p_name", "p_brand", "p_type").select(F.col("p_partkey").alias("item"), F.col("p_name").alias("name"))


@query(I + "SELECT item, avg_points, year, row_number() OVER (ORDER BY avg_points DESC NULLS LAST, year, item) AS place FROM items")
def multi_key_sort(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d).select("item", "avg_points", "year")
    return explore.placed(it, F.col("avg_points").desc_nulls_last(), F.col("year").asc(), F.col("item").asc())


def _order_sql(first: str) -> str:
    return I + f"SELECT item, year, p_value, unit, standard, row_number() OVER (ORDER BY {first}, year, item) AS place FROM items"


def _in_order(spark: SparkSession, d: str, mode: str) -> DataFrame:
    return explore.placed(roles.items(spark, d).select("item", "year", "p_value", "unit", "standard"), *explore.question_keys(mode))


@query(_order_sql("p_value"))
def hardest_order(spark: SparkSession, d: str) -> DataFrame:
    return _in_order(spark, d, "hardest")


@query(_order_sql("unit"))
def curriculum_order(spark: SparkSession, d: str) -> DataFrame:
    return _in_order(spark, d, "curriculum")


@query(_order_sql("year DESC"))
def year_order(spark: SparkSession, d: str) -> DataFrame:
    return _in_order(spark, d, "year")


@query(_order_sql("standard"))
def standard_order(spark: SparkSession, d: str) -> DataFrame:
    return _in_order(spark, d, "standard")


def _standard_rollup(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    registry = it.select("standard").distinct().unionByName(spark.createDataFrame([("Brand#none",)], "standard string"))
    return explore.standard_rollup(registry, it.where("grade = 6")).drop("years")


@query(with_parts(ITEMS, ROLLUP_SQL) + "SELECT * FROM standard_rollup")
def standard_rollup_left(spark: SparkSession, d: str) -> DataFrame:
    return _standard_rollup(spark, d)


@query(with_parts(ITEMS, ROLLUP_SQL) + "SELECT standard, n_items, n_years, mean_p FROM standard_rollup WHERE n_years >= 3 AND mean_p < 0.5")
def persistent_hard(spark: SparkSession, d: str) -> DataFrame:
    return explore.hard_standards(_standard_rollup(spark, d), by="n_years").select("standard", "n_items", "n_years", "mean_p")


@query(I + "SELECT item, CASE WHEN p_value < 0.5 THEN 'hard' WHEN p_value < 0.75 THEN 'mid' ELSE 'easy' END AS band FROM items")
def difficulty_bands(spark: SparkSession, d: str) -> DataFrame:
    return roles.items(spark, d).select("item", scalars.difficulty(F.col("p_value")).alias("band"))


@query(
    with_parts(ITEMS, f"per AS (SELECT domain, CAST(sum(credits) AS BIGINT) AS credits, {r3('sum(credits) * 100 / sum(sum(credits)) OVER ()', 1)} AS share FROM items GROUP BY domain)", "ranges AS (SELECT domain, 10.0 + length(domain) % 5 AS lo, 17.0 AS hi FROM per WHERE length(domain) % 2 = 0)")
    + "SELECT domain, credits, share, coalesce(share BETWEEN lo - 0.5 AND hi + 0.5, true) AS inside FROM per LEFT JOIN ranges USING (domain)"
)
def domain_share(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    n = F.length("domain")
    ranges = it.select("domain").distinct().where(n % 2 == 0).select("domain", (n % 5 + 10.0).alias("lo"), F.lit(17.0).alias("hi"))
    return explore.domain_share(it, ranges, 0.5)


@query(
    I
    + f"""SELECT year, domain, CAST(credits AS BIGINT) AS credits, {r3('credits * 100 / sum(credits) OVER (PARTITION BY year)', 1)} AS share
FROM (SELECT year, domain, sum(credits) AS credits FROM items GROUP BY GROUPING SETS ((domain), (year, domain)))"""
)
def yearly_domain_share(spark: SparkSession, d: str) -> DataFrame:
    return explore.pooled_and_yearly_share(roles.items(spark, d))


@query(I + f"SELECT count(*) AS n_items, count(DISTINCT standard) AS n_standards, count(DISTINCT year) AS n_years, CAST(sum(credits) AS BIGINT) AS credits, count(*) FILTER (WHERE type = 'cr') AS n_cr, {r3('sum(CAST(round(p_value * 10000) AS BIGINT)) / (10000 * count(p_value))')} AS mean_p FROM items")
def headline_counters(spark: SparkSession, d: str) -> DataFrame:
    return explore.counters(roles.items(spark, d))


@query(I + "SELECT grade, count(*) AS n_items, count(DISTINCT standard) AS n_standards, CAST(sum(credits) AS BIGINT) AS credits FROM items GROUP BY grade")
def coverage_by_grade(spark: SparkSession, d: str) -> DataFrame:
    return explore.coverage(roles.items(spark, d), "grade")


@query(
    I
    + f"""SELECT unit, n, n_later, {r3('n_later / n')} AS share, CASE WHEN n_later = n THEN 'all' WHEN n_later = 0 THEN 'none' ELSE n_later || ' of ' || n END AS label
FROM (SELECT unit, count(*) AS n, count(*) FILTER (WHERE right(standard, 1) IN ('1', '2')) AS n_later FROM (SELECT DISTINCT unit, standard FROM items) GROUP BY unit)"""
)
def posttest_share(spark: SparkSession, d: str) -> DataFrame:
    u = roles.items(spark, d).select("unit", "standard").distinct().withColumn("post_test", F.substring("standard", -1, 1).isin("1", "2"))
    return explore.later_share(u)


@query(
    with_parts(ITEMS, "lessons AS (SELECT DISTINCT unit, lesson FROM items WHERE unit <> 3)")
    + """SELECT u.unit, coalesce(n_lessons, 0) AS n_lessons, coalesce(n_items, 0) AS n_items, CAST(coalesce(credits, 0) AS BIGINT) AS credits
FROM (SELECT CAST(unnest(range(1, 12)) AS INTEGER) AS unit) u LEFT JOIN (SELECT unit, count(*) AS n_lessons FROM lessons GROUP BY unit) USING (unit)
LEFT JOIN (SELECT unit, count(*) AS n_items, sum(credits) AS credits FROM items GROUP BY unit) USING (unit)"""
)
def year_at_a_glance(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    units = spark.range(1, 12).select(F.col("id").cast("int").alias("unit"))
    return explore.year_at_a_glance(units, it.where("unit <> 3").select("unit", "lesson").distinct(), it)


@query(I + "SELECT CASE WHEN unit % 4 = 0 THEN '(none)' ELSE CAST(unit AS VARCHAR) END AS unit, count(*) AS n FROM items GROUP BY 1")
def unit_options(spark: SparkSession, d: str) -> DataFrame:
    units = F.when(F.col("unit") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("unit").cast("string")))
    return explore.unit_options(roles.items(spark, d).select("item", units.alias("units")))


# --- hierarchy ---------------------------------------------------------------------

CODES = """codes AS (
  SELECT DISTINCT '7.' || left(n_name, 2) || '.' || n_nationkey % 7 || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE chr(96 + CAST(n_nationkey % 3 AS INTEGER)) END AS code FROM nation
  UNION SELECT DISTINCT '7.XX.' || c_nationkey % 5 || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' ELSE 'b' END FROM customer)"""


def _codes(spark: SparkSession, d: str) -> DataFrame:
    n = roles.table(spark, d, "nation")
    k = F.col("n_nationkey")
    a = n.select(F.concat(F.lit("7."), F.left("n_name", F.lit(2)), F.lit("."), (k % 7).cast("string"), F.when(k % 3 == 0, "").otherwise(F.char(k % 3 + 96))).alias("code"))
    c = F.col("c_custkey") % 3
    b = roles.table(spark, d, "customer").select(F.concat(F.lit("7.XX."), (F.col("c_nationkey") % 5).cast("string"), F.when(c == 0, "").when(c == 1, "a").otherwise("b")).alias("code"))
    return a.union(b).distinct()


@query(with_parts(CODES) + "SELECT a.code, b.code AS reach FROM codes a JOIN codes b ON b.code = a.code OR (length(b.code) = length(a.code) + 1 AND starts_with(b.code, a.code) AND regexp_matches(b.code, '[a-z]$'))")
def parent_child_expand(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.with_children(_codes(spark, d))


ASKED = "asked AS (SELECT DISTINCT regexp_replace(code, '[a-z]$', '') AS code FROM codes UNION SELECT code FROM codes)"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    c = _codes(spark, d)
    return c.select(F.regexp_replace("code", "[a-z]$", "").alias("code")).union(c).distinct()


@query(
    with_parts(CODES, ASKED)
    + """SELECT code, code AS reach FROM asked WHERE code IN (SELECT code FROM codes) UNION ALL
SELECT a.code, c.code FROM asked a JOIN codes c ON length(c.code) = length(a.code) + 1 AND starts_with(c.code, a.code) AND regexp_matches(c.code, '[a-z]$') WHERE a.code NOT IN (SELECT code FROM codes)"""
)
def children_if_unknown(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.children_if_unknown(_asked(spark, d), _codes(spark, d))


@query(
    with_parts(CODES, ASKED)
    + """SELECT a.code, c.code AS reach FROM asked a JOIN codes c ON a.code = c.code OR (starts_with(a.code, c.code) AND regexp_full_match(substr(a.code, length(c.code) + 1), '[A-Za-z]+'))
OR (starts_with(c.code, a.code) AND regexp_full_match(substr(c.code, length(a.code) + 1), '[A-Za-z]+'))"""
)
def parent_child_both_ways(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.both_directions(_asked(spark, d), _codes(spark, d))


@query(with_parts(CODES, ASKED) + "SELECT a.code, min(c.code) AS reach FROM asked a JOIN codes c ON starts_with(a.code, c.code) OR starts_with(c.code, a.code) GROUP BY a.code")
def loose_prefix_first(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.loose_prefix_first(_asked(spark, d), _codes(spark, d).withColumn("place", F.col("code")))


@query(with_parts(CODES, ASKED) + "SELECT a.code, c.code AS reach FROM asked a JOIN codes c ON starts_with(upper(replace(a.code, '.', '')), upper(replace(c.code, '.', ''))) OR starts_with(upper(replace(c.code, '.', '')), upper(replace(a.code, '.', '')))")
def base_code_prefix(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.base_prefix(_asked(spark, d), _codes(spark, d))


@query(
    with_parts(ITEMS, "cites AS (SELECT DISTINCT standard AS code, unit FROM items)", "edges AS (SELECT DISTINCT a.standard AS code, b.standard AS reach FROM items a JOIN items b ON left(a.standard, 7) = left(b.standard, 7))")
    + "SELECT e.code, string_agg(DISTINCT CAST(unit AS VARCHAR), ',' ORDER BY CAST(unit AS VARCHAR)) AS units FROM edges e JOIN cites c ON e.reach = c.code GROUP BY e.code"
)
def unit_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    c = it.select("standard").distinct()
    edges = c.select(F.col("standard").alias("code"), F.left("standard", F.lit(7)).alias("k")).join(c.select(F.col("standard").alias("reach"), F.left("standard", F.lit(7)).alias("k")), "k").drop("k")
    cites = it.select(F.col("standard").alias("code"), F.col("unit").cast("string").alias("unit")).distinct()
    return hierarchy.inverted_units(cites, edges).select("code", F.array_join("units", ",").alias("units"))


@query(I + "SELECT item, standard FROM items i WHERE standard LIKE '%#1%' OR domain = (SELECT min(domain) FROM items)")
def reached_items(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d).withColumn("more", F.array("domain"))
    first = it.agg(F.min("domain").alias("code"))
    wanted = it.where(F.col("standard").contains("#1")).select(F.col("standard").alias("code")).union(first).distinct()
    edges = wanted.select("code", F.col("code").alias("reach"))
    return hierarchy.reached_by_any(it, "standard", "more", edges, wanted).select("item", "standard")


@query(I + "SELECT standard AS code, count(DISTINCT (unit, lesson)) AS places FROM items GROUP BY standard HAVING count(DISTINCT (unit, lesson)) > 1")
def placement_drift(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.several_places(roles.items(spark, d).select(F.col("standard").alias("code"), "unit", "lesson"))


@query(
    with_parts(ITEMS, "special AS (SELECT item, lesson % 3 = 0 AS has_unit, lesson % 5 = 0 AS has_year, CASE WHEN lesson % 2 = 0 THEN unit + 1 END AS u, year + 1 AS y FROM items WHERE lesson % 3 = 0 OR lesson % 5 = 0)")
    + "SELECT i.item, CASE WHEN has_unit THEN u ELSE unit END AS unit, CASE WHEN has_year THEN y ELSE year END AS year, CASE WHEN s.item IS NULL THEN 'standard' ELSE 'item' END AS basis FROM items i LEFT JOIN special s USING (item)"
)
def alignment_override(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    lesson = F.col("lesson")
    present = F.array_compact(F.array(F.when(lesson % 3 == 0, "unit"), F.when(lesson % 5 == 0, "year")))
    special = it.where((lesson % 3 == 0) | (lesson % 5 == 0)).select("item", present.alias("present"), F.when(lesson % 2 == 0, F.col("unit") + 1).alias("unit"), (F.col("year") + 1).alias("year"))
    return hierarchy.override(it.select("item", "unit", "year"), special, "item", ["unit", "year"])


# --- set operations ------------------------------------------------------------------

FORWARD = "forward AS (SELECT DISTINCT standard, unit FROM items WHERE item % 2 = 0), backward AS (SELECT DISTINCT standard, unit FROM items WHERE item % 3 = 0)"


@query(with_parts(ITEMS, FORWARD) + "SELECT *, 'forward' AS side FROM (SELECT * FROM forward EXCEPT SELECT * FROM backward) UNION ALL SELECT *, 'backward' FROM (SELECT * FROM backward EXCEPT SELECT * FROM forward)")
def edge_symmetric_diff(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    return agreement.edge_disagreements(it.where("item % 2 = 0").select("standard", "unit").distinct(), it.where("item % 3 = 0").select("standard", "unit").distinct())


@query(
    with_parts(ITEMS, "numbered AS (SELECT DISTINCT CAST(year AS VARCHAR) AS test, CAST(item % 40 + 1 AS INTEGER) AS item FROM items WHERE item % 4 <> 1)")
    + "SELECT test, item FROM (SELECT DISTINCT test FROM numbered), (SELECT CAST(unnest(range(1, 43)) AS INTEGER) AS item) EXCEPT SELECT test, item FROM numbered"
)
def withheld_items(spark: SparkSession, d: str) -> DataFrame:
    n = roles.items(spark, d).where("item % 4 <> 1").select(F.col("year").cast("string").alias("test"), (F.col("item") % 40 + 1).cast("int").alias("item")).distinct()
    return agreement.withheld(n, n.select("test").distinct().withColumn("total", F.lit(42)))


PLAN = "plan AS (SELECT year, credits AS value, count(*) AS p FROM items GROUP BY ALL), done AS (SELECT year, credits AS value, count(*) AS r FROM items WHERE type = 'mc' GROUP BY ALL)"


@query(with_parts(ITEMS, PLAN) + "SELECT year, value, p - coalesce(r, 0) AS n FROM plan LEFT JOIN done USING (year, value) WHERE p > coalesce(r, 0)")
def credit_multiset_diff(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d).select("year", F.col("credits").alias("value"), "type")
    return agreement.multiset_difference(it, it.where("type = 'mc'"), "year")


@query(
    with_parts(ITEMS, PLAN, "open AS (SELECT year, value, unnest(range(p - coalesce(r, 0))) AS k FROM plan LEFT JOIN done USING (year, value))")
    + """SELECT s.year, s.item, v.value, CASE WHEN v.value IS NULL THEN 'none' ELSE 'order' END AS basis
FROM (SELECT year, item, row_number() OVER (PARTITION BY year ORDER BY item) AS i FROM items WHERE type = 'cr') s
LEFT JOIN (SELECT year, value, row_number() OVER (PARTITION BY year ORDER BY value, k) AS i FROM open) v USING (year, i)"""
)
def withheld_credit_plan(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    open_ = credit_multiset_diff(spark, d)
    return agreement.dealt_in_order(it.where("type = 'cr'").select("year", "item"), open_, "item", "year")


@query(
    with_parts(ITEMS, "found AS (SELECT DISTINCT standard, lesson FROM items WHERE item % 5 = 0), expected AS (SELECT DISTINCT standard, lesson FROM items WHERE item % 7 < 2)")
    + "SELECT *, 'stray' AS status FROM (SELECT * FROM found EXCEPT SELECT * FROM expected) UNION ALL SELECT *, 'unlocated' FROM (SELECT * FROM expected EXCEPT SELECT * FROM found)"
)
def stray_and_unlocated(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d).select("standard", "lesson", "item")
    return agreement.found_and_expected(it.where("item % 5 = 0").drop("item").distinct(), it.where("item % 7 < 2").drop("item").distinct(), "standard", "lesson")


@query(with_parts(ITEMS) + "SELECT item, unit, year FROM items WHERE item % 7 <> 0 UNION ALL SELECT item, unit + 100, year FROM items WHERE item % 7 = 0")
def upsert_reviewed(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d).select("item", "unit", "year")
    return sinks.upsert(it, it.where("item % 7 = 0").withColumn("unit", F.col("unit") + 100), "item")


@query(with_parts(ITEMS) + "SELECT CAST(0 AS BIGINT) + count(*) FILTER (WHERE lesson = 3) AS missing, count(*) FILTER (WHERE lesson = 3) AS extra, count(*) FILTER (WHERE lesson = 3) = 0 AS same FROM items")
def rebuild_compare(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d).select("item", "unit", "lesson", F.lit("2024-01-01").alias("generated"))
    new = it.withColumns({"generated": F.lit("2025-01-01"), "unit": F.when(F.col("lesson") == 3, F.col("unit") + 1).otherwise(F.col("unit"))})
    return agreement.same_rows(it, new, ignore=("generated",))
