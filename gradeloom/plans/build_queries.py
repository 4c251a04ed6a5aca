"""Queries: the payload's joins, alignment, curriculum and rule packs, over the driver's parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import build, checks, curriculum, quality
from gradeloom.plans import roles, sheets
from gradeloom.plans.registry import query, r3, with_parts
from gradeloom.plans.roles import ITEMS
from gradeloom.plans.sheets import CURRICULUM, SHEET_ITEMS

#: Item maps, tests, registry, pages and addresses; some parts are wrong on purpose.
BUILD = """maps AS (
  SELECT 't' || p_partkey % 70 AS test, CAST(p_partkey // 70 + 1 AS INTEGER) AS item, CASE WHEN p_partkey % 11 = 0 THEN 3 ELSE 1 + p_partkey % 2 END AS session, CASE WHEN p_size % 4 = 0 THEN 'cr' ELSE 'mc' END AS type,
         CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_size % 4 = 0 THEN NULL ELSE chr(CAST(65 + p_partkey % 4 AS INTEGER)) END AS key, CAST(CASE WHEN p_size % 4 = 0 THEN p_size % 3 + 1 ELSE 1 END AS INTEGER) AS credits,
         'NY-' || (5 + p_partkey % 4) || '.' || ['RP', 'NS', 'EE'][p_size % 3 + 1] || '.' || p_size % 7 || CASE WHEN p_partkey % 17 = 0 THEN '?' ELSE '' END AS standard, (p_size * 2 - 1) / 100.0::DOUBLE AS p_value,
         CASE WHEN p_size % 4 = 0 THEN p_size % 5 / 2.0::DOUBLE END AS avg_points, p_type AS domain_label, p_size FROM part),
btests AS (SELECT DISTINCT test, CAST(6 + CAST(substr(test, 2) AS INTEGER) % 3 AS INTEGER) AS grade, CAST(2020 + CAST(substr(test, 2) AS INTEGER) % 4 AS INTEGER) AS year FROM maps),
reg AS (SELECT code, grade, CAST(split_part(code, '.', 3) AS INTEGER) % 2 = 0 AS post_test, CASE WHEN n % 3 = 0 THEN [grade, grade + 1] WHEN n % 3 = 1 THEN [grade] ELSE CAST([] AS INTEGER[]) END AS assessed_on, CASE WHEN n % 2 = 0 THEN 'Domain ' || split_part(code, '.', 2) END AS domain_name
  FROM (SELECT DISTINCT standard AS code, CAST(substr(standard, 4, 1) AS INTEGER) AS grade, CAST(split_part(standard, '.', 3) AS INTEGER) + CAST(substr(standard, 4, 1) AS INTEGER) AS n FROM maps WHERE standard NOT LIKE '%?' AND standard NOT LIKE '%.6')),
bpages AS (SELECT test, item, CAST(item * 2 AS INTEGER) AS pdf_page, CAST(item AS INTEGER) AS printed_page FROM maps WHERE item % 5 <> 0),
addresses AS (SELECT DISTINCT grade, year, 'released' AS kind, 'http://x/' || grade || '-' || year || '.pdf' AS url FROM btests WHERE year <> 2021),
bitems AS (
  SELECT m.test || '-' || lpad(CAST(m.item AS VARCHAR), CAST(greatest(3, length(CAST(m.item AS VARCHAR))) AS INTEGER), '0') AS id, m.test, grade, year, m.item, session, type, key, credits, standard, CASE WHEN standard NOT LIKE '%?' THEN CAST(substr(standard, 4, 1) AS INTEGER) END AS standard_grade,
         CASE WHEN standard NOT LIKE '%?' THEN split_part(standard, '.', 2) END AS domain, coalesce(domain_name, domain_label) AS domain_label, p_value, avg_points, coalesce(r.post_test, false) AS post_test, pdf_page, printed_page,
         CASE WHEN pdf_page IS NULL THEN url ELSE url || '#page=' || pdf_page END AS source_url, r.code IS NOT NULL AS in_registry, assessed_on, r.grade AS registry_grade
  FROM maps m JOIN btests USING (test) LEFT JOIN (SELECT code, post_test, assessed_on, domain_name, grade AS rg, grade FROM reg) r0 ON false LEFT JOIN reg r ON r.code = standard LEFT JOIN bpages USING (test, item) LEFT JOIN addresses a USING (grade, year))"""
BUILD = BUILD.replace("LEFT JOIN (SELECT code, post_test, assessed_on, domain_name, grade AS rg, grade FROM reg) r0 ON false LEFT JOIN reg r ON r.code = standard", "LEFT JOIN (SELECT code, post_test, assessed_on, domain_name, grade AS registry_grade FROM reg) r ON r.code = standard").replace("r.grade AS registry_grade", "registry_grade")


def _maps(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    cr = n % 4 == 0
    domain = F.element_at(F.array(F.lit("RP"), F.lit("NS"), F.lit("EE")), (n % 3 + 1).cast("int"))
    return roles.table(spark, d, "part").select(
        F.concat(F.lit("t"), k % 70).alias("test"), (F.floor(k / 70) + 1).cast("int").alias("item"), F.when(k % 11 == 0, 3).otherwise((k % 2 + 1).cast("int")).alias("session"), F.when(cr, "cr").otherwise("mc").alias("type"),
        F.when((k % 13 != 0) & ~cr, F.char(k % 4 + 65)).alias("key"), F.when(cr, n % 3 + 1).otherwise(1).cast("int").alias("credits"),
        F.concat(F.lit("NY-"), k % 4 + 5, F.lit("."), domain, F.lit("."), n % 7, F.when(k % 17 == 0, "?").otherwise("")).alias("standard"), ((n * 2 - 1) / 100).alias("p_value"),
        F.when(cr, (n % 5) / 2).alias("avg_points"), F.col("p_type").alias("domain_label"),
    )


def _tests(maps: DataFrame) -> DataFrame:
    n = F.substring("test", 2, 9).cast("int")
    return maps.select("test").distinct().select("test", (n % 3 + 6).alias("grade"), (n % 4 + 2020).alias("year"))


def _registry(maps: DataFrame) -> DataFrame:
    codes = maps.where(~F.col("standard").endswith("?") & ~F.col("standard").endswith(".6")).select(F.col("standard").alias("code")).distinct()
    grade, last = F.substring("code", 4, 1).cast("int"), F.element_at(F.split("code", r"\."), 3).cast("int")
    n = grade + last
    assessed = F.when(n % 3 == 0, F.array(grade, grade + 1)).when(n % 3 == 1, F.array(grade)).otherwise(F.array().cast("array<int>"))
    name = F.when(n % 2 == 0, F.concat(F.lit("Domain "), F.element_at(F.split("code", r"\."), 2)))
    return codes.select("code", grade.alias("grade"), (last % 2 == 0).alias("post_test"), assessed.alias("assessed_on"), name.alias("domain_name"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    maps = _maps(spark, d)
    tests = _tests(maps)
    pages = maps.where("item % 5 <> 0").select("test", "item", (F.col("item") * 2).alias("pdf_page"), F.col("item").alias("printed_page"))
    url = F.concat(F.lit("http://x/"), "grade", F.lit("-"), "year", F.lit(".pdf"))
    sources = tests.where("year <> 2021").select("grade", "year", F.lit("released").alias("kind"), url.alias("url")).distinct()
    return build.item_rows(maps, tests, _registry(maps), pages, sources)


@query(with_parts(BUILD) + "SELECT id, test, grade, year, item, standard_grade, domain, domain_label, post_test, CASE WHEN standard_grade <> grade THEN standard_grade END AS post_test_from, pdf_page, printed_page, source_url, in_registry FROM bitems")
def payload_items(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).select("id", "test", "grade", "year", "item", "standard_grade", "domain", "domain_label", "post_test", "post_test_from", "pdf_page", "printed_page", "source_url", "in_registry")


#: The plan of item numbers: choice items first, two sessions, and the credits of constructed ones.
PLAN = """kinds AS (SELECT grade, item, CASE WHEN item <= 30 THEN 'mc' ELSE 'cr' END AS type, CASE WHEN item <= 20 THEN 1 ELSE 2 END AS session FROM (SELECT unnest([6, 7, 8]) AS grade), (SELECT unnest(range(1, 41)) AS item))"""


def _plan(spark: SparkSession) -> DataFrame:
    grades = spark.createDataFrame([(g, 40) for g in (6, 7, 8)], "grade int, designed_items int")
    kinds = spark.createDataFrame([(g, t, lo, hi) for g in (6, 7, 8) for t, lo, hi in (("mc", 1, 30), ("cr", 31, 40))], "grade int, type string, lo int, hi int")
    sessions = spark.createDataFrame([(g, n, lo, hi) for g in (6, 7, 8) for n, lo, hi in ((1, 1, 20), (2, 21, 40))], "grade int, session int, lo int, hi int")
    return build.numbered(grades, kinds, sessions)


@query(
    with_parts(BUILD, PLAN, "b AS (SELECT i.*, k.type AS want_type, k.session AS want_session FROM bitems i LEFT JOIN kinds k ON k.grade = i.grade AND k.item = i.item)")
    + """SELECT id, 'code' AS fault FROM b WHERE standard_grade IS NULL UNION ALL SELECT id, 'registry' FROM b WHERE standard_grade IS NOT NULL AND NOT in_registry
UNION ALL SELECT id, 'not-assessed' FROM b WHERE in_registry AND NOT list_contains(assessed_on, grade) UNION ALL SELECT id, 'post-test' FROM b WHERE in_registry AND (standard_grade <> grade) <> post_test
UNION ALL SELECT id, 'type' FROM b WHERE want_type IS NULL OR type <> want_type UNION ALL SELECT id, 'session' FROM b WHERE session IS DISTINCT FROM want_session"""
)
def payload_faults(spark: SparkSession, d: str) -> DataFrame:
    return build.faults(_items(spark, d), _plan(spark))


@query(
    with_parts(
        BUILD, PLAN, "gone AS (SELECT t.test, t.grade, k.item, k.session, k.type FROM btests t JOIN kinds k USING (grade) WHERE NOT EXISTS (SELECT 1 FROM bitems i WHERE i.test = t.test AND i.item = k.item))",
        "open AS (SELECT test, credits, unnest(range(n - coalesce(r, 0))) AS k FROM (SELECT t.test, c.credits, c.n, (SELECT count(*) FROM bitems i WHERE i.test = t.test AND i.type = 'cr' AND i.credits = c.credits) AS r FROM btests t, (VALUES (1, 2), (2, 5), (3, 3)) c(credits, n)) WHERE n > coalesce(r, 0))",
        "dealt AS (SELECT test, credits, row_number() OVER (PARTITION BY test ORDER BY credits, k) AS i FROM open)",
    )
    + """SELECT test, item, session, type, 1 AS credits, 'one credit by kind' AS basis FROM gone WHERE type = 'mc' UNION ALL
SELECT g.test, item, session, type, d.credits, 'inferred: the open credits in item order' FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY item) AS i FROM gone WHERE type = 'cr') g LEFT JOIN dealt d ON d.test = g.test AND d.i = g.i"""
)
def withheld_rows(spark: SparkSession, d: str) -> DataFrame:
    credits = spark.createDataFrame([(g, c, n) for g in (6, 7, 8) for c, n in ((1, 2), (2, 5), (3, 3))], "grade int, credits int, n int")
    it = _items(spark, d)
    return build.withheld_rows(it, _tests(_maps(spark, d)), _plan(spark), credits)


@query(
    with_parts(BUILD, "bystd AS (SELECT code AS standard, 'U' || length(domain_name) AS unit, code AS lesson, CAST(right(code, 1) AS INTEGER) = 3 AS draft FROM reg)", "byitem AS (SELECT id, item % 3 = 0 AS has_unit, CASE WHEN item % 2 = 0 THEN 'own' END AS unit, item % 7 = 0 AS draft FROM bitems WHERE item % 4 = 0)")
    + """SELECT i.id, CASE WHEN b.has_unit THEN b.unit ELSE s.unit END AS unit, s.lesson, CASE WHEN b.id IS NOT NULL THEN 'item-override' WHEN s.standard IS NOT NULL THEN 'standard-default' ELSE 'unaligned' END AS alignment_basis
FROM bitems i LEFT JOIN (SELECT * FROM bystd WHERE NOT draft) s USING (standard) LEFT JOIN (SELECT * FROM byitem WHERE NOT draft) b ON b.id = i.id"""
)
def aligned_items(spark: SparkSession, d: str) -> DataFrame:
    it = _items(spark, d).select("id", "item", "standard")
    r = _registry(_maps(spark, d))
    by_standard = r.select(F.col("code").alias("standard"), F.concat(F.lit("U"), F.length("domain_name")).alias("unit"), F.col("code").alias("lesson"), (F.right("code", F.lit(1)).cast("int") == 3).alias("draft"))
    present = F.when(F.col("item") % 3 == 0, F.array(F.lit("unit"))).otherwise(F.array().cast("array<string>"))
    by_item = it.where("item % 4 = 0").select("id", present.alias("present"), F.when(F.col("item") % 2 == 0, "own").alias("unit"), F.lit(None).cast("string").alias("lesson"), (F.col("item") % 7 == 0).alias("draft"))
    return build.aligned(it, by_standard, by_item, ["unit", "lesson"]).select("id", "unit", "lesson", "alignment_basis")


@query(with_parts(BUILD) + "SELECT count(*) AS released_items, CAST(sum(credits) AS BIGINT) AS released_credits, count(pdf_page) AS items_with_page, count(*) FILTER (WHERE post_test) AS post_test_items, (SELECT count(*) FROM btests) AS tests FROM bitems")
def payload_counters(spark: SparkSession, d: str) -> DataFrame:
    it = _items(spark, d)
    return build.counters(it, _tests(_maps(spark, d)), it.limit(0)).select("released_items", "released_credits", "items_with_page", "post_test_items", "tests")


@query(with_parts(BUILD, "cites AS (SELECT DISTINCT standard AS code FROM bitems WHERE item % 2 = 0)") + "SELECT code, code IN (SELECT code FROM cites) AS ever_cited FROM reg WHERE code IN (SELECT code FROM cites) OR len(assessed_on) > 0")
def cited_registry(spark: SparkSession, d: str) -> DataFrame:
    maps = _maps(spark, d)
    return build.cited_registry(_registry(maps), maps.where("item % 2 = 0").select(F.col("standard").alias("code"))).select("code", "ever_cited")


@query(
    with_parts(BUILD, "whole AS (SELECT *, 40 AS designed FROM bitems)")
    + " UNION ALL ".join(
        f"SELECT id, '{rule}' AS rule, 'fail' AS level FROM whole WHERE {bad}"
        for rule, bad in (
            ("mc-key", "type = 'mc' AND (key IS NULL OR key NOT IN ('A', 'B', 'C', 'D'))"), ("mc-one-credit", "type = 'mc' AND credits <> 1"), ("cr-no-key", "type = 'cr' AND key IS NOT NULL"), ("cr-credits", "type = 'cr' AND credits NOT IN (1, 2, 3)"),
            ("cr-average", "type = 'cr' AND avg_points IS NULL"), ("average-within-credits", "type = 'cr' AND avg_points > credits"), ("p-value", "NOT (p_value > 0 AND p_value <= 1)"), ("session", "session NOT IN (1, 2)"), ("designed-number", "item > designed"),
            ("in-registry", "NOT in_registry"), ("assessed-on-grade", "in_registry AND NOT list_contains(assessed_on, grade)"), ("post-test-agrees", "in_registry AND (registry_grade <> grade) <> post_test"), ("code-shape", "standard LIKE '%?'"),
        )
    )
)
def item_structure(spark: SparkSession, d: str) -> DataFrame:
    maps = _maps(spark, d)
    it = _items(spark, d).withColumn("designed_items", F.lit(40)).join(_registry(maps).select(F.col("code").alias("standard"), F.col("grade").alias("registry_grade")), "standard", "left")
    return quality.violations(it, checks.item_structure(), "id")


@query(
    with_parts(BUILD, "linked AS (SELECT *, CASE WHEN item % 6 = 0 THEN source_url || 'x' ELSE source_url END AS u, 70 AS pages FROM bitems)")
    + """SELECT id, 'page-in-document' AS rule FROM linked WHERE pdf_page > pages UNION ALL SELECT id, 'fragment-is-page' FROM linked WHERE pdf_page IS NOT NULL AND NOT ends_with(coalesce(u, ''), '#page=' || pdf_page)
UNION ALL SELECT id, 'no-page-no-fragment' FROM linked WHERE pdf_page IS NULL AND contains(coalesce(u, ''), '#page=')"""
)
def page_links(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("item") % 6 == 0, F.concat("source_url", F.lit("x"))).otherwise(F.col("source_url"))
    it = _items(spark, d).withColumns({"source_url": url, "page_count": F.lit(70)})
    return quality.violations(it, checks.page_links(), "id").drop("level")


@query(
    with_parts(BUILD, "ranges AS (SELECT unnest([6, 7, 8]) AS grade, unnest(['RP', 'NS', 'XX']) AS domain, unnest([10.0, 40.0, 9.0]) AS lo, unnest([20.0, 50.0, 30.0]) AS hi)")
    + "SELECT test || ':' || domain AS key, 'domain-share' AS rule, 'warn' AS level FROM (SELECT t.test, r.domain, r.lo, r.hi, coalesce((SELECT sum(credits) FROM bitems i WHERE i.test = t.test AND i.domain = r.domain), 0) * 100 / (SELECT sum(credits) FROM bitems i WHERE i.test = t.test) AS share FROM btests t JOIN ranges r USING (grade)) WHERE share < lo - 8 OR share > hi + 8"
)
def domain_share_warnings(spark: SparkSession, d: str) -> DataFrame:
    ranges = spark.createDataFrame([(6, "RP", 10.0, 20.0), (7, "NS", 40.0, 50.0), (8, "XX", 9.0, 30.0)], "grade int, domain string, lo double, hi double")
    return checks.domain_shares(_items(spark, d), ranges)


@query(
    with_parts(
        "codes AS (SELECT p_partkey AS code, ['RP', 'G', 'SP', 'ZZ'][p_partkey % 4 + 1] AS domain, CASE WHEN p_partkey % 4 = 1 OR p_partkey % 9 = 0 THEN 'Name ' || CAST(p_partkey % 4 AS VARCHAR) ELSE 'Name' END AS printed, CASE WHEN p_partkey % 10 <> 0 THEN p_name || ' about ' || ['rate', 'AREA', 'data'][p_partkey % 3 + 1] || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '.' END END AS said FROM part)"
    )
    + """SELECT domain AS key, 'one-name-per-domain' AS rule, 'fail' AS level FROM codes GROUP BY domain HAVING count(DISTINCT printed) > 1
UNION ALL SELECT CAST(code AS VARCHAR), 'description-is-a-sentence', 'fail' FROM codes WHERE said IS NOT NULL AND NOT ends_with(rtrim(said), '.')
UNION ALL SELECT CAST(code AS VARCHAR), 'description-is-about-its-domain', 'fail' FROM codes WHERE said IS NOT NULL AND NOT CASE domain WHEN 'RP' THEN regexp_matches(lower(said), 'ratio|proportional|rate|percent|unit')
  WHEN 'G' THEN regexp_matches(lower(said), 'congruen|transformation|similar|angle|pythagor|volume|rotation|dilat|area|surface|circle|geometr|coordinate|classify|two-dimensional|shapes|perimeter|figures')
  WHEN 'SP' THEN regexp_matches(lower(said), 'scatter|bivariate|associat|pattern|data|frequenc|distribution|variabilit|probabilit|chance|random|sample|inference|population|statistic') ELSE false END"""
)
def registry_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    printed = F.when((k % 4 == 1) | (k % 9 == 0), F.concat(F.lit("Name "), k % 4)).otherwise("Name")
    said = F.when(k % 10 != 0, F.concat("p_name", F.lit(" about "), pick(("rate", "AREA", "data"), 3), F.when(k % 7 == 0, "").otherwise(".")))
    return checks.registry(roles.table(spark, d, "part").select(k.alias("code"), pick(("RP", "G", "SP", "ZZ"), 4).alias("domain"), printed.alias("printed_name"), said.alias("cluster_text")))


# --- curriculum ---------------------------------------------------------------------------

CITES = """cites AS (SELECT DISTINCT grade, unit, lesson, CASE WHEN item % 3 = 0 THEN standard ELSE standard || 'a' END AS code FROM sitems WHERE unit IS NOT NULL AND lesson IS NOT NULL),
codes AS (SELECT DISTINCT standard AS code FROM sitems UNION SELECT DISTINCT standard || 'a' FROM sitems WHERE item % 2 = 0)"""


def _cites(it: DataFrame) -> DataFrame:
    code = F.when(F.col("item") % 3 == 0, F.col("standard")).otherwise(F.concat("standard", F.lit("a")))
    return it.where("unit IS NOT NULL AND lesson IS NOT NULL").select("grade", "unit", "lesson", code.alias("code")).distinct()


def _codes(it: DataFrame) -> DataFrame:
    return it.select(F.col("standard").alias("code")).unionByName(it.where("item % 2 = 0").select(F.concat("standard", F.lit("a")).alias("code"))).distinct()


UNIT_CODES = """ucodes AS (SELECT DISTINCT c.grade, c.unit, coalesce(r.code, c.code) AS code FROM cites c LEFT JOIN codes r ON r.code = c.code OR (length(r.code) = length(c.code) + 1 AND starts_with(r.code, c.code) AND regexp_matches(r.code, '[a-z]$')))"""


@query(with_parts(SHEET_ITEMS, CITES, UNIT_CODES) + "SELECT DISTINCT u.grade, u.unit, i.id FROM ucodes u JOIN sitems i ON i.grade = u.grade AND (i.standard = u.code OR i.standard || 'a' = u.code)")
def unit_items(spark: SparkSession, d: str) -> DataFrame:
    it = sheets.items(spark)
    codes = curriculum.unit_standards(_cites(it), _codes(it))
    return curriculum.unit_items(it.withColumn("secondary", F.array(F.concat("standard", F.lit("a")))), codes)


@query(
    with_parts(SHEET_ITEMS, CITES, "asked AS (SELECT DISTINCT grade, code FROM cites UNION SELECT DISTINCT grade, 'NY-9.ZZ.1' FROM cites)", "fam AS (SELECT a.grade, a.code, r.code AS reach FROM asked a JOIN codes r ON r.code = a.code OR (length(r.code) = length(a.code) + 1 AND starts_with(r.code, a.code) AND regexp_matches(r.code, '[a-z]$')))")
    + """SELECT a.grade, a.code, f.code IS NOT NULL AS known, coalesce(family, '') AS family, coalesce((SELECT count(DISTINCT id) FROM fam x JOIN sitems i ON i.grade = x.grade AND (i.standard = x.reach OR i.standard || 'a' = x.reach) WHERE x.grade = a.grade AND x.code = a.code), 0) AS hits, coalesce(after, false) AS after_test
FROM asked a LEFT JOIN (SELECT grade, code, string_agg(reach, ',' ORDER BY reach) AS family, bool_and(length(reach) % 2 = 0) AS after FROM fam GROUP BY grade, code) f ON f.grade = a.grade AND f.code = a.code"""
)
def standard_chips(spark: SparkSession, d: str) -> DataFrame:
    it = sheets.items(spark)
    c = _cites(it)
    asked = c.select("grade", "code").unionByName(c.select("grade", F.lit("NY-9.ZZ.1").alias("code"))).distinct()
    none = F.lit(None).cast("string")
    registry = _codes(it).select("code", none.alias("cluster_text"), none.alias("domain_name"), (F.length("code") % 2 == 0).alias("post_test"), F.array().cast("array<int>").alias("assessed_on"))
    got = curriculum.chips(asked, registry, it.withColumn("secondary", F.array(F.concat("standard", F.lit("a")))))
    return got.select("grade", "code", "known", F.coalesce(F.array_join("family", ","), F.lit("")).alias("family"), "hits", "after_test")


@query(with_parts(SHEET_ITEMS, "l AS (SELECT grade AS taught, grade + 1 AS tested, standard AS code FROM sitems GROUP BY ALL UNION SELECT 6, 7, 'NY-6.QQ.1')") + "SELECT l.taught, l.tested, l.code, count(i.id) AS n FROM l LEFT JOIN (SELECT grade, id, CASE WHEN item % 2 = 0 THEN 'NY-' || (grade - 1) || substr(standard, 5) ELSE standard END AS s FROM sitems) i ON i.grade = l.tested AND i.s = l.code GROUP BY ALL")
def prior_grade_items(spark: SparkSession, d: str) -> DataFrame:
    it = sheets.items(spark)
    codes = it.select(F.col("grade").alias("taught"), (F.col("grade") + 1).alias("tested"), F.col("standard").alias("code")).distinct().unionByName(spark.createDataFrame([(6, 7, "NY-6.QQ.1")], "taught int, tested int, code string"))
    prior = F.when(F.col("item") % 2 == 0, F.concat(F.lit("NY-"), F.col("grade") - 1, F.expr("substring(standard, 5)"))).otherwise(F.col("standard"))
    return curriculum.prior_grade_items(codes, it.withColumn("standard", prior))


@query(with_parts(SHEET_ITEMS, CURRICULUM) + "SELECT id, string_agg('unit ' || unit || coalesce(' ' || title, ''), ' ' ORDER BY unit) AS text FROM (SELECT id, grade, unit FROM sitems WHERE unit IS NOT NULL UNION SELECT id, grade, 99 FROM sitems WHERE unit IS NOT NULL AND item % 2 = 0) LEFT JOIN sunits USING (grade, unit) GROUP BY id")
def unit_texts(spark: SparkSession, d: str) -> DataFrame:
    it = sheets.items(spark).where("unit IS NOT NULL").select("id", "grade", "unit", "item")
    both = it.drop("item").unionByName(it.where("item % 2 = 0").select("id", "grade", F.lit(99).alias("unit")))
    return curriculum.unit_texts(both, sheets.data(spark).units)


@query(
    with_parts(SHEET_ITEMS, CITES, CURRICULUM, "bare0 AS (SELECT DISTINCT grade, unit, lesson FROM slessons WHERE (unit + lesson) % 2 = 0)", "empty AS (SELECT grade, unit, lesson FROM slessons EXCEPT SELECT grade, unit, lesson FROM cites)")
    + """SELECT '9' AS key, 'grade-is-indexed' AS rule, 'fail' AS level UNION ALL SELECT grade || '.' || unit, 'unit-is-paced', 'fail' FROM sunits WHERE unit = 4
UNION ALL SELECT DISTINCT code, 'cited-code-resolves', 'warn' FROM cites c WHERE NOT EXISTS (SELECT 1 FROM codes k WHERE k.code = c.code OR (length(k.code) = length(c.code) + 1 AND starts_with(k.code, c.code)))
UNION ALL SELECT grade || '.' || unit || '.' || lesson, 'bare-lesson-is-recorded', 'fail' FROM (SELECT * FROM empty EXCEPT SELECT * FROM bare0) UNION ALL SELECT grade || '.' || unit || '.' || lesson, 'recorded-lesson-is-bare', 'fail' FROM (SELECT * FROM bare0 EXCEPT SELECT * FROM empty)"""
)
def curriculum_checks(spark: SparkSession, d: str) -> DataFrame:
    data = sheets.data(spark)
    units = data.units.withColumn("days", F.when(F.col("unit") != 4, F.lit(10)))
    bare = data.lessons.where("(unit + lesson) % 2 = 0").select("grade", "unit", "lesson")
    return checks.curriculum(units, data.lessons, _cites(data.items), _codes(data.items), bare, (6, 7, 8, 9))


@query(
    with_parts(SHEET_ITEMS, CURRICULUM)
    + """SELECT id, CASE WHEN unit IS NOT NULL AND placed = grade THEN 'judged' WHEN unit IS NOT NULL THEN 'elsewhere' WHEN u IS NOT NULL THEN 'derived' ELSE 'none' END AS how,
 CASE WHEN unit IS NOT NULL AND placed = grade THEN CAST(unit AS VARCHAR) WHEN unit IS NOT NULL THEN '' ELSE coalesce(u, '') END AS units
FROM (SELECT i.*, (SELECT string_agg(DISTINCT CAST(t.unit AS VARCHAR), ',' ORDER BY CAST(t.unit AS VARCHAR)) FROM staught t WHERE t.grade = i.grade AND t.standard = i.standard) AS u FROM sitems i)"""
)
def unit_filter(spark: SparkSession, d: str) -> DataFrame:
    data = sheets.data(spark)
    got = checks.unit_filter(data.items.withColumn("secondary", F.lit(None).cast("array<string>")), data.taught)
    return got.select("id", "how", F.array_join("units", ",").alias("units"))


@query(with_parts(SHEET_ITEMS, CITES, CURRICULUM) + "SELECT l.grade, count(DISTINCT l.unit) AS units, count(*) AS lessons, count(c.grade) AS citing, any_value(pairs) AS pairs, any_value(n) AS codes, count(*) - count(c.grade) AS bare FROM slessons l LEFT JOIN (SELECT DISTINCT grade, unit, lesson FROM cites) c ON c.grade = l.grade AND c.unit = l.unit AND c.lesson = l.lesson LEFT JOIN (SELECT grade, count(*) AS pairs, count(DISTINCT code) AS n FROM cites GROUP BY grade) p ON p.grade = l.grade GROUP BY l.grade")
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    data = sheets.data(spark)
    return curriculum.index_counts(data.lessons, _cites(data.items))


@query(with_parts(SHEET_ITEMS, CITES) + "SELECT grade, code, CAST(unit * 100 + lesson AS INTEGER) AS lesson, CASE WHEN unit % 3 = 0 THEN 'by-standard' ELSE 'by-lesson' END AS side FROM cites WHERE (unit % 3 = 0) <> (lesson % 2 = 0)")
def both_ways(spark: SparkSession, d: str) -> DataFrame:
    c = _cites(sheets.items(spark)).withColumn("_l", (F.col("unit") * 100 + F.col("lesson")).cast("int"))
    by_lesson = c.where("unit % 3 <> 0").select("grade", "code", F.col("_l").alias("lesson"))
    by_standard = c.where("lesson % 2 <> 0").select("grade", "code", F.col("_l").alias("lesson"))
    return curriculum.both_ways(by_lesson, by_standard)


@query("SELECT l_partkey AS item, l_suppkey AS lesson, bool_or(l_returnflag = 'A') AS unit_tag, bool_or(l_returnflag = 'N') AS table_tag FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY ALL")
def evidence_sets(spark: SparkSession, d: str) -> DataFrame:
    pairs = roles.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("lesson"), "l_returnflag")
    return curriculum.evidence_sets(pairs.where("l_returnflag = 'A'"), pairs.where("l_returnflag = 'N'"), "item", "lesson")


@query(
    with_parts("pairs AS (SELECT DISTINCT l_partkey AS q, l_suppkey AS d, min(l_returnflag) AS f FROM lineitem GROUP BY ALL)", "sizes AS (SELECT q, count(*) AS n FROM pairs WHERE f IN ('A', 'N') GROUP BY q)")
    + "SELECT count(*) AS relevant, count(*) FILTER (WHERE f = 'A') AS in_tier1, count(*) FILTER (WHERE f IN ('A', 'N')) AS in_either, (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS r, count(*) OVER () AS k FROM sizes) WHERE r = k // 2) AS median_read FROM pairs WHERE q % 2 = 0"
)
def tier_recall(spark: SparkSession, d: str) -> DataFrame:
    p = roles.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("q"), F.col("l_suppkey").alias("d")).agg(F.min("l_returnflag").alias("f"))
    return curriculum.tier_recall(p.where("q % 2 = 0"), p.where("f = 'A'"), p.where("f = 'N'"), "q", "d")


@query(
    with_parts(ITEMS, "u AS (SELECT unit, count(*) AS lessons, CAST(sum(credits) % 3 AS INTEGER) AS n_optional, unit = 9 AS all_optional, unit % 2 = 0 AS mid FROM items GROUP BY unit)", "w AS (SELECT *, CASE WHEN all_optional THEN lessons ELSE lessons + 2 + CASE WHEN mid THEN 1 ELSE 0 END END AS hi FROM u)", "v AS (SELECT *, CASE WHEN all_optional THEN 0 ELSE hi - n_optional END AS lo FROM w)")
    + "SELECT unit, lo AS want_lo, hi AS want_hi FROM v WHERE unit % 3 = 0"
)
def pacing_identity(spark: SparkSession, d: str) -> DataFrame:
    u = roles.items(spark, d).groupBy("unit").agg(F.count("*").alias("lessons"), (F.sum("credits") % 3).cast("int").alias("n_optional"))
    whole, mid = F.col("unit") == 9, F.col("unit") % 2 == 0
    hi = F.when(whole, F.col("lessons")).otherwise(F.col("lessons") + 2 + F.when(mid, 1).otherwise(0))
    lo = F.when(whole, 0).otherwise(hi - F.col("n_optional"))
    off = F.when(F.col("unit") % 3 == 0, 1).otherwise(0)
    return checks.pacing_identity(u.withColumns({"all_optional": whole, "mid_unit_assessment": mid, "days_hi": hi, "days_lo": lo + off})).select("unit", "want_lo", "want_hi")


@query("SELECT l_orderkey AS k, max(l_linenumber) - count(DISTINCT l_linenumber) AS missing, count(*) - count(DISTINCT l_linenumber) AS repeated FROM lineitem GROUP BY 1 HAVING max(l_linenumber) <> count(DISTINCT l_linenumber) OR count(*) <> count(DISTINCT l_linenumber)")
def numbering_faults(spark: SparkSession, d: str) -> DataFrame:
    return checks.numbering(roles.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber"), "l_linenumber", "k")


@query("SELECT o_custkey AS k, o_orderkey AS id FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE o_orderpriority <= b")
def not_rising(spark: SparkSession, d: str) -> DataFrame:
    o = roles.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), "o_orderpriority")
    return checks.not_rising(o, "o_orderpriority", "id", "k").select("k", "id")


@query(
    "WITH a AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS c FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, list(DISTINCT o_orderpriority) AS c FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.c IS NULL THEN 'only-b' WHEN b.c IS NULL THEN 'only-a' WHEN list_has_any(a.c, b.c) THEN 'overlap' ELSE 'disjoint' END AS status FROM a FULL JOIN b ON a.k = b.k"
)
def standards_overlap(spark: SparkSession, d: str) -> DataFrame:
    o = roles.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority", "o_orderkey")
    codes = lambda n: o.where(F.col("o_orderkey") % 2 == n).groupBy("k").agg(F.collect_set("o_orderpriority").alias("codes"))
    return checks.overlap(codes(0), codes(1), "k")


@query("SELECT grade, code, 'chart' AS side FROM (SELECT 6 + n_nationkey % 3 AS grade, n_name AS code FROM nation WHERE n_nationkey % 2 = 0 EXCEPT SELECT 6 + n_nationkey % 3, n_name FROM nation WHERE n_nationkey % 4 <> 0) WHERE grade <> 7 UNION ALL SELECT 6 + n_nationkey % 3, n_name, 'table' FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey % 2 <> 0 AND n_nationkey % 3 <> 1")
def chart_and_table(spark: SparkSession, d: str) -> DataFrame:
    n = roles.table(spark, d, "nation").select((F.col("n_nationkey") % 3 + 6).alias("grade"), F.col("n_name").alias("code"), "n_nationkey")
    return checks.chart_and_table(n.where("n_nationkey % 2 = 0"), n.where("n_nationkey % 4 <> 0"), excused=(7,))


@query("SELECT doc_id AS id, 'K' || quality AS first, 'K' || toxic AS second FROM labels WHERE quality <> toxic AND doc_id % 3 <> 0")
def second_keys(spark: SparkSession, d: str) -> DataFrame:
    lab = roles.table(spark, d, "labels")
    a = lab.select(F.col("doc_id").alias("id"), F.concat(F.lit("K"), "quality").alias("key"))
    return checks.second_keys(a, lab.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), F.concat(F.lit("K"), "toxic").alias("key")))


@query(
    with_parts("rows0 AS (SELECT 't' || p_partkey % 40 AS test, CAST(CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE p_partkey // 40 + 1 END AS INTEGER) AS item, p_partkey AS place, CASE WHEN p_size % 5 = 0 THEN 'cr' ELSE 'mc' END AS type, CASE WHEN p_partkey % 40 < 4 THEN 'A' ELSE chr(CAST(65 + p_partkey % 4 AS INTEGER)) END AS key, p_size % 5 + 1 AS credits, CASE WHEN p_size <> 10 THEN 1.0 END AS avg_points, p_size / 45.0 AS p_value FROM part)")
    + """SELECT test || '-' || item AS key, 'number-once' AS rule FROM rows0 GROUP BY test, item HAVING count(*) > 1 UNION ALL SELECT test || '-' || item, 'numbers-rise' FROM (SELECT *, lag(item) OVER (PARTITION BY test ORDER BY place) AS b FROM rows0) WHERE item < b
UNION ALL SELECT test, 'keys-vary' FROM (SELECT test, key, count(*) AS n FROM rows0 WHERE type = 'mc' GROUP BY ALL) GROUP BY test HAVING max(n) > sum(n) * 0.6 UNION ALL SELECT test || '-' || item, 'cr-credits' FROM rows0 WHERE type = 'cr' AND credits NOT IN (1, 2, 3)
UNION ALL SELECT test || '-' || item, 'cr-average' FROM rows0 WHERE type = 'cr' AND avg_points IS NULL UNION ALL SELECT test || '-' || item, 'p-value' FROM rows0 WHERE NOT (p_value > 0 AND p_value <= 1)"""
)
def item_map_faults(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    rows = roles.table(spark, d, "part").select(
        F.concat(F.lit("t"), k % 40).alias("test"), F.when(k % 97 == 0, 1).otherwise(F.floor(k / 40) + 1).cast("int").alias("item"), k.alias("place"), F.when(n % 5 == 0, "cr").otherwise("mc").alias("type"),
        F.when(k % 40 < 4, "A").otherwise(F.char(k % 4 + 65)).alias("key"), (n % 5 + 1).alias("credits"), F.when(n != 10, 1.0).alias("avg_points"), (n / 45).alias("p_value"),
    )
    return checks.item_map_faults(rows).drop("level")


TRANSCRIBED = "tr AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_partkey % 5 AS c, p_size AS n FROM part)"


@query(
    with_parts(TRANSCRIBED)
    + """SELECT id, 'balanced-tags' AS rule FROM tr WHERE k = 1 UNION ALL SELECT id, 'four-choices' FROM tr WHERE c = 1 AND n % 6 <> 0 UNION ALL SELECT id, 'one-correct-choice' FROM tr WHERE c = 2 AND n % 6 <> 0
UNION ALL SELECT id, 'choice-not-empty' FROM tr WHERE c = 3 AND n % 6 <> 0 UNION ALL SELECT id, 'no-thin-space' FROM tr WHERE k = 2 UNION ALL SELECT id, 'no-open-kerning' FROM tr WHERE k = 3 UNION ALL SELECT id, 'bars-say-what-they-are' FROM tr WHERE n % 7 = 0
UNION ALL SELECT id, 'key-is-official' FROM tr WHERE c <> 2 AND n % 4 <> 1 AND c <> 1 UNION ALL SELECT id, 'cr-has-answer' FROM tr WHERE n % 6 = 0 AND n % 5 = 0 UNION ALL SELECT id, 'answer-has-source' FROM tr WHERE n % 6 = 0 AND n % 5 <> 0 AND n % 4 = 0"""
)
def transcription_rules(spark: SparkSession, d: str) -> DataFrame:
    k, c, n = F.col("p_partkey") % 4, F.col("p_partkey") % 5, F.col("p_size")
    stem = F.concat(F.when(k == 1, "<b>open").when(k == 2, "a b").when(k == 3, "where f (x) is").otherwise("<i>fine</i> Time (seconds)"), F.when(n % 7 == 0, ' <span class="repeat">DF</span>').otherwise(' <span class="repeat">3.1</span>'))
    choice = lambda label, text, right: F.struct(F.lit(label).alias("label"), text.alias("text"), right.alias("is_correct"))
    choices = F.array(*[choice(x, F.when((c == 3) & (x == "D"), "<i> </i>").otherwise(F.lit("t" + x)) if x == "D" else F.lit("t" + x), (F.lit(x == "B") & (c != 2))) for x in "ABCD"])
    choices = F.when(c == 1, F.slice(choices, 3, 2)).otherwise(choices)
    cr = n % 6 == 0
    rows = roles.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.when(cr, "cr").otherwise("mc").alias("type"), stem.alias("stem"), F.lit(None).cast("string").alias("stem_after"), choices.alias("choices"), F.lit(False).alias("choices_in_image"),
        F.when(cr & (n % 5 != 0), "42").alias("answer"), F.when(n % 4 != 0, "page 3").alias("answer_source"), F.when(n % 4 == 1, "B").otherwise("C").alias("official_key"),
    )
    return quality.violations(rows, checks.transcription(), "id").drop("level")


#: Entries with evidence: some name no item, no lesson, another title, page or quote.
ENTRIES = """entries AS (SELECT CASE WHEN item = 13 THEN 'ghost-' || id ELSE id END AS id, grade, course, unit, lesson AS primary_lesson, CASE WHEN item % 6 = 0 THEN 'Other' ELSE 'Lesson ' || unit || '.' || lesson END AS lesson_title, item FROM sitems WHERE unit IS NOT NULL AND lesson IS NOT NULL AND placed = grade),
ev AS (SELECT id, grade, unit, CASE WHEN item % 4 = 1 THEN CAST(primary_lesson % 3 + 1 AS INTEGER) ELSE primary_lesson END AS lesson, item, CASE WHEN item % 9 = 0 THEN NULL ELSE 'Activity ' || item % 3 END AS activity, CASE WHEN item % 5 = 0 THEN 99 ELSE 7 END AS page,
  CASE WHEN item % 8 = 0 THEN 'one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen' WHEN item % 2 = 0 THEN 'Ask — them' ELSE 'nothing like it' END AS quote FROM entries)"""


@query(
    with_parts(SHEET_ITEMS, CURRICULUM, ENTRIES, "met AS (SELECT ev.*, l.title FROM ev LEFT JOIN slessons l ON l.grade = ev.grade AND l.unit = ev.unit AND l.lesson = ev.lesson)", "prime AS (SELECT e.*, l.title FROM entries e LEFT JOIN slessons l ON l.grade = e.grade AND l.unit = e.unit AND l.lesson = e.primary_lesson)")
    + """SELECT id AS key, 'item-exists' AS rule FROM entries WHERE item = 13 UNION ALL SELECT id, 'lesson-exists' FROM met WHERE title IS NULL UNION ALL SELECT id, 'lesson-exists' FROM prime WHERE title IS NULL
UNION ALL SELECT id, 'title-is-the-lesson''s' FROM met WHERE title IS NOT NULL AND lower(title) <> 'lesson ' || unit || '.' || lesson UNION ALL SELECT id, 'title-is-the-lesson''s' FROM prime WHERE title IS NOT NULL AND lesson_title = 'Other'
UNION ALL SELECT id, 'primary-lesson-has-evidence' FROM prime p WHERE title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.id = p.id AND ev.lesson = p.primary_lesson)
UNION ALL SELECT id, 'activity-and-page' FROM met WHERE title IS NOT NULL AND activity IS NULL UNION ALL SELECT id, 'quote-is-short' FROM met WHERE title IS NOT NULL AND item % 8 = 0
UNION ALL SELECT id, 'activity-exists' FROM met WHERE title IS NOT NULL AND activity = 'Activity 2' UNION ALL SELECT id, 'quote-is-there' FROM met WHERE title IS NOT NULL AND activity IN ('Activity 0', 'Activity 1') AND (item % 8 = 0 OR item % 2 <> 0)
UNION ALL SELECT id, 'page-is-the-activity''s' FROM met WHERE title IS NOT NULL AND activity IN ('Activity 0', 'Activity 1') AND page <> 7"""
)
def alignment_checks(spark: SparkSession, d: str) -> DataFrame:
    data = sheets.data(spark)
    it = data.items
    own = it.where("unit IS NOT NULL AND lesson IS NOT NULL").where(F.regexp_extract("course", r"Grade (\d)", 1) == F.col("grade").cast("string"))
    i = F.col("item")
    id_ = F.when(i == 13, F.concat(F.lit("ghost-"), "id")).otherwise(F.col("id")).alias("id")
    title = lambda c: F.concat(F.lit("Lesson "), "unit", F.lit("."), c)
    entries = own.select(id_, "course", "unit", F.col("lesson").alias("primary_lesson"), F.when(i % 6 == 0, "Other").otherwise(title(F.col("lesson"))).alias("lesson_title"))
    lesson = F.when(i % 4 == 1, F.col("lesson") % 3 + 1).otherwise(F.col("lesson")).cast("int")
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    evidence = own.select(
        id_, lesson.alias("lesson"), title(lesson).alias("lesson_title"), F.when(i % 9 != 0, F.concat(F.lit("Activity "), i % 3)).alias("activity"), F.when(i % 5 == 0, 99).otherwise(7).alias("page"),
        F.when(i % 8 == 0, long).when(i % 2 == 0, "Ask — them").otherwise("nothing like it").alias("quote"), F.lit("taught").alias("role"),
    )
    acts = data.lessons.select("grade", "unit", "lesson", F.lit("ACTIVITY 1").alias("name"), F.lit(7).alias("page"), F.lit("First, ask - them all.").alias("body"))
    problems = data.lessons.select("grade", "unit", "lesson", F.lit("Activity  0").alias("name"), F.lit(7).alias("page"), F.lit("Now ask them.").alias("body"))
    return checks.alignment(entries, evidence, it.select("id"), data.lessons, acts, problems).drop("level")


@query(with_parts(SHEET_ITEMS, CURRICULUM) + "SELECT id, string_agg(DISTINCT CAST(t.unit AS VARCHAR), ',' ORDER BY CAST(t.unit AS VARCHAR)) AS units FROM sitems i JOIN staught t USING (grade, standard) WHERE i.unit IS NOT NULL GROUP BY id, i.unit HAVING NOT bool_or(t.unit = i.unit)")
def misfiled(spark: SparkSession, d: str) -> DataFrame:
    data = sheets.data(spark)
    return checks.misfiled(data.items.where("unit IS NOT NULL").select("id", "grade", "standard", "unit"), data.taught).select("id", F.array_join("units", ",").alias("units"))


@query(with_parts(ITEMS, f"f AS (SELECT standard, CAST(sum(credits) AS BIGINT) % 23 / 10.0::DOUBLE AS credits_lost FROM items GROUP BY standard)") + f"SELECT standard, credits_lost, {r3('credits_lost * 0.112', 2)} AS levels_lost FROM f")
def levels_lost(spark: SparkSession, d: str) -> DataFrame:
    f = roles.items(spark, d).groupBy("standard").agg(((F.sum("credits") % 23) / 10.0).alias("credits_lost"))
    slopes = spark.createDataFrame([("L1", 0.061, 5), ("L2", 0.112, 5), ("L3", None, 0)], "band string, per_credit double, segments int")
    return curriculum.levels_lost(f, slopes)
