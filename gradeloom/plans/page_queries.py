"""Queries: tables read off printed pages, glyphs, titles and scalar text, made from the driver's rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import scalars
from gradeloom.operators import agreement, build, checks, curriculum, expressions, extract
from gradeloom.operators.stored import checkpointed
from gradeloom.plans import roles
from gradeloom.plans.registry import query, r3, with_parts
from gradeloom.sources import tables

#: The headings of an item map, and which of them a table must have.
COLUMNS = (
    ("Question", ("Question",), True), ("Type", ("Type",), True), ("Key", ("Key",), True), ("Points", ("Points",), True),
    ("Standard", ("Standard",), True), ("Domain", ("Domain",), False), ("Secondary", ("Secondary",), False),
)

#: Item maps of thirty parts each, two pages of fifteen rows; a statistic sits a little lower than its row.
MAPS = """tmap AS (SELECT p_partkey // 30 AS doc, CAST(p_partkey % 30 + 1 AS INTEGER) AS item, p_partkey % 30 // 15 + 5 AS page, CASE WHEN p_size % 4 = 0 THEN 'cr' ELSE 'mc' END AS type, CASE WHEN p_size % 4 <> 0 THEN chr(CAST(65 + p_size % 4 AS INTEGER)) END AS key,
  CAST(CASE WHEN p_size % 4 = 0 THEN p_size % 3 + 1 ELSE 1 END AS INTEGER) AS credits, p_partkey % 7 = 0 AS old,
  CASE WHEN p_partkey % 7 = 0 THEN '7.RP.A.' || p_size WHEN p_partkey % 11 = 0 THEN 'NY-' || (6 + p_partkey % 3) || '.RP.A' ELSE 'NY-' || (6 + p_partkey % 3) || '.RP.' || p_size || CASE WHEN p_size % 5 = 0 THEN '.a' WHEN p_size % 5 = 1 THEN 'b' ELSE '' END END AS standard,
  CASE WHEN p_size % 3 = 0 THEN 'NY-6.EE.' || p_size % 9 END AS second, CASE WHEN p_partkey % 6 = 0 AND p_partkey % 7 <> 0 THEN 1 ELSE 0 END AS doubled,
  (p_size % 9 * 10 + 15) / 100.0::DOUBLE AS p_value, CASE WHEN p_size % 4 = 0 THEN p_size // 4 % 7 / 2.0::DOUBLE END AS avg_points, CASE WHEN p_partkey % 30 < 10 THEN 1 ELSE 2 END AS session FROM part)"""


def _word(x: float | Column, y: Column, text: Column, wide: float = 20.0) -> Column:
    x = F.lit(float(x)) if not isinstance(x, Column) else x.cast("double")
    return F.struct((x - wide / 2).alias("x0"), y.cast("double").alias("y0"), (x + wide / 2).alias("x1"), (y + 10).cast("double").alias("y1"), text.cast("string").alias("text"))


def _map_words(spark: SparkSession, d: str) -> DataFrame:
    """Words (doc, page, x0, y0, x1, y1, text) of the maps, with headings, sessions and a footnote."""
    k, n = F.col("p_partkey"), F.col("p_size")
    p = roles.table(spark, d, "part").select(F.floor(k / 30).alias("doc"), (F.floor(k % 30 / 15) + 5).alias("page"), (k % 30).alias("i"), k.alias("k"), n.alias("n"))
    y = F.lit(100) + F.col("i") % 15 * 14 + F.when(F.col("i") >= 10, 7).otherwise(0)
    cr, n = F.col("n") % 4 == 0, F.col("n")
    # codes of both eras, of clusters, with sub-letters behind a dot or none, some with the prefix printed twice
    tail = F.when(F.col("k") % 11 == 0, F.lit("A")).otherwise(F.concat(n, F.when(n % 5 == 0, ".a").when(n % 5 == 1, "b").otherwise("")))
    new = F.concat(F.lit("NGLS.Math.Content."), F.when(F.col("k") % 6 == 0, "NY-NY-").otherwise("NY-"), F.col("k") % 3 + 6, F.lit(".RP."), tail)
    code = F.when(F.col("k") % 7 == 0, F.concat(F.lit("CCSS.Math.Content.7.RP.A."), n)).otherwise(new)
    share = F.format_string(".%02d", (n % 9 * 10 + 15).cast("int"))  # without a zero before the point
    half = F.floor(n / 4) % 7
    average = F.concat(F.floor(half / 2).cast("string"), F.when(half % 2 == 1, ".5").otherwise(""))  # whole ones without a point
    low = y + 1
    row = F.array(
        _word(40, y, F.col("i") + 1), _word(100, y, F.when(cr, "Constructed").otherwise("Multiple")), _word(130, y, F.when(cr, "Response").otherwise("Choice")), _word(180, y, F.when(cr, "n/a").otherwise(F.char(n % 4 + 65))),
        _word(230, y, F.when(cr, n % 3 + 1).otherwise(1)), _word(300, y, code, 60), _word(380, y, F.lit("Ratios"), 40), _word(460, y, F.when(n % 3 == 0, F.concat(F.lit("NGLS.Math.Content.NY-6.EE."), n % 9)), 60),
        _word(600, low, F.when(cr, average).otherwise(share)), _word(660, low, F.when(cr, share)),
    )
    pages = p.groupBy("doc", "page").agg(F.max(y).alias("last"))
    heads = F.array(*[_word(x, F.lit(80), F.lit(t), 30) for x, t in ((40, "Question"), (115, "Type"), (180, "Key"), (230, "Points"), (300, "Standard"), (380, "Domain"), (460, "Secondary"))], _word(500, F.lit(80), F.lit("Standard(s)"), 30))
    foot = F.array(_word(100, F.col("last") + 17, F.lit("*This")), _word(130, F.col("last") + 17, F.lit("item")), _word(160, F.col("last") + 17, F.lit("map")))
    title = F.array(_word(300, F.lit(40), F.lit("Map")), _word(330, F.lit(40), F.lit("to")), _word(350, F.lit(40), F.lit("the")), _word(400, F.lit(40), F.lit("Standards")))
    first = F.array(_word(300, F.lit(93), F.lit("Session")), _word(340, F.lit(93), F.when(F.col("page") == 5, 1).otherwise(2)))
    break_ = F.array(_word(300, F.lit(238), F.lit("Session")), _word(340, F.lit(238), F.lit(2)))
    flat = lambda df, words: df.select("doc", "page", F.explode(words).alias("_w")).select("doc", "page", "_w.*")
    parts = [flat(p, row), flat(pages, heads), flat(pages, foot), flat(pages, title), flat(pages, first), flat(pages.where("page = 5"), break_)]
    return reduce(DataFrame.unionByName, parts).where("text IS NOT NULL")


@query("SELECT DISTINCT p_partkey // 30 AS doc, p_partkey % 30 // 15 + 5 AS page FROM part")
def map_pages(spark: SparkSession, d: str) -> DataFrame:
    return extract.map_pages(_map_words(spark, d), "doc")


@query(
    with_parts(MAPS)
    + """SELECT doc, page, item, session, type, key, credits, standard, CASE WHEN old THEN 'ccls' ELSE 'nextgen' END AS era, coalesce(second, '') AS secondary, CASE WHEN doubled = 1 THEN 1 ELSE 0 END AS repairs, 'Ratios' AS domain_label, p_value, avg_points,
 CASE WHEN avg_points > credits THEN 'average' ELSE '' END AS wrong FROM tmap"""
)
def parsed_item_maps(spark: SparkSession, d: str) -> DataFrame:
    words = checkpointed(_map_words(spark, d))
    rows = extract.banded_rows(words, checkpointed(extract.header_bands(words, COLUMNS, "doc")), "doc")
    got = extract.parsed_items(rows, "doc")
    return got.select("doc", "page", "item", "session", "type", "key", "credits", "standard", "era", F.array_join("secondary", ",").alias("secondary"), F.size("repairs").alias("repairs"), "domain_label", "p_value", "avg_points", F.array_join("wrong", ",").alias("wrong"))


@query("SELECT DISTINCT p_partkey // 30 AS doc, p_partkey % 30 // 15 + 5 AS page, name, lo, hi FROM part, (VALUES ('Question', 0.0, 77.5), ('Type', 77.5, 147.5), ('Key', 147.5, 205.0), ('Points', 205.0, 265.0), ('Standard', 265.0, 340.0), ('Domain', 340.0, 420.0), ('Secondary', 420.0, 523.0), ('stats', 523.0, 10000.0)) v(name, lo, hi)")
def header_bands(spark: SparkSession, d: str) -> DataFrame:
    return extract.header_bands(_map_words(spark, d), COLUMNS, "doc").select("doc", "page", "name", "lo", "hi")


# --- booklets ------------------------------------------------------------------------------

BOOK = """book AS (SELECT p_partkey // 800 * 20 + p_partkey % 20 AS doc, CAST(p_partkey // 20 % 40 + 1 AS INTEGER) AS item, p_partkey // 20 % 40 // 2 + 3 AS page, CASE WHEN p_size % 4 = 0 THEN 'cr' ELSE 'mc' END AS type, p_size % 9 = 0 AS drawn, p_partkey // 20 % 40 % 2 AS half FROM part)"""


def _book(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_size")
    i = F.floor(k / 20) % 40
    return roles.table(spark, d, "part").select((F.floor(k / 800) * 20 + k % 20).alias("doc"), (i + 1).cast("int").alias("item"), (F.floor(i / 2) + 3).alias("page"), F.when(n % 4 == 0, "cr").otherwise("mc").alias("type"), (n % 9 == 0).alias("drawn"), (i % 2).alias("half"))


def _page_map(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Booklets, twenty of every 800 parts: two items a page, some numbers drawn, choices where an item has them."""
    b = _book(spark, d)
    y = F.lit(120) + F.col("half") * 300
    number = F.array(_word(45, y, F.when(~F.col("drawn"), F.col("item")), 6), _word(300, y, F.lit("12")))
    letters = F.array(*[_word(90, y + 40 + 20 * i, F.when(F.col("type") == "mc", x), 6) for i, x in enumerate("ABCD")], _word(90, y + 40, F.lit("A"), 6))
    flat = lambda words: b.select("doc", "page", F.explode(words).alias("_w")).select("doc", "page", "_w.*")
    words = flat(number).unionByName(flat(letters)).where("text IS NOT NULL")
    lines = b.select("doc", "page", F.lit(750.0).alias("y0"), F.concat(F.lit("Page "), F.col("page") - 2).alias("text")).where("page % 5 <> 0").distinct()
    listed = b.where("item % 13 <> 0").select("doc", "item", "type")
    return extract.page_map(words, lines, listed, b.where("page = 4").select("doc", "page").distinct(), "doc")


@query(with_parts(BOOK) + "SELECT DISTINCT doc, item, page, CASE WHEN page % 5 <> 0 THEN CAST(page - 2 AS INTEGER) END AS printed, false AS repeated FROM book WHERE NOT drawn AND page <> 4 AND item % 13 <> 0")
def located_items(spark: SparkSession, d: str) -> DataFrame:
    return _page_map(spark, d)["located"]


@query(with_parts(BOOK) + "SELECT doc, item, 'stray' AS status FROM book WHERE NOT drawn AND page <> 4 AND item % 13 = 0 UNION ALL SELECT doc, item, 'unlocated' FROM book WHERE item % 13 <> 0 AND (drawn OR page = 4)")
def page_map_gaps(spark: SparkSession, d: str) -> DataFrame:
    m = _page_map(spark, d)
    return m["stray"].withColumn("status", F.lit("stray")).unionByName(m["unlocated"].withColumn("status", F.lit("unlocated")))


@query(
    with_parts(BOOK, "l AS (SELECT doc, page, type FROM book WHERE NOT drawn AND page <> 4 AND item % 13 <> 0)", "c AS (SELECT DISTINCT doc, page FROM book WHERE type = 'mc' AND page <> 4)")
    + "SELECT doc, page, any_value(type) AS type, doc IN (SELECT c.doc FROM c WHERE c.doc = l.doc AND c.page = l.page) AS choices FROM l GROUP BY doc, page HAVING count(DISTINCT type) = 1 AND (any_value(type) = 'mc') <> (doc IN (SELECT c.doc FROM c WHERE c.doc = l.doc AND c.page = l.page))"
)
def type_disagreements(spark: SparkSession, d: str) -> DataFrame:
    return _page_map(spark, d)["type_disagreements"]


# --- charts ----------------------------------------------------------------------------------

#: Charts of ten parts: a merged cluster cell for every two or three codes, centred on them, between rules.
CHART = """chart AS (SELECT p_partkey // 10 AS doc, p_partkey % 10 AS i, 'NY-7.EE.' || p_partkey % 10 + 1 || 'a' AS code, CASE WHEN p_partkey % 10 < 3 THEN 0 WHEN p_partkey % 10 < 5 THEN 1 WHEN p_partkey % 10 < 8 THEN 2 ELSE 3 END AS cell, p_size % 3 = 0 AS marked, p_size % 4 = 0 AS noted, p_size FROM part)"""


def _chart(spark: SparkSession, d: str, ruled: bool) -> DataFrame:
    k = F.col("p_partkey")
    p = roles.table(spark, d, "part").select(F.floor(k / 10).alias("doc"), F.lit(1).alias("page"), (k % 10).alias("i"), F.col("p_size").alias("n"))
    cell = F.when(F.col("i") < 3, 0).when(F.col("i") < 5, 1).when(F.col("i") < 8, 2).otherwise(3)
    top = lambda c: F.element_at(F.array(*[F.lit(x) for x in (100.0, 154.0, 190.0, 244.0, 280.0)]), c + 1)
    p = p.withColumn("cell", cell)
    y = F.lit(102.0) + F.col("i") * 18
    left = lambda x, y, t: F.struct(F.lit(float(x)).alias("x0"), y.cast("double").alias("y0"), F.lit(float(x) + 30).alias("x1"), (y + 10).cast("double").alias("y1"), t.cast("string").alias("text"))
    note = F.when(F.col("n") % 4 == 0, "(Fluency),")
    second = F.when(F.col("n") % 5 == 0, F.concat(F.col("i") + 1, F.lit("b")))
    codes = F.array(left(364, y, F.concat(F.lit("NY-7.EE."), F.col("i") + 1, F.lit("a"), F.when(note.isNull(), ",").otherwise(""))), left(430, y, note), left(460, y, second), left(600, y + 6, F.when(F.col("n") % 3 == 0, "X")))
    cells = p.select("doc", "page", "cell").distinct()
    middle = (top(F.col("cell")) + top(F.col("cell") + 1)) / 2
    lines = F.array(left(200, middle - 10, F.concat(F.lit("Cluster "), F.col("cell"))), left(200, middle + 4, F.lit("is wrapped.")))
    pages = p.select("doc", "page").distinct()
    heads = F.array(left(60, F.lit(80), F.lit("Domain")), left(200, F.lit(80), F.lit("Cluster")), left(393, F.lit(80), F.lit("Standard(s)")), left(60, F.lit(180), F.lit("Equations")))
    flat = lambda df, words: df.select("doc", "page", F.explode(words).alias("_w")).select("doc", "page", "_w.*").where("text IS NOT NULL")
    words = reduce(DataFrame.unionByName, [flat(p, codes), flat(cells, lines), flat(pages, heads)])
    edges = cells.select("doc", "page", F.explode(F.array(top(F.col("cell")), top(F.col("cell") + 1))).alias("y")).distinct()
    rules = edges.select("doc", "page", F.lit(190.0).alias("x0"), F.col("y").alias("y0"), F.lit(340.0).alias("x1"), (F.col("y") + 1.0).alias("y1"))
    return extract.chart(words, rules if ruled else rules.limit(0), "doc")


_CHART_SQL = """SELECT doc, code, note, cluster_text, domain_name, marked FROM (
 SELECT doc, code, CASE WHEN noted THEN 'Fluency' END AS note, 'Cluster ' || cell || ' is wrapped.' AS cluster_text, 'Equations' AS domain_name, marked FROM chart
 UNION ALL SELECT doc, left(code, length(code) - 1) || 'b', NULL, 'Cluster ' || cell || ' is wrapped.', 'Equations', marked FROM chart WHERE p_size % 5 = 0)"""


@query(with_parts(CHART) + _CHART_SQL)
def ruled_chart(spark: SparkSession, d: str) -> DataFrame:
    return _chart(spark, d, True).select("doc", "code", "note", "cluster_text", "domain_name", "marked")


@query(with_parts(CHART, "whole AS (SELECT doc FROM chart GROUP BY doc HAVING count(*) = 10)") + f"SELECT * FROM ({_CHART_SQL}) WHERE doc IN (SELECT doc FROM whole)")
def unruled_chart(spark: SparkSession, d: str) -> DataFrame:
    """Cells found by where their text stands, on the pages that have all of them."""
    got = _chart(spark, d, False).select("doc", "code", "note", "cluster_text", "domain_name", "marked")
    whole = roles.table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 10).alias("doc")).agg(F.count("*").alias("_n")).where("_n = 10").select("doc")
    return got.join(whole, "doc")


@query(
    """WITH s AS (SELECT s_suppkey AS k, 'NY-7.' || ['RP', 'NS', 'EE'][s_suppkey % 3 + 1] || '.' || s_suppkey % 9 || CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE '' END AS code, s_nationkey AS doc, s_name AS a, s_suppkey % 4 AS more FROM supplier)
SELECT doc, code, a || CASE WHEN more > 0 THEN ' wraps ' || more ELSE '' END AS text FROM s QUALIFY row_number() OVER (PARTITION BY doc, code ORDER BY k) = 1"""
)
def standard_wording(spark: SparkSession, d: str) -> DataFrame:
    """Wordings that wrap, between running heads and page numbers; sub-letters printed with a dot."""
    k = F.col("s_suppkey")
    stem = F.concat(F.lit("NY-7."), F.element_at(F.array(F.lit("RP"), F.lit("NS"), F.lit("EE")), (k % 3 + 1).cast("int")), F.lit("."), k % 9, F.when(k % 2 == 0, ".a").otherwise(""))
    lines = F.array(F.lit("Grade 7 Teacher Course Guide"), F.lit("12"), F.lit("The Standards"), F.concat(stem, F.lit(" "), "s_name"), F.when(k % 4 > 0, F.concat(F.lit("wraps "), k % 4)))
    rows = roles.table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc"), F.lit(3).alias("page"), k.alias("_k"), F.posexplode(lines).alias("_p", "text")).where("text IS NOT NULL").withColumn("y", (F.col("_k") * 10 + F.col("_p")).cast("double"))
    return extract.statements(rows.drop("_k", "_p"), rows.select("doc", "page").distinct(), "The Standards", "doc")


@query(
    with_parts(
        "marks AS (SELECT DISTINCT o_custkey % 200 AS doc, o_orderkey % 400 AS page FROM orders)",
        "steps AS (SELECT doc, page, CASE WHEN page - lag(page) OVER (PARTITION BY doc ORDER BY page) > 2 THEN 1 ELSE 0 END AS new FROM marks)",
        "isl AS (SELECT doc, page, sum(new) OVER (PARTITION BY doc ORDER BY page) AS island FROM steps)",
        "best AS (SELECT doc, island FROM isl GROUP BY doc, island QUALIFY row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, island) = 1)",
    )
    + "SELECT doc, page FROM isl JOIN best USING (doc, island)"
)
def section_pages(spark: SparkSession, d: str) -> DataFrame:
    o = roles.table(spark, d, "orders").select((F.col("o_custkey") % 200).alias("doc"), (F.col("o_orderkey") % 400).alias("page"), F.lit("x The Standards").alias("text"))
    other = o.select("doc", (F.col("page") + 1000).alias("page"), F.lit("Another").alias("text"))
    return extract.section_pages(o.unionByName(other), "The Standards", "doc")


# --- pacing ------------------------------------------------------------------------------------

PACE = """pace AS (SELECT s_suppkey // 27 AS doc, s_suppkey % 3 + 6 AS grade, CAST(s_suppkey % 27 // 3 + 1 AS INTEGER) AS unit, s_suppkey AS k, s_name AS name FROM supplier)"""


@query(
    with_parts(PACE)
    + """SELECT doc, grade, unit, name || CASE WHEN k % 2 = 0 THEN ' goes on' ELSE '' END AS title, CAST(10 + k % 5 AS INTEGER) AS days_lo, CAST(CASE WHEN k % 3 = 0 THEN 10 + k % 5 ELSE 15 + k % 5 END AS INTEGER) AS days_hi, k % 4 = 0 AS mid_unit_assessment, k % 6 = 0 AS all_optional,
 CASE WHEN k % 6 = 0 OR k % 6 = 1 THEN '' ELSE (k % 7) || ',' || (k % 7 + 2) END AS optional_lessons, CAST(unit * 3 - 2 AS INTEGER) AS start_week FROM pace"""
)
def pacing_units(spark: SparkSession, d: str) -> DataFrame:
    """Plans of nine units and three grades, one of every 27 suppliers."""
    k = F.col("s_suppkey")
    s = roles.table(spark, d, "supplier").withColumns({"doc": F.floor(k / 27), "grade": k % 3 + 6, "unit": (F.floor(k % 27 / 3) + 1).cast("int")})
    days = F.concat(F.lit("("), k % 5 + 10, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("–"), k % 5 + 15)), F.lit(" days)"), F.when(k % 4 == 0, " (MA)").otherwise(""))
    some = F.when(k % 6 == 0, "all.").when(k % 6 == 1, "none").otherwise(F.concat(k % 7, F.lit(", "), k % 7 + 2))
    lines = F.array(F.concat(F.lit("Unit "), "unit"), F.when(k % 2 == 0, F.col("s_name")).otherwise(F.concat("s_name", F.lit("."))), F.when(k % 2 == 0, "goes  on."), days, F.concat(F.lit("Optional Lessons: "), some))
    rows = s.select("doc", "grade", "unit", F.posexplode(lines).alias("_p", "text")).where("text IS NOT NULL").select("doc", "grade", (F.col("unit") * 60.0 + F.col("_p") * 9).alias("y"), "text")
    weeks = spark.range(1, 36).select(F.col("id").cast("int").alias("week"), (F.col("id") * 20.0 + 41).alias("y")).crossJoin(F.broadcast(spark.createDataFrame([(g,) for g in (6, 7, 8)], "grade long")))  # 35 labels, three grades
    got = extract.pacing_units(rows, weeks, "doc", "grade")
    return got.withColumn("optional_lessons", F.array_join("optional_lessons", ","))


# --- lesson pages ---------------------------------------------------------------------------------


@query(
    """WITH t AS (SELECT c.conv_id AS page, c.turn, c.role, c.text FROM conversations c)
SELECT page, md5(coalesce(string_agg(CASE WHEN role = 'user' THEN x END, ' ' ORDER BY turn), '')) AS prompt, md5(coalesce(string_agg(CASE WHEN role <> 'user' THEN x END, ' ' ORDER BY turn), '')) AS answer
FROM (SELECT *, trim(regexp_replace('Sample ' || turn || ' ' || left(text, 0), '\\s+', ' ', 'g')) AS x FROM t) GROUP BY page"""
)
def prompts_and_answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns as lines: a user's is closed by a list marker's font, another one's opens an answer."""
    c = roles.table(spark, d, "conversations")
    user = F.col("role") == "user"
    marker = F.struct(F.lit(20.0).alias("x"), F.lit(30.0).alias("x1"), F.lit("Hellix-Bold").alias("font"), F.when(user, "a.").alias("text"))
    word = F.struct(F.lit(40.0).alias("x"), F.lit(80.0).alias("x1"), F.when(user, "Hellix").otherwise("Hellix-SemiBold").alias("font"), F.lit("Sample").alias("text"))
    number = F.struct(F.lit(90.0).alias("x"), F.lit(99.0).alias("x1"), F.lit("Hellix").alias("font"), F.col("turn").cast("string").alias("text"))
    spans = c.select(F.col("conv_id").alias("page"), (F.col("turn") * 20.0).alias("y"), F.lit(11.0).alias("size"), F.explode(F.array(marker, word, number)).alias("_s")).select("page", "y", "size", "_s.*").where("text IS NOT NULL")
    said = extract.prompts_and_answers(spans, "page").where("text <> 'a.'")
    texts = extract.prose(said, "page", "answer")
    got = texts.groupBy("page").agg(F.max(F.when(~F.col("answer"), F.col("text"))).alias("p"), F.max(F.when(F.col("answer"), F.col("text"))).alias("a"))
    return got.select("page", F.md5(F.coalesce("p", F.lit(""))).alias("prompt"), F.md5(F.coalesce("a", F.lit(""))).alias("answer"))


@query("SELECT o_custkey AS doc, lesson, page, section, section_title FROM (SELECT o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey AS INTEGER) END AS lesson, o_orderkey AS page, last_value(CASE WHEN o_orderkey % 4 = 0 THEN chr(CAST(65 + o_orderkey % 6 AS INTEGER)) END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END IGNORE NULLS) OVER w AS section_title FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)) WHERE lesson IS NOT NULL")
def outline_lessons(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("Section "), F.char(k % 6 + 65), F.lit(": "), "o_orderpriority")).otherwise(F.concat(F.lit("Lesson "), k))
    o = roles.table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), k.alias("pos"), title.alias("title"), k.alias("page"))
    return extract.outline_lessons(o, "doc")


# --- glyphs, points, titles --------------------------------------------------------------------------


@query(
    """WITH c AS (SELECT 'L' || n_nationkey AS label, n_regionkey AS bucket, n_nationkey * 1.0::DOUBLE AS a, n_regionkey * 2.0::DOUBLE AS b FROM nation), s AS (SELECT c_custkey AS id, c_custkey % 7 AS bucket, c_custkey % 26 + 0.25::DOUBLE AS a, c_custkey % 9 * 1.0::DOUBLE AS b FROM customer),
d AS (SELECT id, label, (abs(s.a - c.a) + abs(s.b - c.b)) / 2 AS distance, s.bucket = c.bucket AS own FROM s, c), n AS (SELECT * FROM d WHERE distance <= 2), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY own DESC, distance, label) AS r FROM n)
SELECT id AS shape_id, label, distance FROM best WHERE r = 1"""
)
def shape_labels(spark: SparkSession, d: str) -> DataFrame:
    n, k = roles.table(spark, d, "nation"), F.col("c_custkey")
    clusters = n.select(F.concat(F.lit("L"), "n_nationkey").alias("label"), F.col("n_regionkey").cast("long").alias("bucket"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey") * 2.0).alias("points"))
    shapes = roles.table(spark, d, "customer").select(k.alias("shape_id"), (k % 7).alias("bucket"), F.array(k % 26 + 0.25, (k % 9).cast("double")).alias("points"))
    return agreement.shape_labels(shapes, clusters, 2.0)


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'same' WHEN 2 THEN 'differs' ELSE 'not drawn' END AS status FROM customer")
def verified_points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    x, y = (k % 9).cast("string"), (k % 5).cast("string")
    text = F.concat(F.lit("A is at ("), x, F.lit(", negative "), y, F.lit(") and B at (2.5, "), x, F.lit(")"))
    c = roles.table(spark, d, "customer").select(k.alias("id"), text.alias("text"))
    stated = c.select("id", scalars.coordinates(F.col("text")).alias("points"))
    at = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    i = F.col("id")
    scale = F.when(i % 4 == 1, 2.0).otherwise(1.0)
    drawn = c.where(i % 4 != 3).select("id", F.array(at(F.lit(2.5) * scale, i % 9 * scale), at(i % 9 * scale, -(i % 5) * scale + F.when(i % 4 == 2, 1).otherwise(0))).alias("points"))
    return expressions.verified_points(stated, drawn, "id")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE floor((c_custkey % 7 + 1.5) / 4 * 1000 + 0.5) / 1000 END AS distance FROM customer")
def mean_distances(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    at = lambda a, b: F.struct(F.lit(a).cast("double").alias("x") if not isinstance(a, Column) else a.cast("double").alias("x"), F.lit(b).cast("double").alias("y"))
    a = F.array(at(0, 0), at(1, 1))
    b = F.when(k % 3 == 0, F.array(at(0, 0))).otherwise(F.array(at(k % 7, 0), at(1, 2.5)))
    return roles.table(spark, d, "customer").select(k.alias("id"), scalars.half_up(scalars.mean_distance(a, b)).alias("distance"))


@query("SELECT p_partkey AS item, 'B C of ' || p_brand AS clean, 'ffi fl ' || p_name AS plain, 'Building ' || p_name AS kerned, 'a&amp;b &lt;' || p_brand || '&gt; &quot;' AS safe, '12' AS bare, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey AS VARCHAR) AS code FROM part")
def text_repairs(spark: SparkSession, d: str) -> DataFrame:
    brand, name = F.col("p_brand"), F.col("p_name")
    return roles.table(spark, d, "part").select(
        F.col("p_partkey").alias("item"), scalars.clean_text(F.concat(F.lit("​B C of "), brand, F.lit("﻿"))).alias("clean"), scalars.unligated(F.concat(F.lit("ﬃ ﬂ "), name)).alias("plain"),
        scalars.unkerned(F.concat(F.lit("B uilding "), name)).alias("kerned"), scalars.escaped(F.concat(F.lit("a&b <"), brand, F.lit('> "'))).alias("safe"), scalars.squashed(F.lit(" 1 \n2 ")).alias("bare"),
        F.array_join(F.transform(scalars.numeric_order(F.concat("p_size", F.lit("."), "p_partkey")), lambda x: x.cast("string")), ".").alias("code"),
    )


@query(f"SELECT p_partkey AS item, 'http://x/' || p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE '#page=' || p_size END AS link, CASE WHEN p_size >= 23 THEN 'new/' || p_size ELSE 'old-' || p_size END AS address, 't' || p_size || '-' || lpad(CAST(p_partkey % 900 AS VARCHAR), 3, '0') AS id FROM part")
def source_links(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    return roles.table(spark, d, "part").select(
        F.col("p_partkey").alias("item"), tables.page_link(F.concat(F.lit("http://x/"), "p_brand"), F.when(n % 3 != 0, n)).alias("link"),
        tables.by_year(n, 23, "new/%d", "old-%d", n).alias("address"), build.item_id(F.concat(F.lit("t"), n), F.col("p_partkey") % 900).alias("id"),
    )


@query("SELECT page_id, greatest(0, 0) = 0 AS checked, sum(depth) = 0 AND min(low) >= 0 AS balanced FROM (SELECT page_id, v AS depth, sum(v) OVER (PARTITION BY page_id ORDER BY i) AS low FROM (SELECT page_id, i, CASE WHEN starts_with(t, '</') THEN -1 WHEN ends_with(t, '/>') THEN CASE WHEN n IN ('br', 'img', 'hr', 'input', 'meta', 'link') THEN -1 ELSE 0 END WHEN n IN ('br', 'img', 'hr', 'input', 'meta', 'link') THEN 0 ELSE 1 END AS v FROM (SELECT page_id, t, i, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS n FROM (SELECT page_id, unnest(x) AS t, unnest(range(len(x))) AS i FROM (SELECT page_id, list_append(regexp_extract_all(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '</?[a-zA-Z][^>]*>'), '<br>') AS x FROM pages))))) GROUP BY page_id")
def balanced_pages(spark: SparkSession, d: str) -> DataFrame:
    return roles.table(spark, d, "pages").select("page_id", F.lit(True).alias("checked"), expressions.balanced(F.col("html")).alias("balanced"))


@query(
    "WITH u AS (SELECT DISTINCT p_size % 12 AS unit, CASE WHEN p_size % 12 <> 5 THEN 'T' || p_size % 12 END AS title FROM part) SELECT unit, CASE WHEN unit = 0 THEN 'Not in this grade''s units' ELSE 'Unit ' || unit || coalesce(' · ' || title, '') || CASE WHEN unit = 9 THEN ' (review unit — matches broadly)' ELSE '' END END AS label, unit BETWEEN 6 AND 8 AS late, unit = 9 OR unit % 4 = 1 AS optional FROM u"
)
def unit_labels(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") % 12
    u = roles.table(spark, d, "part").select(n.cast("int").alias("unit"), F.when(n != 5, F.concat(F.lit("T"), n)).alias("title")).distinct()
    whole = F.col("unit") == 9
    late = curriculum.late_units(u.select("unit", (F.col("unit") * 4 - 3).alias("start_week"))).select("unit", F.lit(True).alias("late"))
    label = curriculum.unit_label(F.when(F.col("unit") != 0, F.col("unit")), F.col("title"), whole)
    return u.join(F.broadcast(late), "unit", "left").select("unit", label.alias("label"), F.coalesce("late", F.lit(False)).alias("late"), curriculum.optional_flag(F.col("unit") % 4, whole, F.array(F.lit(1))).alias("optional"))


@query(f"SELECT s_suppkey AS k, string_agg(DISTINCT 'Unit ' || u || CASE WHEN u % 2 = 0 THEN ' (week ' || u * 3 || ')' ELSE '' END, ', ' ORDER BY 'Unit ' || u || CASE WHEN u % 2 = 0 THEN ' (week ' || u * 3 || ')' ELSE '' END) AS units FROM (SELECT l_suppkey AS s_suppkey, l_linenumber AS u FROM lineitem) GROUP BY 1")
def unit_cells(spark: SparkSession, d: str) -> DataFrame:
    p = roles.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("unit"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 3).alias("start_week"))
    return curriculum.unit_cells(p, "k")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 10 BETWEEN 6 AND 8 THEN p_size % 10 ELSE 6 + p_partkey % 3 END AS grade FROM part")
def home_grades(spark: SparkSession, d: str) -> DataFrame:
    """Codes of ten grades, three of them taught; some name none."""
    k, n = F.col("p_partkey"), F.col("p_size") % 10
    code = F.when(n == 0, "MP.4").otherwise(F.concat(F.lit("NY-"), n, F.lit(".NBT.4")))
    return roles.table(spark, d, "part").select(k.alias("id"), checks.home_grade(code, (k % 3 + 6).cast("int")).cast("long").alias("grade"))


@query("""WITH lines AS (SELECT doc_id AS doc, unnest(p) AS t, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
found AS (SELECT DISTINCT doc, i // 5 + 1 AS page FROM lines WHERE length(t) % 10 = 7), counts AS (SELECT doc, max(i) // 5 + 1 AS n FROM lines GROUP BY doc)
SELECT doc, CAST(page AS INTEGER) AS page FROM found UNION ALL SELECT doc, CAST(unnest(range(1, n + 1)) AS INTEGER) FROM counts WHERE doc NOT IN (SELECT doc FROM found)""")
def item_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of five lines; lines of some lengths hold items, and documents without any are read whole."""
    docs = roles.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda t: F.length(t)).alias("n"))
    lines = checkpointed(docs.select("doc", F.posexplode("n").alias("i", "n")))
    counts = lines.groupBy("doc").agg((F.floor(F.max("i") / 5) + 1).alias("page_count"))
    located = lines.where("n % 10 = 7").select("doc", (F.floor(F.col("i") / 5) + 1).alias("page"))
    return extract.item_pages(located, counts, "doc")


@query("""WITH i AS (SELECT p_partkey AS id, 6 + p_partkey % 3 AS grade, 2020 + p_size % 5 AS year, p_size AS item, 5 + p_partkey % 4 AS home FROM part)
SELECT id, grade, CAST(home AS INTEGER) AS from_grade, CAST(row_number() OVER (PARTITION BY grade ORDER BY year, item, id) AS INTEGER) AS place FROM i WHERE home < grade""")
def post_test_view(spark: SparkSession, d: str) -> DataFrame:
    """Items on standards of the grade below, or of an earlier one, in the order that a grade's page lists them."""
    k, n = F.col("p_partkey"), F.col("p_size")
    items = roles.table(spark, d, "part").select(k.alias("id"), (k % 3 + 6).alias("grade"), (n % 5 + 2020).alias("year"), n.alias("item"), F.concat(F.lit("NY-"), k % 4 + 5, F.lit(".RP."), n).alias("standard"), (k % 4 + 5 < k % 3 + 6).alias("post_test"))
    return curriculum.post_test_items(items).select("id", "grade", "from_grade", "place")
