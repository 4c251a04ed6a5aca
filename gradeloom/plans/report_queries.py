"""Queries: sheets parsed, identified and analysed in one call, table by table."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import analysis, report, responses
from gradeloom.plans import sheets
from gradeloom.plans.registry import query, r3, with_parts
from gradeloom.plans.sheets import CURRICULUM, SHEET_BASE, SHEET_ITEMS

THRESHOLD = analysis.GATING_THRESHOLD
PATH = "format('n{:02d}.xlsx', n) AS path"
BASE = with_parts(SHEET_ITEMS, SHEET_BASE)


@lru_cache(maxsize=4)
def _report(session: str, d: str, written: str) -> report.Report:
    spark = SparkSession.active()
    return report.run(sheets.cells(spark, d), sheets.data(spark), threshold=THRESHOLD)


def _run(spark: SparkSession, d: str) -> report.Report:
    """One report for the queries that show its tables, as long as the table isn't written anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/customer.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = f"{fs.getFileStatus(path).getModificationTime()} {fs.getContentSummary(path).getLength()}"
    return _report(spark.sparkContext.applicationId, d, written)


def _table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return _run(spark, d)[name].select("path", *columns)


@query(BASE + f"SELECT {PATH}, CAST(s + 4 AS INTEGER) AS student, q AS question, value FROM present")
def sheet_responses(spark: SparkSession, d: str) -> DataFrame:
    return responses.parse(sheets.cells(spark, d)).responses.select("path", "student", "question", "value")


@query(BASE + f"SELECT {PATH}, CAST(s + 4 AS INTEGER) AS student, section, floor(level * 100 + 0.5) / 100 AS level FROM sstudents")
def sheet_students(spark: SparkSession, d: str) -> DataFrame:
    return responses.parse(sheets.cells(spark, d)).students.select("path", "student", "section", "level")


MATCHED = """asked AS (SELECT n, q, i.standard AS code FROM (SELECT DISTINCT c_nationkey AS n FROM customer) c, (SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS q)
  JOIN sitems i ON i.test = 't' || n % 7 AND i.item = CASE WHEN n % 8 = 7 THEN q % 14 + 1 ELSE q END WHERE n <> 11),
tscore AS (SELECT n, test, count(*) FILTER (WHERE standard = code) AS agree, count(*) AS published FROM asked JOIN sitems ON item = q GROUP BY n, test),
tranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY agree DESC, test) AS r, coalesce(lead(agree) OVER (PARTITION BY n ORDER BY agree DESC, test), 0) AS runner_up FROM tscore),
matched AS (SELECT n, test, agree, published, CAST(14 AS BIGINT) AS total, 14 - published AS unreleased, runner_up, agree >= 10 AND agree * 5 >= published * 4 AND agree >= runner_up * 2 AS accepted FROM tranked WHERE r = 1)"""


@query(with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED) + f"SELECT {PATH}, test, agree, published, total, unreleased, runner_up, accepted FROM matched")
def report_identify(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "identify", "test", "agree", "published", "total", "unreleased", "runner_up", "accepted")


STATS = f"""roster AS (SELECT n, count(*) AS students FROM sstudents GROUP BY n),
known AS (SELECT m.n, i.*, students FROM matched m JOIN sitems i USING (test) JOIN roster USING (n) WHERE accepted),
marks AS (SELECT p.n, p.s, p.q AS item, k.standard, k.type, k.credits, k.key, p.value, CAST(p.points AS DOUBLE) AS points, section, level,
    k.type = 'mc' OR p.value <> 'x' AS answered FROM present p JOIN known k ON k.n = p.n AND k.item = p.q JOIN sstudents t ON t.n = p.n AND t.s = p.s),
wrongs AS (SELECT n, item, value AS letter, count(*) AS c, min(s) AS first FROM marks WHERE type = 'mc' AND value <> key GROUP BY ALL),
tops AS (SELECT n, item, letter, c FROM wrongs QUALIFY row_number() OVER (PARTITION BY n, item ORDER BY c DESC, first) = 1),
stats AS (
  SELECT k.n, k.item, k.standard, k.domain, k.type, k.credits, k.students, k.unit, k.lesson, k.grade, k.placed, k.post_test,
         coalesce(m.answered, 0) AS answered, coalesce(m.earned, 0.0) AS earned, coalesce(m.correct, 0) AS correct, coalesce(m.full_credit, 0) AS full_credit, coalesce(m.zero_credit, 0) AS zero_credit,
         {r3('coalesce(m.earned, 0.0) / (k.credits * k.students)')} AS class_p,
         {r3("CASE WHEN k.type = 'mc' THEN k.p_value ELSE coalesce(k.avg_points / k.credits, k.p_value) END")} AS state_p,
         {r3("coalesce(m.earned, 0.0) / (k.credits * k.students) - CASE WHEN k.type = 'mc' THEN k.p_value ELSE coalesce(k.avg_points / k.credits, k.p_value) END")} AS gap,
         t.letter AS top_wrong, coalesce(t.c, 0) AS top_wrong_count
  FROM known k LEFT JOIN (
    SELECT n, item, count(*) FILTER (WHERE answered) AS answered, sum(points) AS earned, count(*) FILTER (WHERE type = 'mc' AND value = key) AS correct,
           count(*) FILTER (WHERE type = 'cr' AND answered AND points >= credits) AS full_credit, count(*) FILTER (WHERE type = 'cr' AND answered AND points = 0) AS zero_credit
    FROM marks GROUP BY n, item) m USING (n, item) LEFT JOIN tops t USING (n, item)),
sums AS (SELECT *, CAST(credits * students AS BIGINT) AS possible, CAST(floor(coalesce(state_p, 0) * 1000 + 0.5) AS BIGINT) * credits * students AS st FROM stats)"""
ANALYSED = with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS)


@query(ANALYSED + f"SELECT {PATH}, item, standard, type, CAST(credits AS INTEGER) AS credits, students AS n, answered, students - answered AS omitted, earned, correct, full_credit, zero_credit, class_p, state_p, gap, top_wrong, top_wrong_count FROM stats")
def report_items(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "items", "item", "standard", "type", "credits", "n", "answered", "omitted", "earned", "correct", "full_credit", "zero_credit", "class_p", "state_p", "gap", "top_wrong", "top_wrong_count")


@query(ANALYSED + f"SELECT {PATH}, item, omitted, row_number() OVER (PARTITION BY n ORDER BY omitted DESC, item) AS place FROM (SELECT *, students - answered AS omitted FROM stats) WHERE omitted > 0")
def report_omissions(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("path").orderBy(F.col("omitted").desc(), "item"))
    return _table(spark, d, "omissions", "item", "omitted").withColumn("place", place)


@query(ANALYSED + f"SELECT {PATH}, item, top_wrong, top_wrong_count FROM stats WHERE type = 'mc' AND top_wrong_count * 4 >= students")
def report_dominant(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "dominant", "item", "top_wrong", "top_wrong_count")


RATES = f"sum(earned) AS earned, CAST(sum(possible) AS BIGINT) AS possible, {r3('sum(earned) / sum(possible)')} AS class_p, {r3('sum(st) / 1000 / sum(possible)')} AS state_p"


@query(ANALYSED + f"SELECT {PATH}, count(*) AS matched, max(students) AS students, CAST(sum(credits) AS BIGINT) AS total_credits, {RATES}, {r3('sum(earned) / sum(possible) - sum(st) / 1000 / sum(possible)')} AS gap FROM sums GROUP BY n")
def report_overall(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "overall", "matched", "students", "total_credits", "earned", "possible", "class_p", "state_p", "gap")


@query(ANALYSED + f"SELECT path, standard, items, earned, possible, class_p, state_p, {r3('class_p - state_p')} AS gap FROM (SELECT {PATH}, standard, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items, {RATES} FROM sums GROUP BY n, standard)")
def report_standards(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)["by_standard"].select("path", "standard", F.array_join("items", ",").alias("items"), "earned", "possible", "class_p", "state_p", "gap")


SECTION_SQL = f"""rosters AS (SELECT n, section, count(*) AS students FROM sstudents WHERE section IS NOT NULL GROUP BY ALL),
several AS (SELECT n FROM rosters GROUP BY n HAVING count(*) > 1),
scells AS (SELECT k.n, r.section, r.students, k.item, k.credits * r.students AS p, coalesce(sum(m.points), 0.0) AS e
  FROM known k JOIN rosters r ON r.n = k.n JOIN several v ON v.n = k.n LEFT JOIN marks m ON m.n = k.n AND m.item = k.item AND m.section = r.section GROUP BY ALL)"""


@query(with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, SECTION_SQL) + f"SELECT {PATH}, section, students, {r3('sum(e) / sum(p)')} AS class_p FROM scells GROUP BY n, section, students")
def report_sections(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "sections", "section", "students", "class_p")


@query(with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, SECTION_SQL) + f"SELECT {PATH}, section, item, {r3('e / p')} AS class_p FROM scells")
def report_section_items(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "section_items", "section", "item", "class_p")


CURVES = """spoints AS (SELECT t.n, CAST(raw AS DOUBLE) AS raw, CAST(min_by(round(level, 2), s) AS DOUBLE) AS level, count(*) FILTER (WHERE true) AS c FROM sstudents t JOIN (SELECT n FROM matched WHERE accepted) USING (n) WHERE level IS NOT NULL GROUP BY t.n, raw),
clash AS (SELECT t.n, count(*) AS same FROM sstudents t JOIN spoints p ON p.n = t.n AND p.raw = t.raw WHERE abs(round(t.level, 2) - p.level) > 0.005 GROUP BY t.n),
psteps AS (SELECT *, lead(raw) OVER (PARTITION BY n ORDER BY raw) AS raw2, lead(level) OVER (PARTITION BY n ORDER BY raw) AS level2 FROM spoints),
falls AS (SELECT n, count(*) AS points, count(*) FILTER (WHERE level2 <= level) AS falls FROM psteps GROUP BY n),
cstatus AS (SELECT m.n, CASE WHEN m.n = 20 THEN 'no level column' WHEN coalesce(points, 0) < 6 THEN 'too few distinct raw scores (' || coalesce(points, 0) || ')'
   WHEN coalesce(same, 0) + falls > 0 THEN 'the level is not a function of the raw score (' || (coalesce(same, 0) + falls) || ' conflicts)' END AS why FROM matched m LEFT JOIN falls USING (n) LEFT JOIN clash USING (n) WHERE accepted)"""
BANDED = """sband AS (SELECT n, s, CASE WHEN level < 2 THEN 'L1' WHEN level < 3 THEN 'L2' WHEN level < 4 THEN 'L3' ELSE 'L4' END AS band FROM sstudents WHERE level IS NOT NULL),
bsize AS (SELECT n, count(*) FILTER (WHERE band = 'L1') AS b1, count(*) FILTER (WHERE band = 'L2') AS b2, count(*) FILTER (WHERE band = 'L3') AS b3, count(*) FILTER (WHERE band = 'L4') AS b4 FROM sband GROUP BY n),
gstatus AS (SELECT m.n, CASE WHEN m.n = 20 THEN 'no level column' WHEN coalesce(b1 + b2 + b3 + b4, 0) < 20 THEN 'not enough students with a level to band'
   WHEN least(b1, b2, b3, b4) < 5 THEN 'too few students in ' || concat_ws(', ', CASE WHEN b1 < 5 THEN 'L1' END, CASE WHEN b2 < 5 THEN 'L2' END, CASE WHEN b3 < 5 THEN 'L3' END, CASE WHEN b4 < 5 THEN 'L4' END) END AS why FROM matched m LEFT JOIN bsize USING (n) WHERE accepted)"""


@query(with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, CURVES) + f"SELECT {PATH}, raw, level FROM spoints JOIN cstatus USING (n) WHERE why IS NULL")
def report_curve(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "curve", "raw", "level")


@query(
    with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, CURVES, "cuts AS (SELECT CAST(unnest([2, 3, 4]) AS DOUBLE) AS cut)")
    + f"""SELECT path, level, raw, exact, below, floor(raw / 18.0 * 1000 + 0.5) / 10 AS pct_of_test FROM (
SELECT {PATH}, cut AS level, CASE WHEN here IS NOT NULL THEN here WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi END AS raw, here IS NOT NULL AS exact, CASE WHEN here IS NULL AND lo IS NOT NULL AND hi IS NOT NULL THEN lo END AS below
FROM (SELECT n, cut, min(raw) FILTER (WHERE abs(level - cut) < 0.005) AS here, max(raw) FILTER (WHERE level < cut) AS lo, min(raw) FILTER (WHERE level > cut) AS hi FROM spoints JOIN cstatus USING (n), cuts WHERE why IS NULL GROUP BY n, cut))"""
)
def report_cuts(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "curve_cuts", "level", "raw", "exact", "below", "pct_of_test")


@query(with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, CURVES) + f"SELECT {PATH}, raw FROM (SELECT n, unnest(range(CAST(min(raw) AS BIGINT), 19)) AS raw FROM spoints JOIN cstatus USING (n) WHERE why IS NULL GROUP BY n) g WHERE NOT EXISTS (SELECT 1 FROM spoints p WHERE p.n = g.n AND p.raw = g.raw)")
def report_unobserved(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "unobserved", "raw")


_BUCKET = f"""CASE WHEN least(L1, L2, L3, L4) >= {THRESHOLD} THEN 'solid' WHEN greatest(L1, L2, L3, L4) < {THRESHOLD} THEN 'weak-for-all' WHEN L2 >= {THRESHOLD} AND L1 < {THRESHOLD} THEN 'gates-L1-L2'
 WHEN L3 >= {THRESHOLD} AND L2 < {THRESHOLD} THEN 'gates-L2-L3' WHEN L4 >= {THRESHOLD} AND L3 < {THRESHOLD} THEN 'gates-L3-L4' ELSE 'mixed' END"""
_BANDS = ", ".join(
    f"floor(coalesce((SELECT sum(points) FROM marks m JOIN sband USING (n, s) WHERE m.n = w.n AND m.standard = w.standard AND band = 'L{i}'), 0) / (w.credits * b{i}) * 1000 + 0.5) / 1000 AS L{i}" for i in (1, 2, 3, 4)
)
GATED = f"""weights AS (SELECT n, standard, CAST(sum(credits) AS BIGINT) AS credits FROM known GROUP BY n, standard),
gates AS (SELECT *, {_BUCKET} AS bucket FROM (SELECT w.n, w.standard, w.credits, {_BANDS} FROM weights w JOIN gstatus g ON g.n = w.n AND g.why IS NULL JOIN bsize b ON b.n = w.n))"""
GATE_PARTS = (SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, BANDED, GATED)


@query(with_parts(*GATE_PARTS) + f"SELECT {PATH}, standard, credits, L1, L2, L3, L4, bucket FROM gates")
def report_gating(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "gating", "standard", "credits", "L1", "L2", "L3", "L4", "bucket")


FOCUSED = f"""fyears AS (SELECT grade, count(DISTINCT year) AS years FROM sitems GROUP BY grade),
fweights AS (SELECT grade, standard, sum(credits) AS w, count(DISTINCT year) AS recurs FROM sitems GROUP BY grade, standard),
focus AS (
  SELECT n, standard, {r3('gap', 3)} AS gap, {r3('w / years', 2)} AS credits_per_year, recurs, years AS of_years, CASE WHEN gap < 0 THEN {r3('-gap * (w / years)', 2)} ELSE 0.0 END AS credits_lost
  FROM (SELECT n, grade, standard, sum(earned) / sum(possible) - sum(st) / 1000 / sum(possible) AS gap FROM sums GROUP BY ALL) JOIN fyears USING (grade) JOIN fweights USING (grade, standard))"""


@query(with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, FOCUSED) + f"SELECT {PATH}, standard, gap, credits_per_year, recurs, of_years, credits_lost FROM focus")
def report_focus(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "focus", "standard", "gap", "credits_per_year", "recurs", "of_years", "credits_lost")


@query(
    with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, FOCUSED)
    + f"""SELECT path, unit, lesson, items, {r3('gap')} AS gap, w AS credits_per_year, CASE WHEN gap < 0 THEN {r3('-gap * w', 2)} ELSE 0.0 END AS credits_lost FROM (
SELECT {PATH}, unit, lesson, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items, sum(earned) / sum(possible) - sum(st) / 1000 / sum(possible) AS gap,
  (SELECT CAST(sum(CAST(round(credits_per_year * 100) AS BIGINT)) AS BIGINT) / 100 FROM focus f WHERE f.n = x.n AND f.standard IN (SELECT standard FROM sums y WHERE y.n = x.n AND y.unit = x.unit AND y.lesson = x.lesson AND y.placed = y.grade)) AS w
FROM sums x WHERE unit IS NOT NULL AND lesson IS NOT NULL AND placed = grade GROUP BY n, unit, lesson)"""
)
def report_focus_lessons(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)["focus_lessons"].select("path", "unit", "lesson", F.array_join("items", ",").alias("items"), "gap", "credits_per_year", "credits_lost")


PLACED = """judged AS (SELECT n, grade, standard, unit, lesson, item FROM known WHERE unit IS NOT NULL AND placed = grade),
rest AS (SELECT DISTINCT n, grade, standard FROM known k WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.n = k.n AND j.standard = k.standard)),
named AS (SELECT j.n, j.standard, j.unit, j.lesson, l.title, list(DISTINCT item ORDER BY item) AS items FROM judged j LEFT JOIN slessons l ON l.grade = j.grade AND l.unit = j.unit AND l.lesson = j.lesson GROUP BY ALL),
places AS (
  SELECT n, grade, standard, unit, 'judged' AS basis, coalesce((SELECT string_agg(lesson || ':' || coalesce(title, '') || ':' || array_to_string(items, '+'), ',' ORDER BY lesson) FROM named x WHERE x.n = j.n AND x.standard = j.standard AND x.unit = j.unit AND lesson IS NOT NULL), '') AS lessons,
         CAST(count(*) FILTER (WHERE lesson IS NULL) AS BIGINT) AS items_without_lesson FROM judged j GROUP BY n, grade, standard, unit
  UNION ALL SELECT DISTINCT n, grade, standard, unit, 'table', '', 0 FROM rest JOIN staught USING (grade, standard)),
placement AS (SELECT p.*, title, start_week, coalesce(mid_unit_assessment, false) AS mid FROM places p LEFT JOIN sunits USING (grade, unit))"""


@query(with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, CURRICULUM, PLACED) + f"SELECT {PATH}, standard, unit, basis, title, start_week, mid AS mid_unit_assessment, lessons, items_without_lesson FROM placement")
def report_placement(spark: SparkSession, d: str) -> DataFrame:
    lesson = lambda x: F.concat(x["lesson"], F.lit(":"), F.coalesce(x["lesson_title"], F.lit("")), F.lit(":"), F.array_join(x["items"], "+"))
    t = _run(spark, d)["placement"]
    return t.select("path", "standard", "unit", "basis", "title", "start_week", "mid_unit_assessment", F.array_join(F.transform("lessons", lesson), ",").alias("lessons"), "items_without_lesson")


@query(
    with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, CURRICULUM, PLACED)
    + f"SELECT {PATH}, standard, CASE WHEN bool_or(post_test) OR NOT starts_with(standard, 'NY-' || grade || '.') THEN 'prior-grade' ELSE 'unplaced' END AS status FROM known k WHERE NOT EXISTS (SELECT 1 FROM places p WHERE p.n = k.n AND p.standard = k.standard) GROUP BY n, grade, standard"
)
def report_unplaced(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "unplaced", "standard", "status")


@query(
    with_parts(SHEET_ITEMS, SHEET_BASE, MATCHED, STATS, CURRICULUM, PLACED)
    + f"SELECT {PATH}, standard, item FROM known k WHERE (unit IS NULL OR placed IS DISTINCT FROM grade) AND EXISTS (SELECT 1 FROM judged j WHERE j.n = k.n AND j.standard = k.standard)"
)
def report_unjudged(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "unjudged_items", "standard", "item")


@query(
    with_parts(*GATE_PARTS, CURRICULUM, PLACED)
    + f"""SELECT path, unit, title, start_week, credits, standards, distinct_credits, CAST(sum(credits) OVER (PARTITION BY path) AS BIGINT) <> distinct_credits AS double_counted FROM (
SELECT {PATH}, unit, title, start_week, CAST(sum(credits) AS BIGINT) AS credits, string_agg(DISTINCT standard, ',' ORDER BY standard) AS standards,
 (SELECT CAST(sum(credits) AS BIGINT) FROM gates x WHERE x.n = g.n AND bucket = 'gates-L2-L3') AS distinct_credits FROM gates g JOIN placement USING (n, standard) WHERE bucket = 'gates-L2-L3' GROUP BY n, unit, title, start_week)"""
)
def report_gating_units(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)["gating_by_unit"].select("path", "unit", "title", "start_week", "credits", F.array_join("standards", ",").alias("standards"), "distinct_credits", "double_counted")


CHECKS = """firsts AS (SELECT n, standard, unit, title, start_week, mid FROM placement QUALIFY row_number() OVER (PARTITION BY n, standard ORDER BY coalesce(start_week, 99), unit) = 1),
wants0 AS (SELECT g.n, g.standard, g.credits, unit, title, start_week, mid, coalesce(credits_lost, 0.0) AS lost,
   CASE WHEN row_number() OVER (PARTITION BY g.n ORDER BY coalesce(credits_lost, 0.0) DESC, g.standard) <= greatest(1, ceil(count(*) OVER (PARTITION BY g.n) / 3)) THEN 2 ELSE 1 END AS wish
   FROM gates g LEFT JOIN firsts USING (n, standard) LEFT JOIN focus USING (n, standard) WHERE bucket = 'gates-L2-L3'),
weak AS (SELECT n, standard, bool_or(coalesce(gap < -0.05, false)) AS weak FROM stats WHERE type = 'cr' GROUP BY n, standard),
sgrade AS (SELECT DISTINCT n, grade FROM stats),
offered AS (SELECT w.n, w.standard, i.id, i.type, row_number() OVER (PARTITION BY w.n, w.standard ORDER BY CASE WHEN coalesce(weak, false) AND i.type = 'mc' THEN 1 ELSE 0 END, coalesce(p_value, 1.0), i.year DESC, i.id) AS k
   FROM wants0 w JOIN sgrade USING (n) JOIN sitems i ON i.grade = sgrade.grade AND i.standard = w.standard AND transcribed AND CASE WHEN type = 'mc' THEN key IS NOT NULL ELSE answer IS NOT NULL END LEFT JOIN weak ON weak.n = w.n AND weak.standard = w.standard WHERE w.unit IS NOT NULL),
wants AS (SELECT *, least(wish, have) AS take, row_number() OVER l AS rank, greatest(least(wish, 6 - coalesce(sum(least(wish, have)) OVER (PARTITION BY n, unit ORDER BY lost DESC, standard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS want
   FROM (SELECT *, coalesce((SELECT count(*) FROM offered o WHERE o.n = w.n AND o.standard = w.standard), 0) AS have FROM wants0 w WHERE unit IS NOT NULL) WINDOW l AS (PARTITION BY n, unit ORDER BY lost DESC, standard)),
picked AS (SELECT w.n, w.unit, w.standard, o.id, o.type, w.mid, row_number() OVER (PARTITION BY w.n, w.unit ORDER BY rank, k) AS place, count(*) OVER (PARTITION BY w.n, w.unit) AS many FROM wants w JOIN offered o USING (n, standard) WHERE k <= least(want, take))"""
CHECK_PARTS = (*GATE_PARTS, FOCUSED, CURRICULUM, PLACED, CHECKS)


@query(with_parts(*CHECK_PARTS) + f"SELECT {PATH}, unit, standard, id, type, place, CASE WHEN mid AND many > 1 AND place <= ceil(many / 2) THEN 'mid-unit assessment' ELSE 'unit assessment' END AS when_given FROM picked")
def report_checkpoint_items(spark: SparkSession, d: str) -> DataFrame:
    t = _run(spark, d)["checkpoint_items"]
    return t.select("path", "unit", "standard", "id", "type", "place", F.col("when").alias("when_given"))


@query(with_parts(*CHECK_PARTS) + f"SELECT {PATH}, unit, title, start_week, mid AS mid_unit_assessment, CAST(sum(credits) AS BIGINT) AS gating_credits, CAST(sum(least(want, take)) AS BIGINT) AS n_items, NOT mid AND sum(credits) >= 4 AND coalesce(start_week >= 21, false) AS late_without_mid FROM wants GROUP BY n, unit, title, start_week, mid")
def report_checkpoint_units(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "checkpoint_units", "unit", "title", "start_week", "mid_unit_assessment", "gating_credits", "n_items", "late_without_mid")


@query(with_parts(*CHECK_PARTS) + f"SELECT {PATH}, standard, CAST(want AS INTEGER) AS wanted, CAST(least(want, take) AS INTEGER) AS got FROM wants WHERE least(want, take) < want")
def report_thin_supply(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)["thin_supply"].select("path", "standard", F.col("wanted").cast("int").alias("wanted"), F.col("got").cast("int").alias("got"))


@query(
    with_parts(*GATE_PARTS, CURVES)
    + f"""SELECT {PATH}, stage, why IS NULL AS usable, why FROM (
SELECT DISTINCT c_nationkey AS n, 'parse' AS stage, CASE WHEN c_nationkey = 11 THEN 'no row of question headers' END AS why FROM customer UNION ALL
SELECT n, 'identify', CASE WHEN NOT accepted THEN 'no clear match: ' || agree || ' of ' || published || ' published questions agree, the runner-up has ' || runner_up END FROM matched UNION ALL
SELECT n, 'curve', why FROM cstatus UNION ALL SELECT n, 'gating', why FROM gstatus UNION ALL
SELECT n, 'checkpoints', coalesce(why, CASE WHEN NOT EXISTS (SELECT 1 FROM gates g WHERE g.n = s.n AND bucket = 'gates-L2-L3') THEN 'no standard gates proficiency' END) FROM gstatus s)"""
)
def report_status(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)["status"].select("path", "stage", "usable", "why")
