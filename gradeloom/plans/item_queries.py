"""Queries: item statistics, rollups, curve, focus, gating, placement, schedule, identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import analysis, explore, itemstats
from gradeloom.plans import roles
from gradeloom.plans.registry import query, r3, with_parts
from gradeloom.plans.roles import CURVE, ITEMS, RESPONSES, STATS, STUDENTS

BASE = with_parts(ITEMS, RESPONSES)
FULL = with_parts(ITEMS, RESPONSES, STATS)


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return itemstats.item_stats(roles.responses(spark, d), roles.items(spark, d))


@query(FULL + "SELECT item, standard, type, credits, n, answered, n - answered AS omitted, earned, correct, full_credit, zero_credit, class_p, state_p, gap FROM item_stats")
def item_stats(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select("item", "standard", "type", "credits", "n", "answered", "omitted", "earned", "correct", "full_credit", "zero_credit", "class_p", "state_p", "gap")


@query(BASE + "SELECT item, value AS letter, count(*) AS n FROM scored WHERE type = 'mc' AND value <> key GROUP BY ALL")
def distractor_counts(spark: SparkSession, d: str) -> DataFrame:
    return itemstats.wrong_answers(roles.responses(spark, d), roles.items(spark, d))


TOP = """wrong AS (SELECT item, value AS letter, count(*) AS n FROM scored WHERE type = 'mc' AND value <> key GROUP BY ALL),
top AS (SELECT item, letter AS top_wrong, n AS top_wrong_count FROM wrong QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, letter) = 1)"""


@query(with_parts(ITEMS, RESPONSES, TOP) + "SELECT * FROM top")
def top_wrong_answer(spark: SparkSession, d: str) -> DataFrame:
    return itemstats.top_wrong(itemstats.wrong_answers(roles.responses(spark, d), roles.items(spark, d)))


@query(with_parts(ITEMS, RESPONSES, STATS, TOP) + "SELECT item, n, top_wrong, top_wrong_count FROM item_stats JOIN top USING (item) WHERE type = 'mc' AND top_wrong_count * 4 >= n")
def dominant_wrong(spark: SparkSession, d: str) -> DataFrame:
    it, r = roles.items(spark, d), roles.responses(spark, d)
    top = itemstats.top_wrong(itemstats.wrong_answers(r, it))
    return itemstats.dominant(itemstats.item_stats(r, it), top).select("item", "n", "top_wrong", "top_wrong_count")


@query(
    with_parts(ITEMS, RESPONSES, TOP)
    + """SELECT item, letter, coalesce(w.n, 0) AS n FROM (SELECT item, unnest(['A', 'N', 'R']) AS letter FROM items WHERE type = 'mc') LEFT JOIN wrong w USING (item, letter)"""
)
def choice_tally(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    choices = it.where("type = 'mc'").select("item", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("letter"))
    return itemstats.choice_tally(choices, itemstats.wrong_answers(roles.responses(spark, d), it))


@query(FULL + "SELECT item, gap, coalesce(gap, 1.0) AS order_gap, row_number() OVER (ORDER BY coalesce(gap, 1.0), item) AS place FROM item_stats")
def class_vs_state_gap(spark: SparkSession, d: str) -> DataFrame:
    stats = _stats(spark, d).select("item", "gap", F.coalesce("gap", F.lit(1.0)).alias("order_gap"))
    return explore.placed(stats, F.col("order_gap").asc(), F.col("item").asc())


@query(BASE + f"SELECT item, (SELECT count(*) FROM customer) AS n, count(*) FILTER (WHERE answered) AS answered, sum(points) AS earned, {r3('sum(points) / (any_value(credits) * (SELECT count(*) FROM customer))')} AS class_p FROM scored GROUP BY item")
def roster_item_stats(spark: SparkSession, d: str) -> DataFrame:
    """The class rate over all students of the roster, answered or not."""
    roster = roles.table(spark, d, "customer")
    return itemstats.item_stats(roles.responses(spark, d), roles.items(spark, d), roster).select("item", "n", "answered", "earned", "class_p")


def _rollup_sql(key: str) -> str:
    cls = r3("sum(earned) / sum(credits * n)")
    st = r3("sum(CAST(floor(coalesce(state_p, 0) * 1000 + 0.5) AS BIGINT) * credits * n) / 1000 / sum(credits * n)")
    return FULL + f"""SELECT {key}, n_items, earned, possible, class_p, state_p, {r3('class_p - state_p')} AS gap FROM (
  SELECT {key}, count(*) AS n_items, sum(earned) AS earned, CAST(sum(credits * n) AS BIGINT) AS possible, {cls} AS class_p, {st} AS state_p FROM item_stats GROUP BY {key})"""


@query(_rollup_sql("standard"))
def rollup_standard(spark: SparkSession, d: str) -> DataFrame:
    return itemstats.rollup(_stats(spark, d), "standard")


@query(_rollup_sql("domain"))
def rollup_domain(spark: SparkSession, d: str) -> DataFrame:
    return itemstats.rollup(_stats(spark, d), "domain")


SECTIONS = f"""sectioned AS (SELECT s.*, section, level FROM scored s JOIN students USING (student)),
rates AS (SELECT section, item, {r3('sum(points) / sum(credits)')} AS class_p FROM sectioned GROUP BY section, item)"""


@query(with_parts(ITEMS, RESPONSES, STUDENTS, SECTIONS) + "SELECT section, item, class_p FROM rates")
def section_rates(spark: SparkSession, d: str) -> DataFrame:
    return itemstats.section_rates(roles.responses(spark, d, customers=True), roles.items(spark, d))


@query(with_parts(ITEMS, RESPONSES, STUDENTS, SECTIONS) + f"SELECT item, {r3('max(class_p) - min(class_p)')} AS spread FROM rates GROUP BY item")
def section_spread(spark: SparkSession, d: str) -> DataFrame:
    return itemstats.section_spread(section_rates(spark, d))


@query(
    FULL
    + f"SELECT sum(earned) AS earned, CAST(sum(credits * n) AS BIGINT) AS possible, {r3('sum(earned) / sum(credits * n)')} AS class_p, {r3('sum(CAST(floor(coalesce(state_p, 0) * 1000 + 0.5) AS BIGINT) * credits * n) / 1000 / sum(credits * n)')} AS state_p FROM item_stats"
)
def overall_rates(spark: SparkSession, d: str) -> DataFrame:
    return itemstats.overall(_stats(spark, d))


@query(BASE + "SELECT student, sum(points) AS raw FROM scored GROUP BY student")
def raw_score(spark: SparkSession, d: str) -> DataFrame:
    return itemstats.raw_scores(roles.responses(spark, d), roles.items(spark, d))


@query("WITH answered AS (SELECT DISTINCT l_partkey AS item FROM lineitem) SELECT item FROM answered WHERE item NOT IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0)")
def unmatched_items(spark: SparkSession, d: str) -> DataFrame:
    known = roles.items(spark, d).where("unit is not null").join(roles.table(spark, d, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("item")), "item")
    return itemstats.unmatched(roles.table(spark, d, "lineitem").select(F.col("l_partkey").alias("item")), known)


# --- curve -------------------------------------------------------------------------


@query(with_parts(CURVE) + "SELECT raw, level, CAST(0 AS BIGINT) AS conflicts FROM curve")
def curve_points(spark: SparkSession, d: str) -> DataFrame:
    return analysis.curve_points(roles.curve(spark, d))


@query(with_parts(CURVE) + "SELECT count(*) AS points, CAST(0 AS BIGINT) AS conflicts, true AS usable, CAST(NULL AS VARCHAR) AS why FROM curve")
def curve_status(spark: SparkSession, d: str) -> DataFrame:
    return analysis.curve_status(analysis.curve_points(roles.curve(spark, d)))


@query(
    with_parts(CURVE, "cuts AS (SELECT CAST(unnest([2, 3, 4]) AS DOUBLE) AS cut)")
    + """SELECT cut, CASE WHEN here IS NOT NULL THEN here WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi END AS raw, here IS NOT NULL AS exact,
       CASE WHEN here IS NULL AND lo IS NOT NULL AND hi IS NOT NULL THEN lo END AS below
FROM (SELECT cut, min(raw) FILTER (WHERE abs(level - cut) < 0.005) AS here, max(raw) FILTER (WHERE level < cut) AS lo, min(raw) FILTER (WHERE level > cut) AS hi FROM curve, cuts GROUP BY cut)"""
)
def curve_cuts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.curve_cuts(analysis.curve_points(roles.curve(spark, d)))


BAND = "CASE WHEN {0} >= 1 AND {0} < 2 THEN 'L1' WHEN {0} < 3 THEN 'L2' WHEN {0} < 4 THEN 'L3' WHEN {0} < 9 THEN 'L4' END"


@query(
    with_parts(CURVE, "steps AS (SELECT raw, level, lead(raw) OVER (ORDER BY raw) AS raw2, lead(level) OVER (ORDER BY raw) AS level2 FROM curve)")
    + f"SELECT {BAND.format('level')} AS band, {r3('avg((level2 - level) / (raw2 - raw))')} AS per_credit, count(*) AS segments FROM steps WHERE raw2 IS NOT NULL AND {BAND.format('level')} = {BAND.format('level2')} GROUP BY band"
)
def curve_slopes(spark: SparkSession, d: str) -> DataFrame:
    return analysis.curve_slopes(analysis.curve_points(roles.curve(spark, d)))


@query(with_parts(CURVE) + "SELECT CAST(r AS INTEGER) AS raw FROM (SELECT unnest(range((SELECT min(raw) FROM curve), 56)) AS r) WHERE r NOT IN (SELECT raw FROM curve)")
def unobserved_scores(spark: SparkSession, d: str) -> DataFrame:
    return analysis.unobserved(analysis.curve_points(roles.curve(spark, d)), 55)


@query(
    with_parts(CURVE, "asks AS (SELECT * FROM (VALUES (1.5::DOUBLE, 2.0::DOUBLE), (2.5, 2.999), (0.5, 3.0), (3.0, 9.0)) t(from_level, to_level))")
    + """SELECT from_level, to_level, from_raw, to_raw, greatest(to_raw - from_raw, 0) + 0 * to_raw AS credits FROM (
  SELECT from_level, to_level, coalesce(max(raw) FILTER (WHERE level <= from_level), min(raw)) AS from_raw, min(raw) FILTER (WHERE level > to_level) AS to_raw FROM curve, asks GROUP BY ALL)"""
)
def credits_to_reach(spark: SparkSession, d: str) -> DataFrame:
    asks = spark.createDataFrame([(1.5, 2.0), (2.5, 2.999), (0.5, 3.0), (3.0, 9.0)], "from_level double, to_level double")
    out = analysis.credits_to_reach(analysis.curve_points(roles.curve(spark, d)), asks)
    return out.withColumn("credits", F.when(F.col("to_raw").isNotNull(), F.col("credits")))


# --- focus -------------------------------------------------------------------------

WEIGHTS = """weights AS (
  SELECT standard, CAST(sum(credits) AS DOUBLE) / (SELECT count(DISTINCT year) FROM items) AS mean_credits, count(DISTINCT year) AS recurs,
         (SELECT count(DISTINCT year) FROM items) AS years FROM items GROUP BY standard)"""
FOCUS = f"""exact AS (
  SELECT standard, sum(earned) AS earned, sum(credits * n) AS possible, sum(CAST(floor(state_p * 1000 + 0.5) AS BIGINT) * credits * n) / 1000 AS state_earned FROM item_stats GROUP BY standard),
focus AS (
  SELECT standard, {r3('(earned - state_earned) / possible')} AS gap, {r3('mean_credits', 2)} AS credits_per_year, recurs, years AS of_years,
         CASE WHEN (earned - state_earned) / possible < 0 THEN {r3('-((earned - state_earned) / possible) * mean_credits', 2)} ELSE 0.0 END AS credits_lost
  FROM exact JOIN weights USING (standard))"""


def _focus(spark: SparkSession, d: str) -> DataFrame:
    possible = F.col("credits") * F.col("n")
    state = F.floor(F.coalesce("state_p", F.lit(0.0)) * 1000 + 0.5).cast("long") * possible
    exact = _stats(spark, d).groupBy("standard").agg(F.sum("earned").alias("earned"), F.sum(possible).alias("possible"), (F.sum(state) / 1000).alias("state_earned"))
    return analysis.focus(exact, analysis.yearly_weight(roles.items(spark, d)))


@query(with_parts(ITEMS, WEIGHTS) + "SELECT * FROM weights")
def yearly_weights(spark: SparkSession, d: str) -> DataFrame:
    return analysis.yearly_weight(roles.items(spark, d))


@query(with_parts(ITEMS, RESPONSES, STATS, WEIGHTS, FOCUS) + "SELECT * FROM focus")
def focus_standard(spark: SparkSession, d: str) -> DataFrame:
    return _focus(spark, d)


@query(
    with_parts(ITEMS, RESPONSES, STATS, WEIGHTS, FOCUS)
    + "SELECT unit, lesson, count(*) AS standards, sum(CAST(floor(credits_lost * 100 + 0.5) AS BIGINT)) / 100 AS credits_lost FROM (SELECT DISTINCT unit, lesson, standard FROM items) JOIN focus USING (standard) GROUP BY unit, lesson"
)
def focus_lesson(spark: SparkSession, d: str) -> DataFrame:
    return analysis.focus_by_lesson(_focus(spark, d), roles.items(spark, d).select("unit", "lesson", "standard"))


# --- gating ------------------------------------------------------------------------

LEVEL_BAND = "CASE WHEN level < 2 THEN 'L1' WHEN level < 3 THEN 'L2' WHEN level < 4 THEN 'L3' WHEN level IS NOT NULL THEN 'L4' END"
_rates = ", ".join(
    r3(f"sum(points) FILTER (WHERE band = '{b}') / sum(credits) FILTER (WHERE band = '{b}')") + f" AS {b}" for b in analysis.BAND_NAMES
)
GATING = f"""banded AS (SELECT s.*, {LEVEL_BAND} AS band FROM scored s JOIN students USING (student)),
band_rates AS (SELECT standard, {_rates} FROM banded GROUP BY standard),
gating AS (
  SELECT standard, (SELECT CAST(sum(credits) AS BIGINT) FROM items i WHERE i.standard = b.standard) AS credits, L1, L2, L3, L4,
    CASE WHEN least(L1, L2, L3, L4) >= 0.36 THEN 'solid' WHEN greatest(L1, L2, L3, L4) < 0.36 THEN 'weak-for-all' WHEN L2 >= 0.36 AND L1 < 0.36 THEN 'gates-L1-L2'
         WHEN L3 >= 0.36 AND L2 < 0.36 THEN 'gates-L2-L3' WHEN L4 >= 0.36 AND L3 < 0.36 THEN 'gates-L3-L4' ELSE 'mixed' END AS bucket
  FROM band_rates b)"""
#: On the driver's random answers rates lie near a third, so the threshold is lower than in practice.
THRESHOLD = 0.36


def _gating(spark: SparkSession, d: str) -> DataFrame:
    r = roles.responses(spark, d, customers=True).withColumn("band", analysis.level_band(F.col("level")))
    return analysis.band_gating(r, roles.items(spark, d), threshold=THRESHOLD)


@query(with_parts(STUDENTS) + f"SELECT band, n, min(n) OVER () >= 5 AS usable FROM (SELECT {LEVEL_BAND} AS band, count(*) AS n FROM students GROUP BY band)")
def band_sizes(spark: SparkSession, d: str) -> DataFrame:
    return analysis.band_sizes(roles.students(spark, d))


@query(with_parts(ITEMS, RESPONSES, STUDENTS, GATING) + "SELECT * FROM gating")
def band_gating(spark: SparkSession, d: str) -> DataFrame:
    return _gating(spark, d).orderBy(*analysis.gating_order())


@query(
    with_parts(ITEMS, RESPONSES, STUDENTS, GATING)
    + """SELECT *, sum(credits) OVER () <> distinct_credits AS double_counted FROM (
  SELECT unit, CAST(sum(credits) AS BIGINT) AS credits, count(*) AS standards, (SELECT CAST(coalesce(sum(credits), 0) AS BIGINT) FROM gating WHERE bucket = 'mixed') AS distinct_credits
  FROM gating JOIN (SELECT DISTINCT unit, standard FROM items) USING (standard) WHERE bucket = 'mixed' GROUP BY unit)"""
)
def gating_by_unit(spark: SparkSession, d: str) -> DataFrame:
    return analysis.gating_by_unit(_gating(spark, d), roles.items(spark, d), bucket="mixed")


# --- placement and schedule ----------------------------------------------------------

PLACED = """judged AS (SELECT item, CAST(6 + item % 4 AS INTEGER) AS judged_grade, CASE WHEN item % 11 <> 0 THEN CAST(item % 9 + 1 AS INTEGER) END AS unit FROM items WHERE item % 3 = 0),
taught AS (SELECT DISTINCT standard, unit FROM items WHERE unit % 4 <> 0 AND right(standard, 1) <> '5'),
placed AS (
  SELECT DISTINCT i.item, coalesce(CASE WHEN j.judged_grade = i.grade THEN j.unit END, t.unit) AS unit,
         CASE WHEN j.judged_grade = i.grade AND j.unit IS NOT NULL THEN 'judged' WHEN t.unit IS NOT NULL THEN 'table' ELSE 'unplaced' END AS basis
  FROM items i LEFT JOIN judged j USING (item) LEFT JOIN taught t USING (standard))"""


def _judged(it: DataFrame) -> DataFrame:
    i = F.col("item")
    return it.where(i % 3 == 0).select("item", (i % 4 + 6).cast("int").alias("judged_grade"), F.when(i % 11 != 0, (i % 9 + 1).cast("int")).alias("unit"))


def _taught(it: DataFrame) -> DataFrame:
    return it.where((F.col("unit") % 4 != 0) & ~F.col("standard").endswith("5")).select("standard", "unit").distinct()


@query(with_parts(ITEMS, PLACED) + "SELECT * FROM placed")
def placement_judged_first(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    return analysis.placed_items(it.drop("unit"), _judged(it), _taught(it), F.col("grade"))


@query(
    with_parts(ITEMS, PLACED, "derived AS (SELECT standard, string_agg(DISTINCT CAST(unit AS VARCHAR), ',' ORDER BY CAST(unit AS VARCHAR)) AS units FROM taught GROUP BY standard)")
    + """SELECT item, CASE WHEN judged_grade = grade THEN coalesce(CAST(j.unit AS VARCHAR), '') WHEN judged_grade IS NOT NULL THEN '' ELSE coalesce(units, '') END AS units
FROM items i LEFT JOIN judged j USING (item) LEFT JOIN derived USING (standard)"""
)
def explorer_units(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    derived = _taught(it).groupBy("standard").agg(F.array_sort(F.collect_set(F.col("unit").cast("string"))).alias("units"))
    got = analysis.explorer_units(it.drop("unit"), _judged(it), derived)
    return got.select("item", F.array_join("units", ",").alias("units"))


@query(
    with_parts(ITEMS)
    + "SELECT standard, unit, start_week FROM (SELECT DISTINCT standard, unit, CASE WHEN unit <> 5 THEN unit * 4 - 3 END AS start_week FROM items) QUALIFY row_number() OVER (PARTITION BY standard ORDER BY coalesce(start_week, 99), unit) = 1"
)
def checkpoint_earliest_unit(spark: SparkSession, d: str) -> DataFrame:
    placed = roles.items(spark, d).select("standard", "unit").distinct().withColumn("start_week", F.when(F.col("unit") != 5, F.col("unit") * 4 - 3))
    return analysis.earliest_unit(placed)


WANTS = """firsts AS (SELECT standard, min(unit) AS unit FROM items GROUP BY standard),
lost AS (SELECT f.unit, standard, CAST(CAST(sum(credits) AS BIGINT) % 17 AS DOUBLE) AS credits_lost, count(*) AS available FROM items i JOIN firsts f USING (standard) GROUP BY f.unit, standard),
wished AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY credits_lost DESC, standard) <= greatest(1, ceil(count(*) OVER () / 3)) THEN 2 ELSE 1 END AS wish FROM lost),
wants AS (SELECT unit, standard, CAST(row_number() OVER w AS INTEGER) AS rank, CAST(greatest(least(wish, 6 - coalesce(sum(least(wish, available)) OVER (PARTITION BY unit ORDER BY credits_lost DESC, standard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS INTEGER) AS want, credits_lost
  FROM wished WINDOW w AS (PARTITION BY unit ORDER BY credits_lost DESC, standard))"""
PICKED = """pool AS (SELECT standard, item AS id, type, p_value, year, right(standard, 1) IN ('1', '3') AS weak_cr FROM items),
picked AS (SELECT w.*, p.id, p.type, p.p_value, p.year, p.weak_cr FROM wants w JOIN (SELECT *, row_number() OVER (PARTITION BY standard ORDER BY CASE WHEN weak_cr AND type = 'mc' THEN 1 ELSE 0 END, coalesce(p_value, 1.0), year DESC, id) AS n FROM pool) p USING (standard) WHERE n <= want)"""


def _wants(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    first = analysis.earliest_unit(it.select("standard", "unit").distinct().withColumn("start_week", F.col("unit")))
    lost = it.groupBy("standard").agg((F.sum("credits") % 17).cast("double").alias("credits_lost"), F.count("*").alias("available"))
    return analysis.checkpoint_wants(first.join(lost, "standard").select("unit", "standard", "credits_lost", "available"))


def _picked(spark: SparkSession, d: str) -> DataFrame:
    weak = F.substring("standard", -1, 1).isin("1", "3")
    pool = roles.items(spark, d).select("standard", F.col("item").alias("id"), "type", "p_value", "year", weak.alias("weak_cr"))
    return analysis.checkpoint_items(_wants(spark, d), pool)


@query(with_parts(ITEMS, WANTS) + "SELECT * FROM wants")
def checkpoint_wants(spark: SparkSession, d: str) -> DataFrame:
    return _wants(spark, d)


@query(with_parts(ITEMS, WANTS, PICKED) + "SELECT * FROM picked")
def checkpoint_items(spark: SparkSession, d: str) -> DataFrame:
    return _picked(spark, d)


@query(with_parts(ITEMS, WANTS, PICKED) + "SELECT standard, want, count(id) AS got FROM (SELECT w.standard, w.want, k.id FROM wants w LEFT JOIN (SELECT * FROM picked WHERE id % 3 <> 0) k USING (standard)) GROUP BY standard, want HAVING count(id) < want")
def thin_supply(spark: SparkSession, d: str) -> DataFrame:
    return analysis.thin_supply(_wants(spark, d), _picked(spark, d).where("id % 3 <> 0"))


@query(
    with_parts(ITEMS, WANTS, PICKED)
    + """SELECT unit, standard, id, CASE WHEN unit % 2 = 0 AND n > 1 AND place <= ceil(n / 2) THEN 'mid-unit assessment' ELSE 'unit assessment' END AS given
FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY rank, id) AS place, count(*) OVER (PARTITION BY unit) AS n FROM picked)"""
)
def assessment_sets(spark: SparkSession, d: str) -> DataFrame:
    picked = _picked(spark, d).withColumn("mid_unit_assessment", F.col("unit") % 2 == 0)
    return analysis.assessment_sets(picked).select("unit", "standard", "id", F.col("when").alias("given"))


@query(with_parts(ITEMS) + "SELECT * FROM (SELECT unit, unit % 2 = 0 AS mid_unit_assessment, CAST(sum(credits) AS BIGINT) AS gating_credits, unit * 4 - 3 AS start_week FROM items GROUP BY unit) WHERE NOT mid_unit_assessment AND gating_credits >= 4 AND start_week >= 21")
def late_without_mid(spark: SparkSession, d: str) -> DataFrame:
    units = roles.items(spark, d).groupBy("unit").agg(F.sum("credits").alias("gating_credits"))
    units = units.select("unit", (F.col("unit") % 2 == 0).alias("mid_unit_assessment"), "gating_credits", (F.col("unit") * 4 - 3).alias("start_week"))
    return analysis.late_without_mid(units)


# --- identification ------------------------------------------------------------------


@query(
    with_parts(
        ITEMS,
        "header AS (SELECT item, standard AS code FROM items WHERE year = 1997)",
        "published AS (SELECT CAST(year AS VARCHAR) AS test, item % 1000 AS item, min(standard) AS code FROM items GROUP BY 1, 2)",
        "probe AS (SELECT item % 1000 AS item, min(code) AS code FROM header GROUP BY 1)",
        "score AS (SELECT test, count(*) FILTER (WHERE p.code = h.code) AS agree, count(*) AS published FROM published p JOIN probe h USING (item) GROUP BY test)",
        "ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY agree DESC, test) AS INTEGER) AS rank, coalesce(lead(agree) OVER (ORDER BY agree DESC, test), 0) AS runner_up FROM score)",
    )
    + "SELECT *, agree >= 10 AND agree * 5 >= published * 4 AND agree >= runner_up * 2 AND rank = 1 AS accepted FROM ranked"
)
def identify_test(spark: SparkSession, d: str) -> DataFrame:
    it = roles.items(spark, d)
    number = (F.col("item") % 1000).alias("item")
    published = it.groupBy(F.col("year").cast("string").alias("test"), number).agg(F.min("standard").alias("code"))
    probe = it.where("year = 1997").groupBy(number).agg(F.min("standard").alias("code"))
    return analysis.identify(probe, published)
