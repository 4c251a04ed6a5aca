"""The curriculum beside the items: standards and items of a unit, chips, labels, packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import half_up
from gradeloom.operators.hierarchy import with_children

#: The option of items without a unit, the weeks counted as late, a preview's characters.
NO_UNIT, LATE_WEEKS, TASK_CHARS, FIRST_LESSONS = "Not in this grade's units", (21, 29), 260, 12


def unit_standards(cites: DataFrame, registry: DataFrame) -> DataFrame:
    """(grade, unit, code): what a unit's lessons cite, a parent as its one-letter children, an
    unregistered code as itself. cites: grade, unit, code; registry: code."""
    edges = with_children(registry.select("code").unionByName(cites.select("code")).distinct())
    known = edges.join(registry.select(F.col("code").alias("reach")).distinct(), "reach", "left_semi")
    met = cites.select("grade", "unit", "code").distinct().join(known, "code", "left")
    return met.select("grade", "unit", F.coalesce("reach", "code").alias("code")).distinct()


def unit_items(items: DataFrame, codes: DataFrame) -> DataFrame:
    """(grade, unit, id): the items of a grade that cite one of a unit's codes, each once a unit.

    items: id, grade, standard, secondary; codes: what unit_standards() gives.
    """
    cited = items.select("id", "grade", F.explode(F.array_union(F.array("standard"), F.coalesce("secondary", F.array().cast("array<string>")))).alias("code"))
    return cited.join(codes, ["grade", "code"]).select("grade", "unit", "id").distinct()


def prior_grade_items(codes: DataFrame, items: DataFrame) -> DataFrame:
    """(taught, tested, code, n): every listed code with how many of the tested grade's items cite it,
    none included. codes: taught, tested, code."""
    own = items.select(F.col("grade").alias("tested"), F.col("standard").alias("code")).groupBy("tested", "code").agg(F.count("*").alias("n"))
    return codes.join(own, ["tested", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def post_test_items(items: DataFrame) -> DataFrame:
    """Items on standards of an earlier grade, with that grade (``from_grade``, of the code) and their
    ``place`` within their own grade by year and number; ties by id. A grade's items are few."""
    own = items.where(F.coalesce("post_test", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("grade").orderBy("year", "item", "id"))
    return own.withColumns({"from_grade": F.regexp_extract("standard", r"^NY-(\d)\.", 1).try_cast("int"), "place": place})


def chips(asked: DataFrame, registry: DataFrame, items: DataFrame) -> DataFrame:
    """asked (grade, code) with what a reader is told of a code: whether it is known, itself or by its
    children, its text, how many items cite its family, and whether all of it is taught after the test.

    registry: code, cluster_text, domain_name, post_test, assessed_on. items: id, grade, standard, secondary.
    """
    pairs = asked.select("grade", "code").distinct()
    edges = with_children(registry.select("code").unionByName(pairs.select("code")).distinct())
    reg = registry.select(F.col("code").alias("reach"), F.coalesce("cluster_text", "domain_name").alias("_text"), F.coalesce("post_test", F.lit(False)).alias("_post"), "assessed_on")
    family = pairs.join(edges, "code").join(reg, "reach")
    own = F.col("reach") == F.col("code")
    facts = family.groupBy("grade", "code").agg(
        F.array_sort(F.collect_set("reach")).alias("family"), F.max(F.when(own, F.col("_text"))).alias("_own"), F.min_by("_text", "reach").alias("_first"),
        F.bool_and("_post").alias("after_test"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("_post"), F.col("assessed_on")))))).alias("assessed_on"),
    )
    cited = items.select("id", "grade", F.explode(F.array_union(F.array("standard"), F.coalesce("secondary", F.array().cast("array<string>")))).alias("reach"))
    hits = family.select("grade", "code", "reach").join(cited, ["grade", "reach"]).groupBy("grade", "code").agg(F.countDistinct("id").alias("hits"))
    met = pairs.join(facts, ["grade", "code"], "left").join(hits, ["grade", "code"], "left")
    return met.select("grade", "code", F.col("family").isNotNull().alias("known"), F.coalesce("_own", "_first").alias("text"), "family", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("after_test", F.lit(False)).alias("after_test"), "assessed_on")


def unit_label(unit: Column, title: Column, wholly_optional: Column) -> Column:
    """The label of a unit's option; without a unit, that of no unit."""
    named = F.concat(F.lit("Unit "), unit.cast("string"), F.coalesce(F.concat(F.lit(" · "), title), F.lit("")), F.when(F.coalesce(wholly_optional, F.lit(False)), " (review unit — matches broadly)").otherwise(""))
    return F.when(unit.isNull(), NO_UNIT).otherwise(named)


def unit_texts(item_units: DataFrame, units: DataFrame) -> DataFrame:
    """(id, text): the searchable form of an item's units, by number. item_units: id, grade, unit."""
    met = item_units.join(units.select("grade", "unit", "title"), ["grade", "unit"], "left")
    words = F.concat(F.lit("unit "), F.col("unit").cast("string"), F.coalesce(F.concat(F.lit(" "), "title"), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("unit", words.alias("w"))))
    return met.groupBy("id").agg(F.array_join(F.transform(parts, lambda p: p["w"]), " ").alias("text"))


def unit_cells(placement: DataFrame, *keys: str) -> DataFrame:
    """(keys.., units): the units of a standard with their weeks, as one text of a report's cell."""
    week = F.coalesce(F.concat(F.lit(" (week "), F.col("start_week").cast("string"), F.lit(")")), F.lit(""))
    parts = F.array_sort(F.collect_set(F.struct("unit", F.concat(F.lit("Unit "), F.col("unit").cast("string"), week).alias("t"))))
    return placement.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), ", ").alias("units"))


def late_units(units: DataFrame, weeks: tuple[int, int] = LATE_WEEKS) -> DataFrame:
    """Units that start in the weeks before the test."""
    return units.where(F.col("start_week").between(*weeks))


def optional_flag(lesson: Column, all_optional: Column, some: Column) -> Column:
    return F.coalesce(all_optional, F.lit(False)) | F.coalesce(F.array_contains(some, lesson), F.lit(False))


def first_lessons(lessons: DataFrame, *order: Column, n: int = FIRST_LESSONS) -> DataFrame:
    """The first lessons of a report; the report's own length."""
    return lessons.orderBy(*order).limit(n)


def levels_lost(focus: DataFrame, slopes: DataFrame, band: str = "L2") -> DataFrame:
    """focus with levels_lost: the credits lost times what a credit is worth in that band; null
    where the band has no slope. focus and slopes share no column but the keys of a report."""
    keys = [c for c in slopes.columns if c not in ("band", "per_credit", "segments")]
    s = slopes.where((F.col("band") == band) & F.col("per_credit").isNotNull()).select(*keys, "per_credit")
    met = focus.join(s, keys, "left") if keys else focus.join(F.broadcast(s), how="left")  # one row
    return met.withColumn("levels_lost", half_up(F.col("credits_lost") * F.col("per_credit"), 2)).drop("per_credit")


def packet(standard: str, items: DataFrame, tier1: DataFrame, lessons: DataFrame, activities: DataFrame, full: bool = False, assessed: tuple[str, ...] = ("cool-down",)) -> dict[str, DataFrame]:
    """What a reader who places a standard's items is given: the items in order, and the lessons of
    the first tier with why they are there and their activities, tasks cut to a preview unless ``full``.

    items: standard, id, year, item, type, p_value, stem. tier1: code, rank, unit_tag, table_tag.
    lessons: code, title, section, optional, goal. activities: code, kind, name, page, task.
    """
    mine = items.where(F.col("standard") == standard).select("id", "year", "item", "type", "p_value", F.coalesce("stem", F.lit("(not transcribed)")).alias("stem")).orderBy("year", "item")
    tags = F.array_compact(F.array(F.when(F.col("unit_tag"), "unit guide tag"), F.when(F.col("table_tag"), "course guide table")))
    why = F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise("lexical only")
    asked = tier1.join(lessons, "code", "left").select("rank", "code", why.alias("why"), F.coalesce("title", F.lit("(not in the index)")).alias("title"), "section", "optional", "goal").orderBy("rank")
    task = F.col("task")
    cut = task if full else F.when(F.length(task) > TASK_CHARS, F.concat(F.substring(task, 1, TASK_CHARS), F.lit("..."))).otherwise(task)
    marks = F.lit(False)
    for a in assessed:
        marks = marks | F.contains(F.lower(F.coalesce("kind", F.lit(""))), F.lit(a))
    shown = activities.join(tier1.select("code", "rank"), "code").select("rank", "code", "kind", "name", "page", cut.alias("task"), marks.alias("assessed")).orderBy("rank", "page")
    return {"items": mine, "lessons": asked, "activities": shown}


def glyph_clusters(clusters: DataFrame, n: int = 20) -> DataFrame:
    """Clusters by how often they occur, the most frequent without a label first in line to be read:
    the report's first n."""
    return clusters.orderBy(F.col("label").isNotNull(), F.col("count").desc(), "cluster").limit(n)


def index_counts(lessons: DataFrame, cites: DataFrame) -> DataFrame:
    """One row per grade: units, lessons, lessons with and without a citation, pairs, codes."""
    key = ["grade", "unit", "lesson"]
    c = cites.select(*key, "code").distinct()
    a = lessons.select(*key).distinct().join(c.select(*key).distinct().withColumn("_c", F.lit(True)), key, "left").groupBy("grade").agg(
        F.countDistinct("unit").alias("units"), F.count("*").alias("lessons"), F.count("_c").alias("citing")
    )
    b = c.groupBy("grade").agg(F.count("*").alias("pairs"), F.countDistinct("code").alias("codes"))
    out = a.join(b, "grade", "left").withColumn("bare", F.col("lessons") - F.col("citing"))
    return out.withColumns({x: F.coalesce(x, F.lit(0)) for x in ("pairs", "codes")})


def both_ways(by_lesson: DataFrame, by_standard: DataFrame) -> DataFrame:
    """(grade, code, lesson, side): pairs that only one of the two printed tables has."""
    cols = ["grade", "code", "lesson"]
    a, b = by_lesson.select(*cols).distinct(), by_standard.select(*cols).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("by-lesson")).unionByName(b.exceptAll(a).withColumn("side", F.lit("by-standard")))


def evidence_sets(tagged: DataFrame, tabled: DataFrame, *keys: str) -> DataFrame:
    """(keys.., unit_tag, table_tag): pairs that either source names, once each."""
    a, b = tagged.select(*keys).distinct().withColumn("_u", F.lit(True)), tabled.select(*keys).distinct().withColumn("_t", F.lit(True))
    return a.join(b, list(keys), "full_outer").select(*keys, F.coalesce("_u", F.lit(False)).alias("unit_tag"), F.coalesce("_t", F.lit(False)).alias("table_tag"))


def document_text(*parts: Column) -> Column:
    """Text fields and arrays of them as one text; nulls left out."""
    return F.concat_ws(" ", *parts)


def tier_recall(relevant: DataFrame, tier1: DataFrame, tier2: DataFrame, query: str, doc: str) -> DataFrame:
    """One row: relevant pairs, those in the first tier and in either, and the upper median of how many
    documents a query's two tiers ask to read."""
    a, b = tier1.select(query, doc).withColumn("_1", F.lit(True)), tier2.select(query, doc).withColumn("_2", F.lit(True))
    met = relevant.select(query, doc).distinct().join(a, [query, doc], "left").join(b, [query, doc], "left")
    hits = met.agg(F.count("*").alias("relevant"), F.count("_1").alias("in_tier1"), F.count_if(F.col("_1").isNotNull() | F.col("_2").isNotNull()).alias("in_either"))
    sizes = a.select(query, doc).unionByName(b.select(query, doc)).distinct().groupBy(query).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy("n")  # one row per query
    ranked = sizes.select("n", (F.row_number().over(w) - 1).alias("_r"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("_k"))
    median = ranked.where(F.col("_r") == F.floor(F.col("_k") / 2)).agg(F.max("n").alias("median_read"))
    return hits.join(F.broadcast(median), how="cross")  # one row each
