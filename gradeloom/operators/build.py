"""From reviewed tables to a published payload: items, tests, withheld items, alignment, curriculum.

Everything that must hold is a row of a fault table with what is wrong; ``refused`` turns
faults into an error when a payload is written. Tables are joined by their keys, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import code_part
from gradeloom.sources.tables import page_link

#: The kinds of items, and why a withheld item has its credits.
CHOICE, CONSTRUCTED = "mc", "cr"
BASIS_CHOICE, BASIS_ORDER = "one credit by kind", "inferred: the open credits in item order"


def item_id(test: Column, item: Column) -> Column:
    return F.format_string("%s-%03d", test, item)


def item_rows(item_map: DataFrame, tests: DataFrame, registry: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per item of the maps, with its id, code's grade and domain, page and address.

    item_map: test, item, session, type, key, credits, standard, p_value, avg_points, domain_label.
    tests: test, grade, year. registry: code, post_test, assessed_on (grades), domain_name.
    pages: test, item, pdf_page, printed_page. sources: grade, year, kind, url. An item keeps
    its row where the registry, a page or an address is missing; faults() tells which.
    """
    url = sources.where("kind = 'released'").select("grade", "year", F.col("url").alias("_url"))
    reg = registry.select(F.col("code").alias("standard"), "post_test", "assessed_on", F.col("domain_name").alias("_name"), F.lit(True).alias("in_registry"))
    met = item_map.join(tests.select("test", "grade", "year"), "test").join(reg, "standard", "left").join(pages.select("test", "item", "pdf_page", "printed_page"), ["test", "item"], "left").join(url, ["grade", "year"], "left")
    own = code_part(F.col("standard"), "grade")
    return met.select(
        item_id(F.col("test"), F.col("item")).alias("id"), "test", "grade", "year", "item", "session", "type", "key", "credits", "standard", own.alias("standard_grade"),
        code_part(F.col("standard"), "domain").alias("domain"), F.coalesce("_name", "domain_label").alias("domain_label"), "p_value", "avg_points",
        F.coalesce("post_test", F.lit(False)).alias("post_test"), F.when(own != F.col("grade"), own).alias("post_test_from"), "pdf_page", "printed_page",
        page_link(F.col("_url"), F.col("pdf_page")).alias("source_url"), F.coalesce("in_registry", F.lit(False)).alias("in_registry"), "assessed_on",
    )


def numbered(grades: DataFrame, kinds: DataFrame, sessions: DataFrame) -> DataFrame:
    """(grade, item, type, session) of every designed item number.

    grades: grade, designed_items. kinds: grade, type, lo, hi. sessions: grade, session, lo, hi.
    """
    every = grades.select("grade", F.explode(F.sequence(F.lit(1), F.col("designed_items"))).alias("item"))
    inside = lambda t, c: t.select("grade", F.explode(F.sequence("lo", "hi")).alias("item"), c)
    return every.join(inside(kinds, "type"), ["grade", "item"], "left").join(inside(sessions, "session"), ["grade", "item"], "left")


def faults(items: DataFrame, plan: DataFrame) -> DataFrame:
    """(id, fault): codes that don't parse or aren't registered, that the registry doesn't assess on
    the grade, whose grade contradicts the post-test flag, and types or sessions off the plan.

    plan: what numbered() gives.
    """
    want = plan.select("grade", "item", F.col("type").alias("_type"), F.col("session").alias("_session"))
    met = items.join(want, ["grade", "item"], "left")
    tests = (
        ("code", F.col("standard_grade").isNull()),
        ("registry", F.col("standard_grade").isNotNull() & ~F.col("in_registry")),
        ("not-assessed", F.col("in_registry") & ~F.coalesce(F.array_contains("assessed_on", F.col("grade")), F.lit(False))),
        ("post-test", F.col("in_registry") & ((F.col("standard_grade") != F.col("grade")) != F.col("post_test"))),
        ("type", F.col("_type").isNull() | (F.col("type") != F.col("_type"))),
        ("session", ~F.col("session").eqNullSafe(F.col("_session"))),
    )
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests]))
    return met.select("id", F.explode(found).alias("fault"))


def withheld_rows(items: DataFrame, tests: DataFrame, plan: DataFrame, credit_plan: DataFrame) -> DataFrame:
    """(test, item, session, type, credits, basis) of the designed items that a test didn't release.

    credit_plan: (grade, credits, n) of constructed items. The open credits are dealt to
    the withheld constructed items in order, which is an inference and says so.
    """
    gone = tests.join(plan, "grade").join(items.select("test", "item"), ["test", "item"], "left_anti").select("test", "grade", "item", "type", "session")
    done = items.where(F.col("type") == CONSTRUCTED).groupBy("test", "credits").agg(F.count("*").alias("_r"))
    open_ = tests.select("test", "grade").join(credit_plan, "grade").join(done, ["test", "credits"], "left").withColumn("_n", F.col("n") - F.coalesce("_r", F.lit(0))).where("_n > 0")
    each = open_.select("test", "credits", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k"))
    place = lambda order: F.row_number().over(Window.partitionBy("test").orderBy(*order))
    dealt = each.withColumn("_i", place(["credits", "_k"])).drop("_k")
    cr = gone.where(F.col("type") == CONSTRUCTED).withColumn("_i", place(["item"])).join(dealt, ["test", "_i"], "left")
    mc = gone.where(F.coalesce(F.col("type") != CONSTRUCTED, F.lit(True)))
    return mc.select("test", "item", "session", "type", F.lit(1).alias("credits"), F.lit(BASIS_CHOICE).alias("basis")).unionByName(cr.select("test", "item", "session", "type", "credits", F.lit(BASIS_ORDER).alias("basis")))


def published(entries: DataFrame) -> DataFrame:
    """Entries that aren't drafts."""
    return entries.where(~F.coalesce("draft", F.lit(False)))


def aligned(items: DataFrame, by_standard: DataFrame, by_item: DataFrame, fields: list[str]) -> DataFrame:
    """items with ``fields`` from their standard's entry, replaced by those that their own entry has
    (``present``), and the basis: item-override, standard-default or unaligned. Drafts don't count."""
    s = published(by_standard).select("standard", F.lit(True).alias("_s"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    i = published(by_item).select("id", "present", *[F.col(f).alias(f"_i_{f}") for f in fields])
    met = items.join(s, "standard", "left").join(i, "id", "left")
    pick = [F.when(F.coalesce(F.array_contains("present", F.lit(f)), F.lit(False)), F.col(f"_i_{f}")).otherwise(F.col(f"_s_{f}")).alias(f) for f in fields]
    basis = F.when(F.col("present").isNotNull(), "item-override").when(F.col("_s"), "standard-default").otherwise("unaligned")
    return met.select(*[c for c in items.columns if c not in fields], *pick, basis.alias("alignment_basis"))


def with_content(items: DataFrame, content: DataFrame) -> DataFrame:
    """items with their reviewed transcription, and whether they have one."""
    mine = content.withColumn("_has", F.lit(True))
    return items.join(mine, "id", "left").withColumn("transcribed", F.coalesce("_has", F.lit(False))).drop("_has")


def cited_registry(registry: DataFrame, cited: DataFrame) -> DataFrame:
    """Registered codes that something cites or a test assesses, with whether anything cites them."""
    c = cited.select("code").distinct().withColumn("_cited", F.lit(True))
    met = registry.join(c, "code", "left").withColumn("ever_cited", F.coalesce("_cited", F.lit(False))).drop("_cited")
    return met.where(F.col("ever_cited") | (F.coalesce(F.size("assessed_on"), F.lit(0)) > 0))


def curriculum_units(units: DataFrame, pacing: DataFrame) -> DataFrame:
    """units (grade, unit, title) with their pacing, and whether the pacing table prints another title.

    pacing: grade, unit, title, days, mid_unit_assessment, all_optional, optional_lessons, start_week.
    """
    p = pacing.withColumnRenamed("title", "_title")
    met = units.join(p, ["grade", "unit"], "left")
    return met.withColumn("title_differs", F.coalesce(F.lower("_title") != F.lower("title"), F.lit(False))).drop("_title")


def curriculum_lessons(lessons: DataFrame, units: DataFrame) -> DataFrame:
    """lessons (grade, unit, lesson, title, ..) with whether the unit makes them optional."""
    u = units.select("grade", "unit", F.coalesce("all_optional", F.lit(False)).alias("_all"), "optional_lessons")
    some = F.coalesce(F.array_contains("optional_lessons", F.col("lesson")), F.lit(False))
    return lessons.join(u, ["grade", "unit"], "left").withColumn("optional", F.coalesce("_all", F.lit(False)) | some).drop("_all", "optional_lessons")


def counters(items: DataFrame, tests: DataFrame, withheld: DataFrame) -> DataFrame:
    """One row: the payload's counts."""
    a = items.agg(
        F.count("*").alias("released_items"), F.sum("credits").alias("released_credits"), F.count("pdf_page").alias("items_with_page"),
        F.count_if("post_test").alias("post_test_items"), F.array_sort(F.collect_set("grade")).alias("grades"), F.array_sort(F.collect_set("year")).alias("years"),
    )
    b = tests.agg(F.count("*").alias("tests"))
    c = withheld.agg(F.count("*").alias("withheld_items"))
    return a.join(F.broadcast(b), how="cross").join(F.broadcast(c), how="cross")  # one row each


def refused(df: DataFrame, found: DataFrame, what: str) -> DataFrame:
    """``df``; ValueError with the first faults if there are any."""
    some = [str(tuple(r)) for r in found.limit(6).collect()]
    if some:
        raise ValueError(f"{what}: " + "; ".join(some))
    return df


def without_field(df: DataFrame, column: str, field: str) -> DataFrame:
    """``df`` without one field of a struct column, or of an array of structs."""
    kind = df.schema[column].dataType
    if kind.typeName() == "array":
        return df.withColumn(column, F.transform(column, lambda x: x.dropFields(field)))
    return df.withColumn(column, F.col(column).dropFields(field))
