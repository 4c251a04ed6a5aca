"""One call from sheets to report tables: parse, identify, analyse, place, schedule, guard.

Everything is keyed by the sheet, so many sheets are one set of plans. A refusal is a value:
``status`` has a row per sheet and stage with ``usable`` and ``why``; a refused stage has no
rows in its tables. Tables of single students (scores, bands) stay inside; what comes out
is guarded.

items: test, item, id, grade, year, standard, domain, type (mc or cr), key, credits, p_value,
avg_points, post_test, course, unit, lesson, lesson_title, transcribed, answer. units: grade,
unit, title, start_week, mid_unit_assessment. lessons: grade, unit, lesson, title. taught:
grade, standard, unit (the publisher's table).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import half_up, placed_grade
from gradeloom.operators import analysis, quality, responses
from gradeloom.operators.itemstats import population_rate, scored
from gradeloom.operators.responses import Sheets
from gradeloom.operators.stored import checkpointed, free, recorded

#: A class is behind on constructed responses below this gap; credits and week
#: from which a unit without a mid-unit assessment is late.
WEAK_GAP, LATE_CREDITS, LATE_WEEK = -0.05, 4, 21
GATES = "gates-L2-L3"


@dataclass
class Data:
    """The published tables that sheets are read against."""

    items: DataFrame
    units: DataFrame
    lessons: DataFrame
    taught: DataFrame


@dataclass
class Report:
    """Report tables by name, each with the sheets' keys.

    What they are read from stays on the store until close(), or until the driver's JVM ends.
    """

    keys: tuple[str, ...]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    stored: list[str] = field(default_factory=list)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def close(self) -> None:
        """Frees what the report stored; its tables can't be read any more."""
        for df in list(self.tables.values())[:1]:
            free(df.sparkSession, self.stored)
        self.tables.clear()


def identified(sheets: Sheets, items: DataFrame) -> DataFrame:
    """(keys.., test, agree, published, total, unreleased, runner_up, accepted): the best test of
    every sheet with questions, among those with an item of theirs; ties to the first by name."""
    k = list(sheets.keys)
    asked = sheets.questions
    total = asked.groupBy(*k).agg(F.count("*").alias("total"))
    met = asked.join(items.select("test", F.col("item").alias("question"), F.col("standard").alias("_code")), "question")
    score = met.groupBy(*k, "test").agg(F.count_if(F.col("code") == F.col("_code")).alias("agree"), F.count("*").alias("published"))
    w = Window.partitionBy(*k).orderBy(F.col("agree").desc(), "test")  # one row per sheet and test
    ranked = score.select("*", F.row_number().over(w).alias("_r"), F.coalesce(F.lead("agree").over(w), F.lit(0)).alias("runner_up"))
    best = total.join(ranked.where("_r = 1").drop("_r"), k, "left")
    agree, published, runner = (F.coalesce(c, F.lit(0)) for c in ("agree", "published", "runner_up"))
    good = (agree >= analysis.LEAST_AGREE) & (agree * 5 >= published * 4) & (agree >= runner * 2)
    return best.select(*k, "test", agree.alias("agree"), published.alias("published"), "total", (F.col("total") - published).alias("unreleased"), runner.alias("runner_up"), good.alias("accepted"))


def sheet_items(sheets: Sheets, found: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items of each accepted sheet's test that it asks, with n, the students of the sheet;
    and its questions without a published item."""
    k = list(sheets.keys)
    accepted = found.where("accepted").select(*k, "test")
    roster = sheets.students.groupBy(*k).agg(F.count("*").alias("n"))
    asked = sheets.questions.join(accepted, k).withColumnRenamed("question", "item")
    known = asked.drop("code").join(items, ["test", "item"]).join(roster, k)
    return known, asked.join(items.select("test", "item"), ["test", "item"], "left_anti").select(*k, "item", F.col("code").alias("standard"))


def marked(sheets: Sheets, known: DataFrame) -> DataFrame:
    """Scored responses of the known items, with the student's section and level."""
    k = list(sheets.keys)
    r = sheets.responses.withColumnRenamed("question", "item").join(sheets.students, [*k, "student"])
    return scored(r, known, [*k, "item"])


def item_table(marks: DataFrame, known: DataFrame, k: list[str]) -> DataFrame:
    """One row per item: counts over all students of the sheet, rates, gap, the top wrong answer.

    Of wrong answers chosen equally often, the one seen first counts.
    """
    credits = F.coalesce("credits", F.lit(1))
    counts = marks.groupBy(*k, "item").agg(
        F.count_if("answered").alias("answered"),
        half_up(F.sum("points"), 2).alias("earned"),
        F.count_if("correct").alias("correct"),
        F.count_if(~F.col("mc") & (F.col("scored_points") >= credits)).alias("full_credit"),
        F.count_if(~F.col("mc") & (F.col("scored_points") == 0)).alias("zero_credit"),
    )
    wrong = marks.where(F.col("letter").isNotNull()).groupBy(*k, "item", "letter").agg(F.count("*").alias("_n"), F.min("student").alias("_first"))
    top = wrong.groupBy(*k, "item").agg(F.max_by(F.struct("letter", "_n"), F.struct(F.col("_n"), -F.col("_first"))).alias("_t"))
    out = known.join(counts, [*k, "item"], "left").join(top, [*k, "item"], "left")
    none = {c: F.coalesce(c, F.lit(0)) for c in ("answered", "correct", "full_credit", "zero_credit")} | {"earned": F.coalesce("earned", F.lit(0.0))}
    out = out.withColumns(none)
    class_p, state_p = F.col("earned") / (credits * F.col("n")), population_rate()
    return out.withColumns({
        "omitted": F.col("n") - F.col("answered"),
        "credits": credits,
        "top_wrong": F.col("_t.letter"),
        "top_wrong_count": F.coalesce("_t._n", F.lit(0)),
        "class_p": half_up(class_p),
        "state_p": half_up(state_p),
        "gap": half_up(class_p - state_p),
    }).drop("_t")


def _sums() -> list[Column]:
    """Credits earned, possible, and what the state would earn of them (a null rate earns none)."""
    possible = F.col("credits") * F.col("n")
    state = F.floor(F.coalesce("state_p", F.lit(0.0)) * 1000 + 0.5).cast("long") * possible
    return [F.sum(F.round(F.col("earned") * 100).cast("long")).alias("_e"), F.sum(possible).alias("possible"), F.sum(state).alias("_s")]


def rolled_up(stats: DataFrame, k: list[str], *keys: str) -> DataFrame:
    """(keys.., items, earned, possible, class_p, state_p, gap) of groups of items."""
    group = [*k, *keys]
    g = stats.where(F.col(keys[0]).isNotNull()) if keys else stats
    g = g.groupBy(*group).agg(F.array_sort(F.collect_list("item")).alias("items"), *_sums())
    rate, state = F.col("_e") / 100 / F.col("possible"), F.col("_s") / 1000 / F.col("possible")
    return g.select(*group, "items", (F.col("_e") / 100).alias("earned"), "possible", half_up(rate).alias("class_p"), half_up(state).alias("state_p"), half_up(half_up(rate) - half_up(state)).alias("gap"))


def overall(stats: DataFrame, k: list[str]) -> DataFrame:
    """Grand totals; the gap is that of the unrounded rates."""
    g = stats.groupBy(*k).agg(F.count("*").alias("matched"), F.first("n").alias("students"), F.sum("credits").alias("total_credits"), *_sums())
    rate, state = F.col("_e") / 100 / F.col("possible"), F.col("_s") / 1000 / F.col("possible")
    return g.select(*k, "matched", "students", "total_credits", half_up(F.col("_e") / 100, 1).alias("earned"), "possible", half_up(rate).alias("class_p"), half_up(state).alias("state_p"), half_up(rate - state).alias("gap"))


def section_tables(sheets: Sheets, marks: DataFrame, known: DataFrame, k: list[str]) -> tuple[DataFrame, DataFrame]:
    """(section, students, class_p) and (section, item, class_p), where a sheet has several sections."""
    rosters = sheets.students.where(F.col("section").isNotNull()).groupBy(*k, "section").agg(F.count("*").alias("students"))
    several = rosters.groupBy(*k).agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    rosters = rosters.join(several, k, "left_semi")
    got = marks.groupBy(*k, "section", "item").agg(F.sum("points").alias("_e"))
    every = known.select(*k, "item", F.coalesce("credits", F.lit(1)).alias("credits")).join(rosters, k)
    cells = every.join(got, [*k, "section", "item"], "left").withColumns({"_e": F.coalesce("_e", F.lit(0.0)), "_p": F.col("credits") * F.col("students")})
    per = cells.groupBy(*k, "section", "students").agg(F.sum(F.round(F.col("_e") * 100).cast("long")).alias("_e"), F.sum("_p").alias("_p"))
    return per.select(*k, "section", "students", half_up(F.col("_e") / 100 / F.col("_p")).alias("class_p")), cells.select(*k, "section", "item", half_up(F.col("_e") / F.col("_p")).alias("class_p"))


def raw_scores(sheets: Sheets, marks: DataFrame, k: list[str]) -> DataFrame:
    """(student, raw, level) of all students: inside only."""
    raw = marks.groupBy(*k, "student").agg(F.sum("points").alias("raw"))
    return sheets.students.join(raw, [*k, "student"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))


def curve_tables(raw: DataFrame, refused: DataFrame, totals: DataFrame, k: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Status, points, cuts, slopes per band, and scores nobody has, of every sheet.

    refused: (keys.., why) of the sheets whose curve can't be read at all.
    """
    with_level = raw.where(F.col("level").isNotNull())
    first = Window.partitionBy(*k, "raw").orderBy("student")
    seen = with_level.withColumn("_l", F.first("level").over(first))
    points = seen.groupBy(*k, "raw").agg(F.max("_l").alias("level"), F.count_if(F.abs(F.col("level") - F.col("_l")) > analysis.SAME_LEVEL).alias("_same"))
    w = Window.partitionBy(*k).orderBy("raw")  # one row per distinct score of a sheet
    steps = points.select("*", F.lead("raw").over(w).alias("raw2"), F.lead("level").over(w).alias("level2"))
    facts = steps.groupBy(*k).agg(F.count("*").alias("points"), (F.sum("_same") + F.count_if(F.col("level2") <= F.col("level"))).alias("conflicts"))
    facts = totals.select(*k, "total_credits").join(facts, k, "left").join(refused, k, "left")
    n = F.coalesce("points", F.lit(0))
    reason = F.coalesce(
        "why",
        F.when(n < analysis.LEAST_POINTS, F.concat(F.lit("too few distinct raw scores ("), n.cast("string"), F.lit(")"))),
        F.when(F.col("conflicts") > 0, F.concat(F.lit("the level is not a function of the raw score ("), F.col("conflicts").cast("string"), F.lit(" conflicts)"))),
    )
    status = facts.select(*k, reason.isNull().alias("usable"), reason.alias("why"), "total_credits")
    good = status.where("usable").select(*k, "total_credits")
    table = points.join(good, k).select(*k, "raw", "level", "total_credits")
    cuts = table.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in analysis.CUTS]))).groupBy(*k, "cut").agg(
        F.min(F.when(F.abs(F.col("level") - F.col("cut")) < analysis.SAME_LEVEL, F.col("raw"))).alias("_at"),
        F.max(F.when(F.col("level") < F.col("cut"), F.col("raw"))).alias("_lo"),
        F.min(F.when(F.col("level") > F.col("cut"), F.col("raw"))).alias("_hi"),
        F.first("total_credits").alias("_total"),
    )
    both, exact = F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), F.col("_at").isNotNull()
    at = F.when(exact, F.col("_at")).when(both, F.col("_hi"))
    cuts = cuts.select(*k, F.col("cut").alias("level"), at.alias("raw"), exact.alias("exact"), F.when(~exact & both, F.col("_lo")).alias("below"), half_up(at / F.col("_total") * 100, 1).alias("pct_of_test"))
    band = lambda c: analysis.level_band(F.when((c >= 1) & (c < 9), c))
    inside = steps.join(good, k, "left_semi").where(F.col("raw2").isNotNull() & (band(F.col("level")) == band(F.col("level2"))))
    rate = (F.col("level2") - F.col("level")) / (F.col("raw2") - F.col("raw"))
    got = inside.groupBy(*k, band(F.col("level")).alias("band")).agg(half_up(F.avg(rate)).alias("per_credit"), F.count("*").alias("segments"))
    every = good.select(*k, F.explode(F.array(*[F.lit(b) for b in analysis.BAND_NAMES])).alias("band"))
    slopes = every.join(got, [*k, "band"], "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    span = table.groupBy(*k).agg(F.min("raw").alias("_lo"), F.first("total_credits").alias("_hi")).where("_lo <= _hi")
    domain = span.select(*k, F.explode(F.sequence(F.ceil("_lo"), F.col("_hi").cast("long"))).alias("raw"))
    gaps = domain.join(table.select(*k, F.col("raw")), [*k, "raw"], "left_anti")
    return status.drop("total_credits"), table.drop("total_credits"), cuts, slopes, gaps


def gating_tables(sheets: Sheets, marks: DataFrame, known: DataFrame, k: list[str], threshold: float = analysis.GATING_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Status, band sizes, and (standard, credits, items, L1..L4, bucket) of the usable sheets."""
    accepted = known.select(*k).distinct()
    banded = sheets.students.where(F.col("level").isNotNull()).withColumn("band", analysis.level_band(F.col("level")))
    sizes = banded.join(accepted, k, "left_semi").groupBy(*k, "band").agg(F.count("*").alias("n"))
    wide = accepted.join(sizes.groupBy(*k).agg(*[F.coalesce(F.sum(F.when(F.col("band") == b, F.col("n"))), F.lit(0)).alias(b) for b in analysis.BAND_NAMES]), k, "left")
    wide = wide.join(sheets.levels.withColumn("_has", F.lit(True)), k, "left").withColumns({b: F.coalesce(b, F.lit(0)) for b in analysis.BAND_NAMES})
    total = sum((F.col(b) for b in analysis.BAND_NAMES), F.lit(0))
    small = F.array_compact(F.array(*[F.when(F.col(b) < analysis.MIN_BAND, F.lit(b)) for b in analysis.BAND_NAMES]))
    why = (
        F.when(F.col("_has").isNull(), "no level column")
        .when(total < 4 * analysis.MIN_BAND, "not enough students with a level to band")
        .when(F.size(small) > 0, F.concat(F.lit("too few students in "), F.array_join(small, ", ")))
    )
    status = wide.select(*k, why.isNull().alias("usable"), why.alias("why"))
    bands = wide.select(*k, F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("n")) for b in analysis.BAND_NAMES])).alias("_b")).select(*k, "_b.*")
    usable = status.where("usable").select(*k)
    got = marks.where(F.col("level").isNotNull()).groupBy(*k, "standard").agg(*[F.sum(F.when(analysis.level_band(F.col("level")) == b, F.col("points"))).alias(f"_e{b}") for b in analysis.BAND_NAMES])
    weight = known.groupBy(*k, "standard").agg(F.sum(F.coalesce("credits", F.lit(1))).alias("credits"), F.array_sort(F.collect_list("item")).alias("items"))
    met = weight.join(usable, k, "left_semi").join(got, [*k, "standard"], "left").join(wide.select(*k, *[F.col(b).alias(f"_n{b}") for b in analysis.BAND_NAMES]), k)
    rates = met.select(*k, "standard", "credits", "items", *[half_up(F.coalesce(f"_e{b}", F.lit(0.0)) / (F.col("credits") * F.col(f"_n{b}"))).alias(b) for b in analysis.BAND_NAMES])
    return status, bands, rates.withColumn("bucket", analysis.gating_bucket(threshold))


def focus_tables(stats: DataFrame, items: DataFrame, k: list[str]) -> tuple[DataFrame, DataFrame]:
    """Expected credits lost a year by standard, and by lesson of the sheet's own grade.

    A lesson takes each of its standards' rounded weights once.
    """
    group = [*k, "grade", "standard"]
    sums = stats.groupBy(*group).agg(F.array_sort(F.collect_list("item")).alias("items"), F.first("domain").alias("domain"), *_sums())
    years = items.groupBy("grade").agg(F.countDistinct("year").alias("of_years"))
    weights = items.groupBy("grade", "standard").agg(F.sum("credits").alias("_w"), F.countDistinct("year").alias("recurs"))
    met = sums.join(years, "grade").join(weights, ["grade", "standard"], "left").withColumns({"_w": F.coalesce("_w", F.lit(0)) / F.col("of_years"), "recurs": F.coalesce("recurs", F.lit(0))})
    rate, state = F.col("_e") / 100 / F.col("possible"), F.col("_s") / 1000 / F.col("possible")
    gap = rate - state
    lost = lambda w: F.when(gap < 0, half_up(-gap * w, 2)).otherwise(F.lit(0.0))
    rows = met.select(
        *k, "standard", "domain", "items", half_up(rate).alias("class_p"), half_up(state).alias("state_p"), half_up(gap).alias("gap"),
        half_up(F.col("_w"), 2).alias("credits_per_year"), "recurs", "of_years", lost(F.col("_w")).alias("credits_lost"),
    )
    own = stats.where(F.col("unit").isNotNull() & F.col("lesson").isNotNull() & (placed_grade(F.col("course")) == F.col("grade")))
    place = [*k, "unit", "lesson"]
    weight = own.select(*place, "standard").distinct().join(rows.select(*k, "standard", "credits_per_year"), [*k, "standard"]).groupBy(*place).agg(
        (F.sum(F.round(F.col("credits_per_year") * 100).cast("long")) / 100).alias("credits_per_year"), F.array_sort(F.collect_list("standard")).alias("standards")
    )
    lessons = own.groupBy(*place).agg(F.array_sort(F.collect_list("item")).alias("items"), *_sums()).join(weight, place)
    by_lesson = lessons.select(*place, "items", "standards", half_up(rate).alias("class_p"), half_up(state).alias("state_p"), half_up(gap).alias("gap"), "credits_per_year", lost(F.col("credits_per_year")).alias("credits_lost"))
    return rows, by_lesson


def placement_tables(known: DataFrame, data: Data, k: list[str]) -> dict[str, DataFrame]:
    """Where each standard is taught: its items' judged units, else the table's.

    placed: (standard, unit, basis, title, start_week, mid_unit_assessment, lessons, items_without_lesson);
    unplaced: (standard, status) of those in no unit, prior-grade apart; unjudged: items that
    name no unit of a standard whose other items do.
    """
    std = [*k, "grade", "standard"]
    own = known.withColumn("_u", F.when(placed_grade(F.col("course")) == F.col("grade"), F.col("unit")))
    judged = own.where(F.col("_u").isNotNull())
    per = judged.groupBy(*std, F.col("_u").alias("unit"), "lesson").agg(F.array_sort(F.collect_set("item")).alias("items"), F.min("lesson_title").alias("_title"))
    named = per.join(data.lessons.select("grade", "unit", "lesson", F.col("title").alias("_own")), ["grade", "unit", "lesson"], "left")
    record = F.when(F.col("lesson").isNotNull(), F.struct("lesson", F.coalesce("_own", "_title").alias("lesson_title"), "items"))
    units = named.groupBy(*std, "unit").agg(F.array_sort(F.collect_list(record)).alias("lessons"), F.coalesce(F.sum(F.when(F.col("lesson").isNull(), F.size("items"))), F.lit(0)).alias("items_without_lesson"))
    answered = judged.select(*std).distinct()
    rest = own.select(*std).distinct().join(answered, std, "left_anti")
    table = rest.join(data.taught.select("grade", "standard", "unit").distinct(), ["grade", "standard"])
    kind = units.schema["lessons"].dataType.simpleString()
    both = units.withColumn("basis", F.lit("judged")).unionByName(
        table.select(*std, "unit", F.array().cast(kind).alias("lessons"), F.lit(0).cast("long").alias("items_without_lesson"), F.lit("table").alias("basis"))
    )
    paced = both.join(data.units.select("grade", "unit", "title", "start_week", "mid_unit_assessment"), ["grade", "unit"], "left")
    lost = rest.join(table.select(*std).distinct(), std, "left_anti").join(own.groupBy(*std).agg(F.bool_or(F.coalesce("post_test", F.lit(False))).alias("_post")), std)
    prior = F.col("_post") | ~F.col("standard").startswith(F.concat(F.lit(responses.PREFIX), F.col("grade").cast("string"), F.lit(".")))
    unjudged = own.where(F.col("_u").isNull()).join(answered, std, "left_semi").select(*k, "standard", "item")
    return {
        "placement": paced.select(*k, "standard", "unit", "basis", "title", "start_week", F.coalesce("mid_unit_assessment", F.lit(False)).alias("mid_unit_assessment"), "lessons", "items_without_lesson"),
        "unplaced": lost.select(*k, "standard", F.when(prior, "prior-grade").otherwise("unplaced").alias("status")),
        "unjudged_items": unjudged,
    }


def gating_units(gating: DataFrame, placement: DataFrame, k: list[str]) -> DataFrame:
    """(unit, title, start_week, credits, standards, distinct_credits, double_counted) of the
    standards that gate proficiency; one taught in several units counts in each."""
    gates = gating.where(F.col("bucket") == GATES)
    per = gates.join(placement.select(*k, "standard", "unit", "title", "start_week"), [*k, "standard"]).groupBy(*k, "unit", "title", "start_week").agg(F.sum("credits").alias("credits"), F.array_sort(F.collect_set("standard")).alias("standards"))
    total = gates.groupBy(*k).agg(F.sum("credits").alias("distinct_credits"))
    everything = F.sum("credits").over(Window.partitionBy(*k))  # one row per unit
    return per.join(total, k).withColumn("double_counted", everything != F.col("distinct_credits"))


def checkpoint_tables(stats: DataFrame, gating: DataFrame, gate_status: DataFrame, focus: DataFrame, placement: DataFrame, items: DataFrame, k: list[str]) -> dict[str, DataFrame]:
    """Released questions that check the gating standards, scheduled in the first unit of each.

    One item a standard, two for the third that costs most, six a unit; a standard's items
    are taken in order, constructed ones first where the class is weak on them.
    """
    gates = gating.where(F.col("bucket") == GATES).select(*k, "standard", "credits")
    status = gate_status.join(gates.select(*k).distinct().withColumn("_some", F.lit(True)), k, "left")
    why = F.coalesce("why", F.when(F.col("_some").isNull(), F.lit("no standard gates proficiency")))
    status = status.select(*k, why.isNull().alias("usable"), why.alias("why"))
    w = Window.partitionBy(*k, "standard").orderBy(F.coalesce("start_week", F.lit(99)), "unit")
    first = placement.select(*k, "standard", "unit", "title", "start_week", "mid_unit_assessment", F.row_number().over(w).alias("_r")).where("_r = 1").drop("_r")
    lost = focus.select(*k, "standard", "credits_lost")
    wanted = gates.join(first, [*k, "standard"], "left").join(lost, [*k, "standard"], "left").withColumn("credits_lost", F.coalesce("credits_lost", F.lit(0.0)))
    order = [F.col("credits_lost").desc(), F.col("standard").asc()]
    top = F.row_number().over(Window.partitionBy(*k).orderBy(*order)) <= F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy(*k)) / 3))
    wanted = wanted.withColumn("wish", F.when(top, 2).otherwise(1))
    unschedulable = wanted.where("unit IS NULL").select(*k, "standard")
    wanted = wanted.where("unit IS NOT NULL")
    weak = stats.where("type = 'cr'").groupBy(*k, "standard").agg(F.bool_or(F.coalesce(F.col("gap") < WEAK_GAP, F.lit(False))).alias("_weak"))
    grades = stats.select(*k, "grade").distinct()
    markable = F.when(F.col("type") == "mc", F.col("key").isNotNull()).otherwise(F.col("answer").isNotNull())
    pool = items.where(F.coalesce("transcribed", F.lit(False)) & markable).select("id", "grade", "standard", "type", "p_value", "year")
    offered = wanted.select(*k, "standard").join(grades, k).join(pool, ["grade", "standard"]).join(weak, [*k, "standard"], "left")
    later = F.when(F.coalesce("_weak", F.lit(False)) & (F.col("type") == "mc"), 1).otherwise(0)
    rank = F.row_number().over(Window.partitionBy(*k, "standard").orderBy(later, F.coalesce("p_value", F.lit(1.0)), F.col("year").desc(), "id"))
    offered = offered.withColumn("_n", rank)
    supply = offered.groupBy(*k, "standard").agg(F.count("*").alias("_have"))
    line = Window.partitionBy(*k, "unit").orderBy(*order)
    wanted = wanted.join(supply, [*k, "standard"], "left").withColumn("_take", F.least("wish", F.coalesce("_have", F.lit(0))))
    before = F.coalesce(F.sum("_take").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a standard may take what the ones before it leave of the cap
    wanted = wanted.withColumns({"rank": F.row_number().over(line), "want": F.greatest(F.least(F.col("wish"), F.lit(analysis.CHECKPOINT_CAP) - before), F.lit(0))})
    wanted = wanted.withColumn("got", F.least("want", "_take"))
    picked = wanted.join(offered.select(*k, "standard", "id", "type", "_n"), [*k, "standard"]).where(F.col("_n") <= F.col("got"))
    place = F.row_number().over(Window.partitionBy(*k, "unit").orderBy("rank", "_n"))
    many = F.count("*").over(Window.partitionBy(*k, "unit"))
    early = F.col("mid_unit_assessment") & (many > 1) & (place <= F.ceil(many / 2))
    chosen = picked.select(*k, "unit", "standard", "id", "type", place.alias("place"), F.when(early, "mid-unit assessment").otherwise("unit assessment").alias("when"))
    units = wanted.groupBy(*k, "unit", "title", "start_week", "mid_unit_assessment").agg(F.sum("credits").alias("gating_credits"), F.sum("got").alias("n_items"))
    late = ~F.col("mid_unit_assessment") & (F.col("gating_credits") >= LATE_CREDITS) & F.coalesce(F.col("start_week") >= LATE_WEEK, F.lit(False))
    return {
        "checkpoint_status": status,
        "checkpoint_units": units.withColumn("late_without_mid", late),
        "checkpoint_items": chosen,
        "thin_supply": wanted.where("got < want").select(*k, "standard", F.col("want").alias("wanted"), "got"),
        "unschedulable": unschedulable,
    }


def _stored(s: Sheets) -> Sheets:
    return Sheets(s.keys, *(checkpointed(x) for x in (s.status, s.questions, s.students, s.responses, s.levels)))


def run(cells: DataFrame, data: Data, *keys: str, threshold: float = analysis.GATING_THRESHOLD) -> Report:
    """The whole report of all sheets in ``cells``.

    status: (keys.., stage, usable, why) of parse, identify, curve, gating and checkpoints; a
    stage of a sheet that an earlier one refused has no row. Student tables don't leave this
    function; the schemas of the others are guarded here, their values by ``guarded``. The
    report's close() frees what it stored; a run that fails frees it at once.
    """
    with recorded() as own:
        try:
            return Report(*_tables(cells, data, keys, threshold), own)
        except BaseException:
            free(cells.sparkSession, own)
            raise


def _tables(cells: DataFrame, data: Data, keys: tuple[str, ...], threshold: float) -> tuple[tuple[str, ...], dict[str, DataFrame]]:
    # what many tables read is computed once, and lineage ends there
    sheets = _stored(responses.parse(checkpointed(cells), *keys))
    k = list(sheets.keys)
    found = checkpointed(identified(sheets, data.items).join(sheets.status.where("usable").select(*k), k, "left_semi"))
    known, unmatched = (checkpointed(x) for x in sheet_items(sheets, found, data.items))
    marks = checkpointed(marked(sheets, known))
    stats = checkpointed(item_table(marks, known, k))
    totals = overall(stats, k)
    sections, section_items = section_tables(sheets, marks, known, k)
    no_level = totals.select(*k).join(sheets.levels, k, "left_anti").withColumn("why", F.lit("no level column"))
    partial = unmatched.groupBy(*k).agg(F.count("*").alias("_u")).join(no_level, k, "left_anti")
    refused = no_level.unionByName(partial.select(*k, F.concat(F.col("_u").cast("string"), F.lit(" scored questions were not released")).alias("why")))
    curve_status, points, cuts, slopes, unobserved = curve_tables(raw_scores(sheets, marks, k), refused, totals, k)
    gate_status, bands, gating = gating_tables(sheets, marks, known, k, threshold)
    gate_status, gating = checkpointed(gate_status), checkpointed(gating)
    focus, by_lesson = focus_tables(stats, data.items, k)
    focus = checkpointed(focus)
    places = placement_tables(known, data, k)
    places["placement"] = checkpointed(places["placement"])
    checks = checkpoint_tables(stats, gating, gate_status, focus, places["placement"], data.items, k)
    why = F.when(~F.col("accepted"), F.concat(F.lit("no clear match: "), F.col("agree").cast("string"), F.lit(" of "), F.col("published").cast("string"), F.lit(" published questions agree, the runner-up has "), F.col("runner_up").cast("string")))
    stage = lambda df, name: df.select(*k, F.lit(name).alias("stage"), "usable", "why")
    status = stage(sheets.status, "parse").unionByName(stage(found.select(*k, F.col("accepted").alias("usable"), why.alias("why")), "identify"))
    for name, df in (("curve", curve_status), ("gating", gate_status), ("checkpoints", checks.pop("checkpoint_status"))):
        status = status.unionByName(stage(df, name))
    items = stats.select(
        *k, "item", "standard", "domain", "type", "credits", "n", "answered", "omitted", "earned", "correct", "full_credit", "zero_credit", "class_p", "state_p", "gap", "top_wrong", "top_wrong_count", "unit", "lesson"
    )
    tables = {
        "status": status, "identify": found, "unmatched": unmatched, "overall": totals, "items": items,
        "dominant": items.where((F.col("type") == "mc") & (F.col("top_wrong_count") * 4 >= F.col("n"))),
        "constructed": items.where("type = 'cr'"), "omissions": items.where("omitted > 0"),
        "by_standard": rolled_up(stats, k, "standard"), "by_domain": rolled_up(stats, k, "domain"),
        "sections": sections, "section_items": section_items,
        "curve": points, "curve_cuts": cuts, "curve_slopes": slopes, "unobserved": unobserved,
        "bands": bands, "gating": gating, "focus": focus, "focus_lessons": by_lesson,
        **places, "gating_by_unit": gating_units(gating, places["placement"], k), **checks,
    }
    for name, df in tables.items():
        if bad := quality.banned_fields(df, quality.BANNED_REPORT):
            raise ValueError(f"{name}: {', '.join(bad)} are fields of single students")
    return sheets.keys, tables


def ordered(report: Report, name: str) -> DataFrame:
    """A table in its reading order: by gap, most chosen wrong answer, most lost, and so on."""
    up, down = (lambda c: F.col(c).asc()), (lambda c: F.col(c).desc())
    gap = F.coalesce(F.col("gap"), F.lit(1.0)).asc()
    orders = {
        "items": [gap, up("item")], "by_standard": [gap, up("standard")], "by_domain": [gap, up("domain")],
        "dominant": [down("top_wrong_count"), up("item")], "constructed": [down("zero_credit"), up("item")], "omissions": [down("omitted"), up("item")],
        "focus": [down("credits_lost"), up("standard")], "focus_lessons": [down("credits_lost"), up("unit"), up("lesson")],
        "gating": [*analysis.gating_order(), up("standard")], "gating_by_unit": [down("credits"), up("unit")],
    }
    return report[name].orderBy(*report.keys, *orders[name])


def guarded(report: Report) -> Report:
    """The report; ValueError if a text in one of its tables could identify somebody."""
    for name, df in report.tables.items():
        quality.assert_private(df, exempt=report.keys, banned=quality.BANNED_REPORT, label=name)
    return report
