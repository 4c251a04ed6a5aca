"""Analyses over scored tests: identification, level curve, focus, gating, placement, schedule.

A refusal is a value: results carry ``usable`` and ``why`` instead of raising.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import half_up
from gradeloom.operators.itemstats import scored

# --- identification ----------------------------------------------------------------

#: Fixed value: agreements that a match needs, besides four fifths and twice the runner-up.
LEAST_AGREE = 10


def identify(headers: DataFrame, published: DataFrame) -> DataFrame:
    """Scores every test by how many of its items carry the header's code.

    headers: (item, code); published: (test, item, code). Returns test, agree, published,
    rank, runner_up, accepted: ten agreements at least, four fifths of what the test
    published, twice the runner-up.
    """
    met = published.join(headers.select("item", F.col("code").alias("_code")), "item")
    score = met.groupBy("test").agg(F.count_if(F.col("code") == F.col("_code")).alias("agree"), F.count("*").alias("published"))
    # one row per test: a small table
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("agree").desc(), "test")
    ranked = score.select("*", F.row_number().over(w).alias("rank"), F.coalesce(F.lead("agree").over(w), F.lit(0)).alias("runner_up"))
    good = (F.col("agree") >= LEAST_AGREE) & (F.col("agree") * 5 >= F.col("published") * 4) & (F.col("agree") >= F.col("runner_up") * 2)
    return ranked.withColumn("accepted", good & (F.col("rank") == 1))


# --- level curve -------------------------------------------------------------------

#: Levels agree within SAME_LEVEL; a curve needs LEAST_POINTS scores.
SAME_LEVEL, LEAST_POINTS = 0.005, 6
CUTS = (2, 3, 4)
BANDS = (("L1", 1, 2), ("L2", 2, 3), ("L3", 3, 4), ("L4", 4, 9))


def curve_points(students: DataFrame, order: str = "student") -> DataFrame:
    """(raw, level, conflicts): per raw score, the first level seen and the rows that differ."""
    first = students.where(F.col("raw").isNotNull() & F.col("level").isNotNull())
    w = Window.partitionBy("raw").orderBy(order)
    marked = first.withColumn("_first", F.first("level").over(w))
    return marked.groupBy("raw").agg(F.max("_first").alias("level"), F.count_if(F.abs(F.col("level") - F.col("_first")) > SAME_LEVEL).alias("conflicts"))


def _steps(points: DataFrame) -> DataFrame:
    """Neighbouring points; there are as many rows as distinct raw scores."""
    w = Window.partitionBy(F.lit(0)).orderBy("raw")
    return points.select("raw", "level", F.lead("raw").over(w).alias("raw2"), F.lead("level").over(w).alias("level2"))


def curve_status(points: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """(points, conflicts, usable, why): conflicts also count steps that don't rise."""
    falls = _steps(points).agg(F.count_if(F.col("level2") <= F.col("level")).alias("falls"))
    total = points.agg(F.count("*").alias("points"), F.coalesce(F.sum("conflicts"), F.lit(0)).alias("same"))
    both = total.join(F.broadcast(falls), how="cross")
    conflicts = F.col("same") + F.col("falls")
    few = F.col("points") < least_points
    why = F.when(few, "too few distinct raw scores").when(conflicts > 0, "the level is not a function of the raw score")
    return both.select("points", conflicts.alias("conflicts"), (~few & (conflicts == 0)).alias("usable"), why.alias("why"))


def curve_cuts(points: DataFrame, cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """(cut, raw, exact, below): the lowest raw score at a level, else the bracket around it."""
    levels = points.sparkSession.createDataFrame([(float(c),) for c in cuts], "cut double")
    met = points.join(F.broadcast(levels), how="cross").groupBy("cut").agg(
        F.min(F.when(F.abs(F.col("level") - F.col("cut")) < SAME_LEVEL, F.col("raw"))).alias("at"),
        F.max(F.when(F.col("level") < F.col("cut"), F.col("raw"))).alias("lo"),
        F.min(F.when(F.col("level") > F.col("cut"), F.col("raw"))).alias("hi"),
    )
    both = F.col("lo").isNotNull() & F.col("hi").isNotNull()
    exact = F.col("at").isNotNull()
    raw = F.when(exact, F.col("at")).when(both, F.col("hi"))
    return met.select("cut", raw.alias("raw"), exact.alias("exact"), F.when(~exact & both, F.col("lo")).alias("below"))


def curve_slopes(points: DataFrame) -> DataFrame:
    """(band, per_credit, segments): mean slope of the steps with both ends in a band."""
    band = lambda c: _band(c)
    steps = _steps(points).where("raw2 IS NOT NULL").withColumn("band", band(F.col("level"))).where(F.col("band") == band(F.col("level2")))
    slope = (F.col("level2") - F.col("level")) / (F.col("raw2") - F.col("raw"))
    return steps.groupBy("band").agg(half_up(F.avg(slope)).alias("per_credit"), F.count("*").alias("segments"))


def _band(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in BANDS:
        out = F.when((level >= lo) & (level < hi), name).otherwise(out)
    return out


def unobserved(points: DataFrame, total: int) -> DataFrame:
    """Raw scores from the least observed to ``total`` that nobody has."""
    span = points.agg(F.min("raw").cast("int").alias("lo")).where(F.col("lo") <= total)
    every = span.select(F.explode(F.sequence(F.col("lo"), F.lit(total))).alias("raw"))
    return every.join(points.select(F.col("raw").cast("int").alias("raw")), "raw", "left_anti")


def credits_to_reach(points: DataFrame, asks: DataFrame) -> DataFrame:
    """asks (from_level, to_level) plus from_raw, to_raw, credits: from the highest point at or
    below the one (else the lowest) to the first strictly above the other."""
    # asks is a small table of questions; points has one row per distinct raw score
    met = points.join(F.broadcast(asks), how="cross").groupBy(*asks.columns).agg(
        F.coalesce(F.max(F.when(F.col("level") <= F.col("from_level"), F.col("raw"))), F.min("raw")).alias("from_raw"),
        F.min(F.when(F.col("level") > F.col("to_level"), F.col("raw"))).alias("to_raw"),
    )
    return met.withColumn("credits", F.greatest(F.col("to_raw") - F.col("from_raw"), F.lit(0)))


# --- focus -------------------------------------------------------------------------


def yearly_weight(items: DataFrame, key: str = "standard", year: str = "year") -> DataFrame:
    """(key, mean_credits, recurs, years): mean over all years, those without included."""
    years = items.agg(F.countDistinct(year).alias("years"))
    per = items.groupBy(key).agg(F.sum("credits").alias("credits"), F.countDistinct(year).alias("recurs"))
    return per.join(F.broadcast(years), how="cross").select(key, (F.col("credits") / F.col("years")).alias("mean_credits"), "recurs", "years")


def focus(rollup: DataFrame, weights: DataFrame, key: str = "standard") -> DataFrame:
    """Expected credits lost per year: the unrounded gap times the unrounded weight, if negative.

    rollup: key, earned, possible, state_earned (all exact).
    """
    gap = (F.col("earned") - F.col("state_earned")) / F.col("possible")
    lost = F.when(gap < 0, half_up(-gap * F.col("mean_credits"), 2)).otherwise(F.lit(0.0))
    return rollup.join(weights, key).select(
        key, half_up(gap).alias("gap"), half_up(F.col("mean_credits"), 2).alias("credits_per_year"), "recurs", F.col("years").alias("of_years"), lost.alias("credits_lost")
    )


def focus_by_lesson(focus_rows: DataFrame, placed: DataFrame, key: str = "standard") -> DataFrame:
    """(unit, lesson, standards, credits_lost): a standard counts once per lesson, and in each
    lesson that teaches it; sums are over the rounded figures."""
    met = placed.select("unit", "lesson", key).distinct().join(focus_rows, key)
    return met.groupBy("unit", "lesson").agg(F.count("*").alias("standards"), F.sum(F.floor(F.col("credits_lost") * 100 + 0.5).cast("long")).alias("_c")).select(
        "unit", "lesson", "standards", (F.col("_c") / 100).alias("credits_lost")
    )


# --- gating ------------------------------------------------------------------------

#: Fixed values.
GATING_THRESHOLD, MIN_BAND = 0.6, 5
BAND_NAMES = ("L1", "L2", "L3", "L4")
BUCKET_ORDER = ("gates-L2-L3", "gates-L1-L2", "gates-L3-L4", "weak-for-all", "mixed", "solid")


def level_band(level: Column) -> Column:
    return F.when(level < 2, "L1").when(level < 3, "L2").when(level < 4, "L3").when(level.isNotNull(), "L4")


def band_sizes(students: DataFrame) -> DataFrame:
    """(band, n) and usable: every band holds MIN_BAND students."""
    names = students.sparkSession.createDataFrame([(b,) for b in BAND_NAMES], "band string")
    n = students.where(F.col("level").isNotNull()).groupBy(level_band(F.col("level")).alias("band")).agg(F.count("*").alias("n"))
    full = names.join(n, "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("usable", F.min("n").over(Window.partitionBy(F.lit(0))) >= MIN_BAND)  # four rows


def band_gating(responses: DataFrame, items: DataFrame, key: str = "standard", threshold: float = GATING_THRESHOLD) -> DataFrame:
    """(key, credits, L1..L4, bucket): each band's rate on each standard and where it turns.

    responses carry ``band``. Thresholds compare rounded rates.
    """
    s = scored(responses, items).where(F.col("band").isNotNull())
    credits = F.coalesce("credits", F.lit(1))
    per = s.groupBy(key).agg(
        *[F.sum(F.when(F.col("band") == b, F.col("points"))).alias(f"e{b}") for b in BAND_NAMES],
        *[F.sum(F.when(F.col("band") == b, credits)).alias(f"p{b}") for b in BAND_NAMES],
    )
    weight = items.groupBy(key).agg(F.sum(F.coalesce("credits", F.lit(1))).alias("credits"))
    rates = per.join(weight, key).select(key, "credits", *[half_up(F.col(f"e{b}") / F.col(f"p{b}")).alias(b) for b in BAND_NAMES])
    return rates.withColumn("bucket", gating_bucket(threshold))


def gating_bucket(t: float = GATING_THRESHOLD) -> Column:
    """From the rates in columns L1..L4; a null rate is neither above nor below."""
    up = {b: F.coalesce(F.col(b) >= t, F.lit(False)) for b in BAND_NAMES}
    down = {b: F.coalesce(F.col(b) < t, F.lit(False)) for b in BAND_NAMES}
    every = lambda x: x["L1"] & x["L2"] & x["L3"] & x["L4"]
    return (
        F.when(every(up), "solid")
        .when(every(down), "weak-for-all")
        .when(up["L2"] & down["L1"], "gates-L1-L2")
        .when(up["L3"] & down["L2"], "gates-L2-L3")
        .when(up["L4"] & down["L3"], "gates-L3-L4")
        .otherwise("mixed")
    )


def gating_order() -> list[Column]:
    """Sort keys: the bucket's place, then credits downwards."""
    return [F.array_position(F.array(*[F.lit(b) for b in BUCKET_ORDER]), F.col("bucket")).asc(), F.col("credits").desc()]


def gating_by_unit(gating: DataFrame, placed: DataFrame, key: str = "standard", bucket: str = "gates-L2-L3") -> DataFrame:
    """(unit, credits, standards, distinct_credits, double_counted): a standard taught in
    several units counts in each; the distinct total stands beside."""
    gates = gating.where(F.col("bucket") == bucket)
    per = gates.join(placed.select("unit", key).distinct(), key).groupBy("unit").agg(F.sum("credits").alias("credits"), F.count("*").alias("standards"))
    total = gates.agg(F.coalesce(F.sum("credits"), F.lit(0)).alias("distinct_credits"))
    everything = F.sum("credits").over(Window.partitionBy(F.lit(0)))  # one row per unit
    return per.join(F.broadcast(total), how="cross").withColumn("double_counted", everything != F.col("distinct_credits"))


# --- placement ---------------------------------------------------------------------


def placed_items(items: DataFrame, judged: DataFrame, table: DataFrame, grade: Column) -> DataFrame:
    """(item, unit, basis): a judgement in the item's own grade wins, else the table's units.

    judged: (item, judged_grade, unit); table: (standard, unit). A judgement in another
    grade is passed over; an item that neither places has a null unit and basis
    ``unplaced``.
    """
    own = items.join(judged.withColumnRenamed("unit", "judged_unit"), "item", "left").withColumn(
        "_judged", F.when((F.col("judged_grade") == grade) & F.col("judged_unit").isNotNull(), F.col("judged_unit"))
    )
    by_table = own.join(table.select("standard", F.col("unit").alias("table_unit")).distinct(), "standard", "left")
    unit = F.coalesce("_judged", "table_unit")
    basis = F.when(F.col("_judged").isNotNull(), "judged").when(F.col("table_unit").isNotNull(), "table").otherwise("unplaced")
    return by_table.select("item", unit.alias("unit"), basis.alias("basis")).distinct()


def explorer_units(items: DataFrame, judged: DataFrame, derived: DataFrame) -> DataFrame:
    """(item, units): the judged unit; none if judged in another grade; else the derived units.

    derived: (standard, units).
    """
    met = items.join(judged, "item", "left").join(derived, "standard", "left")
    none = F.array().cast("array<string>")
    units = F.when(F.col("judged_grade") == F.col("grade"), F.array(F.col("unit").cast("string"))).when(F.col("judged_grade").isNotNull(), none).otherwise(F.coalesce("units", none))
    return met.select("item", units.alias("units"))


def earliest_unit(placed: DataFrame, key: str = "standard") -> DataFrame:
    """(key, unit, start_week): the unit in which a standard comes first; no week is 99."""
    w = Window.partitionBy(key).orderBy(F.coalesce("start_week", F.lit(99)), "unit")
    return placed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# --- checkpoints -------------------------------------------------------------------

CHECKPOINT_CAP = 6


def checkpoint_wants(gates: DataFrame, cap: int = CHECKPOINT_CAP, key: str = "standard") -> DataFrame:
    """(unit, key, rank, want): one item per standard, two for the top third by credits lost,
    never more than ``cap`` in a unit.

    gates: unit, key, credits_lost: one row per gating standard.
    """
    overall_ = Window.partitionBy(F.lit(0)).orderBy(F.col("credits_lost").desc(), key)  # one row per standard
    count = F.count("*").over(Window.partitionBy(F.lit(0)))
    ranked = gates.withColumn("_top", F.row_number().over(overall_) <= F.greatest(F.lit(1), F.ceil(count / 3)))
    per = Window.partitionBy("unit").orderBy(F.col("credits_lost").desc(), key)
    wish = F.when(F.col("_top"), 2).otherwise(1)
    return ranked.withColumns({"rank": F.row_number().over(per), "wish": wish}).withColumn("supply", F.least("wish", F.coalesce("available", F.lit(2)))).withColumn(
        "before", F.coalesce(F.sum("supply").over(per.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("unit", key, "rank", F.greatest(F.least(F.col("wish"), F.lit(cap) - F.col("before")), F.lit(0)).cast("int").alias("want"), "credits_lost")


def checkpoint_items(wants: DataFrame, pool: DataFrame, key: str = "standard") -> DataFrame:
    """The items picked per standard: constructed responses first where ``weak_cr``, then the
    hardest, then the latest year.

    pool: key, id, type, p_value, year, weak_cr.
    """
    first = F.when(F.col("weak_cr") & (F.col("type") == "mc"), 1).otherwise(0)
    w = Window.partitionBy(key).orderBy(first, F.coalesce("p_value", F.lit(1.0)), F.col("year").desc(), "id")
    return wants.join(pool.withColumn("_n", F.row_number().over(w)), key).where(F.col("_n") <= F.col("want")).drop("_n")


def thin_supply(wants: DataFrame, picked: DataFrame, key: str = "standard") -> DataFrame:
    """Standards with fewer items than wanted (after the cap)."""
    got = picked.groupBy(key).agg(F.count("*").alias("got"))
    return wants.join(got, key, "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") < F.col("want")).select(key, "want", "got")


def assessment_sets(picked: DataFrame, mid_unit: str = "mid_unit_assessment") -> DataFrame:
    """Adds when: the first half goes with the mid-unit assessment, if there is one and more
    than one item."""
    w = Window.partitionBy("unit").orderBy("rank", "id")
    n = F.count("*").over(Window.partitionBy("unit"))
    half = F.ceil(n / 2)
    early = F.col(mid_unit) & (n > 1) & (F.row_number().over(w) <= half)
    return picked.withColumn("when", F.when(early, "mid-unit assessment").otherwise("unit assessment"))


def late_without_mid(units: DataFrame, credits: int = 4, week: int = 21) -> DataFrame:
    return units.where(~F.col("mid_unit_assessment") & (F.col("gating_credits") >= credits) & (F.col("start_week") >= week))
