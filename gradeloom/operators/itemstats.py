"""Item statistics: scoring, grouped counts, wrong answers, rates against the population.

Responses are long rows (student, item, value); items carry type (``mc`` or ``cr``), key,
credits and population rates. Credits default to 1 where they divide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import half_up, leading_number


def scored(responses: DataFrame, items: DataFrame, item: str = "item") -> DataFrame:
    """Responses to known items with mc, answered, correct, points and letter.

    A null value is omitted; a constructed response that doesn't start with a number is
    omitted too.
    """
    r = responses.join(items, item)
    mc = F.col("type") == "mc"
    points = leading_number(F.col("value"))
    right = F.coalesce(F.upper("value") == F.upper("key"), F.lit(False))
    credits = F.coalesce("credits", F.lit(1))
    return r.withColumns({
        "mc": mc,
        "answered": F.when(mc, F.col("value").isNotNull()).otherwise(points.isNotNull()),
        "correct": mc & right,
        "points": F.when(mc, F.when(right, credits.cast("double")).otherwise(0.0)).otherwise(F.coalesce(points, F.lit(0.0))),
        "letter": F.when(mc & F.col("value").isNotNull() & ~right, F.upper("value")),
        "scored_points": points,
    })


def unmatched(responses: DataFrame, items: DataFrame, item: str = "item") -> DataFrame:
    """Items that were answered but have no key: named, never scored."""
    return responses.select(item).distinct().join(items, item, "left_anti")


def population_rate() -> Column:
    """mc: the p-value; cr: average points over credits, else the p-value."""
    credits = F.coalesce("credits", F.lit(1))
    return F.when(F.col("type") == "mc", F.col("p_value")).otherwise(F.coalesce(F.col("avg_points") / credits, F.col("p_value")))


def item_stats(responses: DataFrame, items: DataFrame, roster: int | DataFrame | None = None, item: str = "item") -> DataFrame:
    """One row per item: counts, class and population rate, gap.

    The denominator is everyone on the roster, answered or not: a number, or a table of
    students; without it, the rows of the item.
    """
    s = scored(responses, items, item)
    agg = s.groupBy(item).agg(
        F.count("*").alias("n_rows"),
        F.count_if("answered").alias("answered"),
        F.sum("points").alias("earned"),
        F.count_if("correct").alias("correct"),
        F.count_if(~F.col("mc") & (F.col("scored_points") >= F.coalesce("credits", F.lit(1)))).alias("full_credit"),
        F.count_if(~F.col("mc") & (F.col("scored_points") == 0)).alias("zero_credit"),
    )
    if isinstance(roster, DataFrame):
        agg = agg.join(F.broadcast(roster.agg(F.count("*").alias("n"))), how="cross")  # one row
    else:
        agg = agg.withColumn("n", F.lit(roster).cast("long") if roster is not None else F.col("n_rows"))
    out = agg.join(items, item)
    credits = F.coalesce("credits", F.lit(1))
    class_p = F.when(F.col("n") > 0, F.col("earned") / (credits * F.col("n")))
    return out.select(
        item,
        *[c for c in items.columns if c != item],
        "n",
        "answered",
        (F.col("n") - F.col("answered")).alias("omitted"),
        "earned",
        "correct",
        "full_credit",
        "zero_credit",
        half_up(class_p).alias("class_p"),
        half_up(population_rate()).alias("state_p"),
        half_up(class_p - population_rate()).alias("gap"),
    )


def wrong_answers(responses: DataFrame, items: DataFrame, item: str = "item") -> DataFrame:
    """(item, letter, n): the histogram of wrong choices."""
    return scored(responses, items, item).where(F.col("letter").isNotNull()).groupBy(item, "letter").agg(F.count("*").alias("n"))


def top_wrong(histogram: DataFrame, item: str = "item", first: str | None = None) -> DataFrame:
    """The most chosen wrong answer; ties go to the least ``first`` (a row number), else letter."""
    order = [F.col("n").desc(), F.col(first).asc() if first else F.col("letter").asc()]
    rank = F.row_number().over(Window.partitionBy(item).orderBy(*order))
    return histogram.withColumn("_r", rank).where("_r = 1").select(item, F.col("letter").alias("top_wrong"), F.col("n").alias("top_wrong_count"))


def dominant(stats: DataFrame, top: DataFrame, item: str = "item") -> DataFrame:
    """mc items where a quarter of the roster or more chose one wrong answer."""
    return stats.where(F.col("type") == "mc").join(top, item).where(F.col("top_wrong_count") * 4 >= F.col("n"))


def choice_tally(choices: DataFrame, histogram: DataFrame, item: str = "item") -> DataFrame:
    """Every printed choice with its count, zeros included."""
    return choices.join(histogram, [item, "letter"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rollup(stats: DataFrame, *keys: str, item: str = "item") -> DataFrame:
    """Rates of groups of items, on the credits of all their items.

    A null population rate adds nothing to the sum while its credits stay in the
    denominator. Rows with a null key are left out.
    """
    possible = F.coalesce("credits", F.lit(1)) * F.col("n")
    g = stats.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_items"),
        F.sum("earned").alias("earned"),
        F.sum(possible).alias("possible"),
        F.sum(F.floor(F.coalesce("state_p", F.lit(0.0)) * 1000 + 0.5).cast("long") * possible).alias("_state"),
    )
    cls, state = half_up(F.col("earned") / F.col("possible")), half_up(F.col("_state") / 1000 / F.col("possible"))
    return g.select(*keys, "n_items", "earned", "possible", cls.alias("class_p"), state.alias("state_p")).withColumn("gap", half_up(F.col("class_p") - F.col("state_p")))


def section_rates(responses: DataFrame, items: DataFrame, section: str = "section", item: str = "item") -> DataFrame:
    """(section, item, class_p), only if there is more than one section."""
    s = scored(responses, items, item)
    several = responses.select(section).distinct().agg((F.count(section) > 1).alias("_several"))
    got = s.where(F.col(section).isNotNull()).groupBy(section, item).agg(F.sum("points").alias("earned"), F.sum(F.coalesce("credits", F.lit(1))).alias("possible"))
    rated = got.select(section, item, half_up(F.col("earned") / F.col("possible")).alias("class_p"))
    return rated.join(F.broadcast(several.where("_several")), how="cross").drop("_several")  # one row at most


def section_spread(rates: DataFrame, item: str = "item") -> DataFrame:
    return rates.groupBy(item).agg(half_up(F.max("class_p") - F.min("class_p")).alias("spread"))


def overall(stats: DataFrame) -> DataFrame:
    """Grand totals over the items."""
    possible = F.coalesce("credits", F.lit(1)) * F.col("n")
    state = F.floor(F.coalesce("state_p", F.lit(0.0)) * 1000 + 0.5).cast("long") * possible
    return stats.agg(F.sum("earned").alias("earned"), F.sum(possible).alias("possible"), F.sum(state).alias("_s")).select(
        "earned",
        "possible",
        half_up(F.col("earned") / F.col("possible")).alias("class_p"),
        half_up(F.col("_s") / 1000 / F.col("possible")).alias("state_p"),
    )


def raw_scores(responses: DataFrame, items: DataFrame, student: str = "student", item: str = "item") -> DataFrame:
    """Points per student, for curves and bands; never part of a report."""
    return scored(responses, items, item).groupBy(student).agg(F.sum("points").alias("raw"))
