"""Comparing readings and tables: tallies, edge differences, title resolution, fuzzy sections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import half_up, normal_title


def tally(df: DataFrame, *keys: str) -> DataFrame:
    """(keys.., n, rate): counts of outcomes and their share of all rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.withColumn("rate", half_up(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))))  # few outcomes


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(outcome, n, rate) over the keys of either reading: same, different, only-a, only-b."""
    x, y = a.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), b.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    both = x.join(y, key, "full_outer")
    outcome = F.when(F.col("_in_a").isNull(), "only-b").when(F.col("_in_b").isNull(), "only-a").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("different")
    return tally(both.select(outcome.alias("outcome")), "outcome")


def edge_disagreements(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Edges of one table without their counterpart in the other, and which side has them."""
    a = forward.exceptAll(backward).withColumn("side", F.lit("forward"))
    return a.unionByName(backward.exceptAll(forward).withColumn("side", F.lit("backward")))


def same_rows(a: DataFrame, b: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(missing, extra, same): a rebuilt table against the stored one, volatile columns aside."""
    cols = [c for c in sorted(a.columns) if c not in ignore]
    missing = a.select(*cols).exceptAll(b.select(*cols)).agg(F.count("*").alias("missing"))
    extra = b.select(*cols).exceptAll(a.select(*cols)).agg(F.count("*").alias("extra"))
    return missing.join(F.broadcast(extra), how="cross").withColumn("same", (F.col("missing") == 0) & (F.col("extra") == 0))  # one row each


def found_and_expected(found: DataFrame, expected: DataFrame, *keys: str) -> DataFrame:
    """(keys.., status): stray if found alone, unlocated if expected alone."""
    stray = found.join(expected, list(keys), "left_anti").select(*keys).withColumn("status", F.lit("stray"))
    return stray.unionByName(expected.join(found, list(keys), "left_anti").select(*keys).withColumn("status", F.lit("unlocated")))


def withheld(released: DataFrame, totals: DataFrame, test: str = "test", item: str = "item") -> DataFrame:
    """(test, item): numbers from 1 to a test's total that it didn't release."""
    every = totals.select(test, F.explode(F.sequence(F.lit(1), F.col("total"))).alias(item))
    return every.join(released.select(test, F.col(item).cast("int").alias(item)), [test, item], "left_anti")


def multiset_difference(planned: DataFrame, released: DataFrame, *keys: str) -> DataFrame:
    """(keys.., value, n): how often a planned value is still open."""
    a = planned.groupBy(*keys, "value").agg(F.count("*").alias("p"))
    b = released.groupBy(*keys, "value").agg(F.count("*").alias("r"))
    met = a.join(b, [*keys, "value"], "left").withColumn("n", F.col("p") - F.coalesce("r", F.lit(0)))
    return met.where("n > 0").select(*keys, "value", "n")


def dealt_in_order(slots: DataFrame, values: DataFrame, slot: str, *keys: str, basis: str = "order") -> DataFrame:
    """Open values dealt to slots in order (values ascending), with the basis of the inference."""
    w = Window.partitionBy(*keys)
    a = slots.withColumn("_i", F.row_number().over(w.orderBy(slot)))
    each = values.select(*keys, "value", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_k"))
    b = each.withColumn("_i", F.row_number().over(w.orderBy("value", "_k"))).drop("_k")
    return a.join(b, [*keys, "_i"], "left").withColumn("basis", F.when(F.col("value").isNotNull(), basis).otherwise("none")).drop("_i")


def identical_readings(readings: DataFrame, key: str, *values: str) -> DataFrame:
    """(key, readings, same): whether all readings of a key agree in every value."""
    return readings.groupBy(key).agg(F.count("*").alias("readings"), (F.countDistinct(F.struct(*values)) == 1).alias("same"))


def unique_titles(titles: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """asked plus the id whose normalised title is theirs, where just one is; else null."""
    t = titles.withColumn("_n", normal_title(F.col("title"))).groupBy(*keys, "_n").agg(F.count("*").alias("_k"), F.min("id").alias("id"))
    a = asked.withColumn("_n", normal_title(F.col("title")))
    return a.join(t.where("_k = 1").drop("_k"), [*keys, "_n"], "left").drop("_n")


def contains_quote(body: Column, quote: Column) -> Column:
    """Whether a quote occurs in a body once both are normalised; an empty quote doesn't."""
    q = normal_title(quote)
    return (q != "") & F.contains(F.concat(F.lit(" "), normal_title(body), F.lit(" ")), q)


def fuzzy_sections(asked: DataFrame, sections: DataFrame, *keys: str, floor: float = 0.62, margin: float = 0.06) -> DataFrame:
    """asked (ask_id, title) plus the best section (section_id, heading) of its keys.

    The score is the mean of word cover and character ratio. A match needs the floor and
    the margin over the runner-up; section_id is null otherwise. Pairs stay within keys.
    """
    met = asked.join(sections, list(keys))

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        def one(x: str | None, y: str | None) -> float:
            if not x or not y:
                return 0.0
            p, q = set(x.split()), set(y.split())
            both = len(p & q)
            cover = 2 * both / (len(p) + len(q)) if p and q else 0.0
            return (cover + SequenceMatcher(None, x, y).ratio()) / 2

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    scored = met.withColumn("score", F.pandas_udf(ratio, "double")(normal_title(F.col("title")), normal_title(F.col("heading"))))
    w = Window.partitionBy("ask_id").orderBy(F.col("score").desc(), "section_id")
    ranked = scored.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead("score").over(w), F.lit(0.0))}).where("_r = 1")
    good = (F.col("score") >= floor) & (F.col("score") - F.col("_next") >= margin)
    best = ranked.select("ask_id", F.when(good, F.col("section_id")).alias("section_id"), "score")
    return asked.join(best, "ask_id", "left")


def shape_labels(shapes: DataFrame, clusters: DataFrame, most: float) -> DataFrame:
    """(shape_id, label, distance): the nearest labelled cluster of the shape's bucket, else of
    all buckets.

    shapes: shape_id, bucket, points (flat array of numbers); clusters: label, bucket, points.
    Clusters are a hand-labelled table; distance is the mean difference per number.
    """
    flat = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d) / F.size(a)
    c = clusters.select("label", F.col("bucket").alias("_bucket"), F.col("points").alias("_points"))

    def best(met: DataFrame) -> DataFrame:
        d = met.where(F.size("points") == F.size("_points")).withColumn("distance", flat(F.col("points"), F.col("_points"))).where(F.col("distance") <= most)
        return d.groupBy("shape_id").agg(F.min_by("label", F.struct("distance", "label")).alias("label"), F.min("distance").alias("distance"))

    near = best(shapes.join(c, F.col("bucket") == F.col("_bucket")))
    rest = shapes.join(near, "shape_id", "left_anti").withColumn("_size", F.size("points"))
    far = best(rest.join(c.withColumn("_n", F.size("_points")), F.col("_size") == F.col("_n")))
    return near.unionByName(far)
