"""Edge tables between hierarchical codes, one for each of four deliberate rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.scalars import base_code


def _stem(code: str) -> F.Column:
    """A code without its one-letter suffix."""
    return F.regexp_replace(code, "[a-z]$", "")


def with_children(codes: DataFrame) -> DataFrame:
    """(code, reach): every code reaches itself and its one-letter children."""
    own = codes.select("code", F.col("code").alias("reach"))
    kids = codes.where(F.col("code").rlike("[a-z]$")).select(_stem("code").alias("code"), F.col("code").alias("reach"))
    return own.unionByName(kids.join(codes, "code", "left_semi")).distinct()


def children_if_unknown(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, reach): an asked code reaches itself if known, else its children."""
    known = asked.select("code").distinct().join(codes.select("code").distinct(), "code", "left_semi").select("code", F.col("code").alias("reach"))
    missing = asked.select("code").distinct().join(codes, "code", "left_anti")
    kids = codes.where(F.col("code").rlike("[a-z]$")).select(_stem("code").alias("code"), F.col("code").alias("reach")).distinct()
    return known.unionByName(missing.join(kids, "code"))


def both_directions(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, reach): itself, its parent and its children, only across a letter suffix."""
    a = asked.select("code", F.regexp_replace("code", "[A-Za-z]+$", "").alias("stem")).distinct()
    c = codes.select(F.col("code").alias("reach"), F.regexp_replace("code", "[A-Za-z]+$", "").alias("stem")).distinct()
    one = (F.col("code") == F.col("reach")) | (F.col("code") == F.col("stem")) | (F.col("reach") == F.col("stem"))
    return a.join(c, "stem").where(one).select("code", "reach")


def loose_prefix_first(asked: DataFrame, codes: DataFrame, order: str = "place") -> DataFrame:
    """(code, reach): the first code, by ``order``, of which either is the other's start.

    Codes are blocked by their leading part up to the first dot; the join is within blocks.
    """
    a = asked.select("code", F.split("code", r"\.")[0].alias("_b")).distinct()
    c = codes.select(F.col("code").alias("reach"), order, F.split("code", r"\.")[0].alias("_b"))
    met = a.join(c, "_b").where(F.col("code").startswith(F.col("reach")) | F.col("reach").startswith(F.col("code")))
    return met.groupBy("code").agg(F.min_by("reach", order).alias("reach"))


def base_prefix(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """(code, reach): codes equal or starting alike once dots and dashes are gone."""
    a = asked.select("code", base_code(F.col("code")).alias("x")).distinct()
    c = codes.select(F.col("code").alias("reach"), base_code(F.col("code")).alias("y")).distinct()
    block = lambda col: F.substring(col, 1, 3)
    met = a.withColumn("_b", block("x")).join(c.withColumn("_b", block("y")), "_b")
    return met.where(F.col("x").startswith(F.col("y")) | F.col("y").startswith(F.col("x"))).select("code", "reach")


def reached_by_any(facts: DataFrame, primary: str, secondary: str, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts whose primary or secondary codes are reached from a wanted code; each fact once."""
    reach = wanted.join(edges, "code").select("reach").distinct()
    codes = facts.select("*", F.explode(F.array_union(F.array(F.col(primary)), F.coalesce(F.col(secondary), F.array().cast("array<string>")))).alias("_code"))
    hits = codes.join(reach, F.col("_code") == F.col("reach"), "left_semi").drop("_code")
    return hits.dropDuplicates(["item"])


def inverted_units(lessons: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, units): codes to the sorted units of the lessons that cite what they reach."""
    met = edges.join(lessons.select(F.col("code").alias("reach"), "unit"), "reach")
    return met.groupBy("code").agg(F.array_sort(F.collect_set("unit")).alias("units"))


def several_places(placed: DataFrame) -> DataFrame:
    """Codes placed at more than one (unit, lesson)."""
    return placed.groupBy("code").agg(F.countDistinct("unit", "lesson").alias("places")).where("places > 1")


def override(base: DataFrame, special: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``special`` replaces the fields that it lists in ``present``, explicit nulls included.

    Adds basis: ``item`` where any field is replaced, else ``standard``.
    """
    s = special.select(F.col(key).alias("_k"), F.col("present"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    met = base.join(s, F.col(key) == F.col("_k"), "left")
    has = lambda f: F.coalesce(F.array_contains("present", f), F.lit(False))
    cols = [F.when(has(f), F.col(f"_s_{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    rest = [c for c in base.columns if c not in fields]
    basis = F.when(F.coalesce(F.size("present"), F.lit(0)) > 0, "item").otherwise("standard")
    return met.select(*rest, *cols, basis.alias("basis"))
