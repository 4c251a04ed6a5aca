"""Faceted exploration: filters, search, orders, rollups over a registry, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import exact_mean, half_up
from gradeloom.operators.stored import checkpointed


def faceted(df: DataFrame, **facets: list | None) -> DataFrame:
    """Rows that match every facet; an empty or missing list lets all pass.

    A facet on an array column asks for an overlap; the member ``None`` stands for an
    empty array or a null.
    """
    for name, wanted in facets.items():
        if not wanted:
            continue
        values = [v for v in wanted if v is not None]
        if df.schema[name].dataType.typeName() == "array":
            ok = F.arrays_overlap(F.col(name), F.array(*[F.lit(v) for v in values])) if values else F.lit(False)
            none = F.coalesce(F.size(name), F.lit(0)) <= 0
        else:
            ok, none = F.col(name).isin(values) if values else F.lit(False), F.col(name).isNull()
        df = df.where(F.coalesce(ok, F.lit(False)) | none if None in wanted else ok)
    return df


def searched(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose composed haystack contains the query, upper and lower case alike."""
    if not query.strip():
        return df
    hay = F.lower(F.concat_ws(" ", *columns))
    return df.where(F.contains(hay, F.lit(query.strip().lower())))


def ordered(df: DataFrame, *keys: tuple[str, bool]) -> DataFrame:
    """Multi-level sort, (column, descending); nulls sink either way."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in keys])


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Adds the place of every row, from 1, in an order without ties.

    Rows are dealt by ranges of the order and sorted there; a place is that within the range
    after the counts of the ranges before. The dealt rows are stored, since another run of the
    plan may sample other ranges.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = checkpointed(dealt)
    dealt = dealt.withColumn("_range", F.shiftright("_at", 33))
    before, n = [], 0
    for r in sorted(dealt.groupBy("_range").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()):
        before.append((r["_range"], n + 1 - r["first"]))
        n += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "_range long, _start long"))  # one row a range
    return dealt.join(starts, "_range").withColumn(name, F.col("_at") + F.col("_start")).drop("_range", "_at", "_start")


def question_keys(mode: str) -> list[Column]:
    """year, curriculum (no unit is 99), standard or hardest; ties by year and item."""
    first: dict[str, list[Column]] = {
        "year": [F.col("year").desc()],
        "curriculum": [F.coalesce("unit", F.lit(99)).asc()],
        "standard": [F.col("standard").asc()],
        "hardest": [F.coalesce("p_value", F.lit(1.0)).asc()],
    }
    return [*first[mode], F.col("year").asc(), F.col("item").asc()]


def standard_rollup(registry: DataFrame, items: DataFrame, key: str = "standard") -> DataFrame:
    """Registry rows with their items' figures; those without items stay, with zero counts."""
    agg = items.groupBy(key).agg(
        F.count("*").alias("n_items"),
        F.sum("credits").alias("credits"),
        F.count_if(F.col("type") == "cr").alias("n_cr"),
        F.countDistinct("year").alias("n_years"),
        F.array_sort(F.collect_set("year")).alias("years"),
        half_up(exact_mean(F.col("p_value"))).alias("mean_p"),
        F.min("p_value").alias("min_p"),
        F.max("p_value").alias("max_p"),
    )
    out = registry.join(agg, key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_items", "credits", "n_cr", "n_years")})


def hard_standards(rollup: DataFrame, least: int = 3, by: str = "n_items") -> DataFrame:
    """Two definitions share this: by items (headline) or by years (persistent)."""
    return rollup.where((F.col(by) >= least) & (F.col("mean_p") < 0.5))


def domain_share(items: DataFrame, ranges: DataFrame | None = None, tolerance: float = 0.0, *keys: str) -> DataFrame:
    """(keys.., domain, credits, share in percent, inside): share of the credits within keys."""
    per = items.groupBy(*keys, "domain").agg(F.sum("credits").alias("credits"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # few domains
    out = per.withColumn("share", half_up(F.col("credits") * 100 / F.sum("credits").over(w), 1))
    if ranges is None:
        return out
    inside = F.col("share").between(F.col("lo") - tolerance, F.col("hi") + tolerance)
    return out.join(ranges, "domain", "left").withColumn("inside", F.coalesce(inside, F.lit(True))).drop("lo", "hi")


def pooled_and_yearly_share(items: DataFrame, year: str = "year") -> DataFrame:
    """(year or null, domain, credits, share) by grouping sets: all years together and each."""
    sets = items.groupingSets([["domain"], [year, "domain"]], year, "domain").agg(F.sum("credits").alias("credits"), F.grouping_id().alias("_g"))
    w = Window.partitionBy(year, "_g")
    return sets.withColumn("share", half_up(F.col("credits") * 100 / F.sum("credits").over(w), 1)).drop("_g")


def counters(items: DataFrame) -> DataFrame:
    """Headline figures."""
    return items.agg(
        F.count("*").alias("n_items"),
        F.countDistinct("standard").alias("n_standards"),
        F.countDistinct("year").alias("n_years"),
        F.sum("credits").alias("credits"),
        F.count_if(F.col("type") == "cr").alias("n_cr"),
        half_up(exact_mean(F.col("p_value"))).alias("mean_p"),
    )


def coverage(items: DataFrame, key: str) -> DataFrame:
    return items.groupBy(key).agg(F.count("*").alias("n_items"), F.countDistinct("standard").alias("n_standards"), F.sum("credits").alias("credits")).orderBy(key)


def later_share(units: DataFrame) -> DataFrame:
    """(unit, n, n_later, share, label) of a unit's standards that a later grade tests.

    units: unit, standard, post_test.
    """
    g = units.groupBy("unit").agg(F.count("*").alias("n"), F.count_if("post_test").alias("n_later"))
    label = F.when(F.col("n_later") == F.col("n"), "all").when(F.col("n_later") == 0, "none").otherwise(F.concat(F.col("n_later").cast("string"), F.lit(" of "), F.col("n").cast("string")))
    return g.select("unit", "n", "n_later", half_up(F.col("n_later") / F.col("n")).alias("share"), label.alias("label"))


def unit_options(items: DataFrame, units: str = "units") -> DataFrame:
    """Distinct units with counts; items without one under ``(none)``."""
    return items.select(F.explode(F.when(F.coalesce(F.size(units), F.lit(0)) > 0, F.col(units)).otherwise(F.array(F.lit("(none)")))).alias("unit")).groupBy("unit").agg(F.count("*").alias("n"))


def year_at_a_glance(units: DataFrame, lessons: DataFrame, items: DataFrame) -> DataFrame:
    """One row per unit: lessons, items, credits; units without either stay."""
    a = lessons.groupBy("unit").agg(F.count("*").alias("n_lessons"))
    b = items.groupBy("unit").agg(F.count("*").alias("n_items"), F.sum("credits").alias("credits"))
    out = units.join(a, "unit", "left").join(b, "unit", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_lessons", "n_items", "credits")})
