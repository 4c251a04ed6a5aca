"""From positions to tables: islands, runs, bands, nearest and as-of matches, carried values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, order: str, *keys: str, gap: float = 1, name: str = "island") -> DataFrame:
    """Numbers the runs of ``order`` within keys; a new run starts after a step above ``gap``."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(df: DataFrame, order: str, *keys: str, gap: float = 1) -> DataFrame:
    """(keys.., first, last, length) of every run."""
    return islands(df, order, *keys, gap=gap).groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("island")


def first_run(df: DataFrame, order: str, *keys: str, gap: float = 1) -> DataFrame:
    return runs(df, order, *keys, gap=gap).groupBy(*keys).agg(F.min_by(F.struct("first", "last", "length"), "first").alias("r")).select(*keys, "r.*")


def longest_run(df: DataFrame, order: str, *keys: str, gap: float = 1) -> DataFrame:
    """The longest run; of equally long ones the first."""
    best = F.max_by(F.struct("first", "last", "length"), F.struct(F.col("length"), -F.col("first")))
    return runs(df, order, *keys, gap=gap).groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def equally_spaced_run(df: DataFrame, order: str, *keys: str, step: float) -> DataFrame:
    """The longest run of values exactly ``step`` apart."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) == step, 0).otherwise(1)
    marked = df.select(*keys, order).distinct().withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    best = F.max_by(F.struct("first", "last", "length"), F.struct(F.col("length"), -F.col("first")))
    g = marked.groupBy(*keys, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"))
    return g.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def growing_blocks(df: DataFrame, top: str, bottom: str, *keys: str, gap: float = 0) -> DataFrame:
    """Blocks of boxes: a new one starts more than ``gap`` below everything so far."""
    w = Window.partitionBy(*keys).orderBy(top, bottom)
    deepest = F.max(bottom).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col(top) > deepest + gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def joined_lines(df: DataFrame, group: list[str], order: str, text: str = "text", glue: str = " ") -> DataFrame:
    """The texts of a group in order, as one."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(parts, lambda p: p["t"]), glue).alias(text))


def word_rows(words: DataFrame) -> DataFrame:
    """Words of one exact y as a row, from left to right."""
    return joined_lines(words, ["page", "y"], "x")


def continued(df: DataFrame, starts: Column, order: str, *keys: str, text: str = "text") -> DataFrame:
    """Folds each line that doesn't start an entry into the entry above."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("entry", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined_lines(marked, [*keys, "entry"], order, text)


def carried(df: DataFrame, value: Column, order: str, *keys: str, name: str = "carried") -> DataFrame:
    """The latest non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def as_of(left: DataFrame, right: DataFrame, at: str, value: str, *keys: str) -> DataFrame:
    """``left`` plus the value of ``right`` at the greatest position up to its own, per keys.

    One union and one window; ties at a position take the right side's greatest value.
    """
    l_ = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    r_ = right.groupBy(*keys, at).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(0))
    both = l_.unionByName(r_, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return filled.where("_side = 1").drop("_side", "_v")


def bands(edges: DataFrame, start: str, *keys: str, last: Column | None = None) -> DataFrame:
    """Adds lo, hi: each band reaches to the next start; the last to ``last`` (else null: open)."""
    nxt = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return edges.withColumns({"lo": F.col(start), "hi": nxt if last is None else F.coalesce(nxt, last)})


def midpoint_bands(centres: DataFrame, at: str, *keys: str) -> DataFrame:
    """Bands whose borders lie halfway between neighbouring centres; open at both ends."""
    w = Window.partitionBy(*keys).orderBy(at)
    return centres.withColumns({"lo": (F.lag(at).over(w) + F.col(at)) / 2, "hi": (F.lead(at).over(w) + F.col(at)) / 2})


#: Bands without keys are those of one page or plan; more of them need a key.
MOST_BANDS = 10_000


def in_band(points: DataFrame, band: DataFrame, at: str, *keys: str) -> DataFrame:
    """Points with the band that holds them: lo <= at < hi; open ends hold all.

    Bands without keys go to every task, so there may be MOST_BANDS of them; ValueError else.
    """
    lo = F.col("lo").isNull() | (F.col(at) >= F.col("lo"))
    hi = F.col("hi").isNull() | (F.col(at) < F.col("hi"))
    if keys:
        return points.join(band, list(keys)).where(lo & hi)
    if band.limit(MOST_BANDS + 1).count() > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} bands without keys")
    return points.join(F.broadcast(band), lo & hi)


def nearest(left: DataFrame, right: DataFrame, a: str, b: str, *keys: str, within: float | None = None, right_id: str = "right_id") -> DataFrame:
    """left plus the id and distance of the nearest right row of its keys; ties to the least id.

    Found by looking up and down in one sorted union, not by pairing. Left rows without a
    match within the distance are left out.
    """
    ends = right.groupBy(*keys, F.col(b).alias("_at")).agg(F.min(right_id).alias("_id"))
    mark = F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"))
    r = ends.select(*keys, "_at", mark.alias("_mark"), F.lit(0).alias("_side"))
    both = left.withColumns({"_at": F.col(a), "_side": F.lit(1)}).unionByName(r, allowMissingColumns=True)
    up = Window.partitionBy(*keys).orderBy(F.col("_at").asc(), F.col("_side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.col("_at").desc(), F.col("_side").asc()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumns({"_lo": F.last("_mark", ignorenulls=True).over(up), "_hi": F.last("_mark", ignorenulls=True).over(down)}).where("_side = 1")
    dist = lambda m: F.abs(F.col(a) - F.col(f"{m}.at"))
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(m).isNotNull(), F.struct(dist(m).alias("distance"), F.col(f"{m}.id").alias("id"))) for m in ("_lo", "_hi")])))
    out = met.withColumn("_best", best).where(F.col("_best").isNotNull()).withColumns({right_id: F.col("_best.id"), "distance": F.col("_best.distance")})
    out = out.drop("_at", "_side", "_mark", "_lo", "_hi", "_best")
    return out if within is None else out.where(F.col("distance") < within)


def overlapping(a: DataFrame, b: DataFrame, *keys: str, width: float) -> DataFrame:
    """Pairs of intervals (lo, hi) and (lo2, hi2) that overlap, by buckets of ``width``.

    Each pair is emitted in the bucket where its overlap starts, so once.
    """
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width)))
    met = a.withColumn("_c", cells("lo", "hi")).join(b.withColumn("_c", cells("lo2", "hi2")), [*keys, "_c"])
    both = (F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi"))
    return met.where(both & (F.floor(F.greatest("lo", "lo2") / width) == F.col("_c"))).drop("_c")


def bounds(paths: DataFrame, *keys: str, degenerate: bool = True) -> DataFrame:
    """The box around rectangles (x0, y0, x1, y1); without ``degenerate``, those with an area."""
    if not degenerate:
        paths = paths.where((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return paths.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def before_footnote(rows: DataFrame, footnote: Column, y: str, *keys: str) -> DataFrame:
    """Rows above the first footnote of their keys."""
    first = F.min(F.when(footnote, F.col(y))).over(Window.partitionBy(*keys))
    return rows.withColumn("_f", first).where(F.col("_f").isNull() | (F.col(y) < F.col("_f"))).drop("_f")


def upper_median(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys.., median): element number n // 2 of the sorted values, counted from 0."""
    w = Window.partitionBy(*keys).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumns({"_r": F.row_number().over(w) - 1, "_n": n}).where(F.col("_r") == F.floor(F.col("_n") / 2)).select(*keys, F.col(value).alias("median"))


def modal_gap(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys.., gap): the most frequent step between neighbouring distinct values; ties to the least."""
    w = Window.partitionBy(*keys).orderBy(value)
    steps = df.select(*keys, value).distinct().withColumn("gap", F.col(value) - F.lag(value).over(w)).where("gap IS NOT NULL")
    return steps.groupBy(*keys, "gap").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max_by("gap", F.struct(F.col("_n"), -F.col("gap"))).alias("gap"))


def all_letters(labels: DataFrame, *keys: str, letters: str = "ABCD") -> DataFrame:
    """Keys under which every letter occurs."""
    return labels.where(F.col("letter").isin(list(letters))).groupBy(*keys).agg(F.countDistinct("letter").alias("_n")).where(F.col("_n") == len(letters)).drop("_n")


def sequence_faults(df: DataFrame, order: str, number: str, *keys: str) -> DataFrame:
    """Rows whose number doesn't follow the one before by 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("before", F.lag(number).over(w)).where(F.col(number) != F.col("before") + 1)
