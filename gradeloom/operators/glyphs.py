"""Shapes of glyphs to clusters, and the points that a figure plots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.stored import checkpointed, forget

# --- observation -------------------------------------------------------------------------


def mean_gap(a: Column, b: Column) -> Column:
    """Mean difference of two lists of numbers of one length; 0 of empty ones."""
    total = F.aggregate(F.zip_with(a, b, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d)
    return F.when(F.size(a) > 0, total / F.size(a)).otherwise(0.0)


def _cells(points: Column, most: float) -> list[Column]:
    """Three whole numbers that differ by 1 at most where two lists are nearer than ``most``.

    A mean of the numbers with factors between -1 and 1 can't differ by more than the lists do.
    """
    n = F.greatest(F.size(points), F.lit(1))
    signs = (lambda i: F.lit(1.0), lambda i: F.when(i % 2 == 0, 1.0).otherwise(-1.0), lambda i: F.when(i * 2 < n, 1.0).otherwise(-1.0))

    def signed(sign: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.transform(points, lambda p, i: p * sign(i)), F.lit(0.0), lambda a, p: a + p)

    return [F.floor(signed(s) / n / F.lit(most * (1 + 1e-9))) for s in signs]


CELLS = ["_c0", "_c1", "_c2"]


def _around(df: DataFrame) -> DataFrame:
    """Rows of cells, each dealt to its 27 neighbouring cells."""
    for c in CELLS:
        df = df.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    return df


def leaders(shapes: DataFrame, most: float) -> DataFrame:
    """(place, form, points): the shapes that found a cluster: those that, in order of ``place``, no
    founder before them is nearer to than ``most``.

    Founders are the lexicographically first independent set of the shapes that are near each
    other, found in rounds: a shape that comes first among all that are left in its own and the
    neighbouring cells of a grid founds a cluster, and what is near a new founder is done. No
    pairs of shapes are made, but of shapes and founders; equal shapes are one.

    shapes: place (unique, any order), form (shapes of different forms aren't comparable), points.
    """
    first = shapes.groupBy("form", "points").agg(F.min("place").alias("place"))
    left = checkpointed(first.select("place", "form", "points", F.size("points").alias("_n"), *[c.alias(n) for c, n in zip(_cells(F.col("points"), most), CELLS, strict=True)]))
    key = ["form", "_n", *CELLS]
    found = []
    while not left.isEmpty():
        least = _around(left.groupBy(*key).agg(F.min("place").alias("_least"))).groupBy(*key).agg(F.min("_least").alias("_least"))
        new = checkpointed(left.join(least, key).where("place = _least").drop("_least"))
        found.append(new)
        near = _around(new.select(*key, F.col("points").alias("_points")))
        done = left.join(near, key).where(mean_gap(F.col("points"), F.col("_points")) < most).select("place").distinct()
        # a founder is near itself; where ``most`` is 0 nothing is near, and each is its own
        rest = checkpointed(left.join(done, "place", "left_anti").join(new.select("place"), "place", "left_anti"))
        forget(left)
        left = rest
    forget(left)
    out = shapes.select("place", "form", "points").limit(0)
    for new in found:
        out = out.unionByName(new.select("place", "form", "points"))
    return out


def observed(shapes: DataFrame, most: float) -> DataFrame:
    """(place, cluster): the founder (its place) of every shape's cluster: of those before it that are
    nearer than ``most`` one of its own bucket, then the nearest, then the first.

    shapes: place, form, bucket, points. A shape of which no founder is near is one itself.
    """
    own = shapes.select("place", "form", "bucket", "points", F.size("points").alias("_n"), *[c.alias(n) for c, n in zip(_cells(F.col("points"), most), CELLS, strict=True)])
    own = checkpointed(own)
    head = checkpointed(leaders(shapes, most))
    of = head.join(own.select("place", "bucket", "_n", *CELLS), "place").select("form", "_n", *CELLS, F.col("place").alias("cluster"), F.col("bucket").alias("_bucket"), F.col("points").alias("_points"))
    met = own.join(_around(of), ["form", "_n", *CELLS]).withColumn("_d", mean_gap(F.col("points"), F.col("_points")))
    met = met.where((F.col("cluster") < F.col("place")) & (F.col("_d") < most))
    best = met.groupBy("place").agg(F.min_by("cluster", F.struct(F.col("_bucket") != F.col("bucket"), "_d", "cluster")).alias("cluster"))
    return best.unionByName(head.select("place", F.col("place").alias("cluster")))


def clusters(shapes: DataFrame, most: float) -> DataFrame:
    """(cluster, form, n, points): the clusters of observed() with how often they were seen."""
    seen = observed(shapes, most).groupBy("cluster").agg(F.count("*").alias("n"))
    return seen.join(shapes.select(F.col("place").alias("cluster"), "form", "points"), "cluster")


# --- plotted points ------------------------------------------------------------------------

#: Lines of a plot are this long and thin; its grid has so many lines, so far apart, steady
#: to this much; an axis is this much longer than any other line; dots are this large and round.
LONG, THIN, GRID_LINES, GRID_STEP, STEADY, LONGER = 30.0, 1.5, 4, 4.0, 0.6, 2.0
DOT_LEAST, DOT_MOST, ROUND, ON_GRID = 2.5, 8.0, 1.2, 0.12


def _grid(at: DataFrame, step: DataFrame, *keys: str) -> DataFrame:
    """(keys.., first, last): the longest run of lines (at) one step apart; of equal ones the first."""
    steps = at.join(step.hint("merge"), list(keys))
    w = Window.partitionBy(*keys).orderBy("at")
    new = F.when(F.abs(F.col("at") - F.lag("at").over(w) - F.col("step")) < STEADY, 0).otherwise(1)
    runs = steps.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy(*keys, "_run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("_n"))
    return each.groupBy(*keys).agg(F.max_by(F.struct("first", "last"), F.struct(F.col("_n"), -F.col("_run"))).alias("_b")).select(*keys, "_b.*")


def _axis(lines: DataFrame, grid: DataFrame, step: DataFrame, *keys: str) -> DataFrame:
    """(keys.., axis): the longest line in the plot's area, if it is clearly longer than the next one."""
    near = lines.join(grid.hint("merge"), list(keys)).join(step.hint("merge"), list(keys)).where("at >= first - 2 * step AND at <= last + 2 * step")
    whole = near.groupBy(*keys, "at").agg((F.max("hi") - F.min("lo")).alias("long"))
    w = Window.partitionBy(*keys).orderBy(F.desc("long"), "at")
    ranked = whole.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead("long").over(w), F.lit(0.0))})
    return ranked.where((F.col("_r") == 1) & (F.col("long") - F.col("_next") >= LONGER)).select(*keys, F.col("at").alias("axis"))


def plotted_points(drawn: DataFrame, *keys: str) -> DataFrame:
    """(keys.., px, py): the points that a figure plots, in squares of its grid from where its axes cross.

    drawn: keys.., x0, y0, x1, y1, filled. A figure without a steady grid, or with an axis that
    doesn't stand out (no negative quadrant), has no points rather than wrong ones. Round marks
    beside the crossings of the grid are parts of labels. Figures are merged: what is made of a
    small table may be large, and would be sent to the driver.
    """
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    line = lambda c, lo, hi, a, b: (F.round(F.col(a) + (F.col(b) - F.col(a)) / 2, 1).alias(c), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    upright = checkpointed(drawn.where((high > LONG) & (wide < THIN)).select(*keys, *line("at", "y0", "y1", "x0", "x1")))
    level = checkpointed(drawn.where((wide > LONG) & (high < THIN)).select(*keys, *line("at", "x0", "x1", "y0", "y1")))
    vx, hy = (x.select(*keys, "at").distinct() for x in (upright, level))
    w = Window.partitionBy(*keys).orderBy("at")
    gaps = vx.withColumn("step", F.round(F.lead("at").over(w) - F.col("at"), 1))
    count = gaps.groupBy(*keys, "step").agg(F.count("step").alias("_n"), F.min("at").alias("_at"))
    lines = gaps.groupBy(*keys).agg(F.count("*").alias("_lines"))
    common = count.where("step IS NOT NULL").groupBy(*keys).agg(F.max_by("step", F.struct(F.col("_n"), -F.col("_at"))).alias("step"))
    step = checkpointed(common.join(lines.hint("merge"), list(keys)).where((F.col("step") >= GRID_STEP) & (F.col("_lines") >= GRID_LINES)).select(*keys, "step"))
    gx, gy = _grid(vx, step, *keys), _grid(hy, step, *keys)
    frame = step
    for part in (_axis(upright, gx, step, *keys).withColumnRenamed("axis", "_y"), _axis(level, gy, step, *keys).withColumnRenamed("axis", "_x"), gx.toDF(*keys, "_l", "_r"), gy.toDF(*keys, "_t", "_b")):
        frame = frame.join(part.hint("merge"), list(keys))
    size = lambda c: (c > DOT_LEAST) & (c < DOT_MOST)
    dots = drawn.where(F.col("filled") & size(wide) & size(high) & (F.abs(wide - high) < ROUND)).select(*keys, (F.col("x0") + wide / 2).alias("_dx"), (F.col("y0") + high / 2).alias("_dy"))
    met = dots.join(frame.hint("merge"), list(keys)).where("_dx BETWEEN _l - step AND _r + step AND _dy BETWEEN _t - step AND _b + step")
    met = met.withColumns({"_px": (F.col("_dx") - F.col("_y")) / F.col("step"), "_py": (F.col("_x") - F.col("_dy")) / F.col("step")})
    on = [F.abs(F.col(c) - F.round(c)) < ON_GRID for c in ("_px", "_py")]
    return met.where(on[0] & on[1]).select(*keys, F.round("_px").cast("int").alias("px"), F.round("_py").cast("int").alias("py")).distinct()


# --- calibration ------------------------------------------------------------------------------


def calibrated(ticks: DataFrame, *keys: str, least: int = 3, most_off: float = 0.1) -> DataFrame:
    """(keys.., scale, origin): value = scale * at + origin of each axis, by the median of the slopes of
    its ticks (at, value), so that labels that were read wrongly don't move it.

    An axis with fewer than ``least`` ticks, without a slope, or on which fewer than half of the
    ticks lie within ``most_off`` steps of the line has none. Ticks are those of one axis, so
    their pairs are few.
    """
    t = ticks.select(*keys, "at", "value").distinct()
    pairs = t.join(t.select(*keys, F.col("at").alias("_at"), F.col("value").alias("_value")), list(keys)).where("_at > at")
    slope = pairs.groupBy(*keys).agg(F.median((F.col("_value") - F.col("value")) / (F.col("_at") - F.col("at"))).alias("scale"))
    fit = t.join(slope, list(keys)).where("scale <> 0").groupBy(*keys, "scale").agg(F.median(F.col("value") - F.col("scale") * F.col("at")).alias("origin"), F.count("*").alias("_n"))
    gap = t.withColumn("_gap", F.lead("at").over(Window.partitionBy(*keys).orderBy("at")) - F.col("at")).groupBy(*keys).agg(F.min(F.when(F.col("_gap") > 0, F.col("_gap"))).alias("_step"))
    off = t.join(fit, list(keys)).join(gap, list(keys)).withColumn("_off", F.abs(F.col("value") - F.col("scale") * F.col("at") - F.col("origin")) <= most_off * F.abs(F.col("scale")) * F.col("_step"))
    return off.groupBy(*keys, "scale", "origin", "_n").agg(F.count_if("_off").alias("_ok")).where((F.col("_n") >= least) & (F.col("_ok") * 2 >= F.col("_n"))).select(*keys, "scale", "origin")


def marked_values(marks: DataFrame, ticks: DataFrame, *keys: str) -> DataFrame:
    """(keys.., id, x, y): marks (id, x, y on the page) in the units of their figure's axes; figures with an
    axis that can't be calibrated have none. ticks: keys.., axis ('x' or 'y'), at, value."""
    fit = calibrated(ticks, *keys, "axis")
    side = lambda a: fit.where(F.col("axis") == a).select(*keys, F.col("scale").alias(f"_s{a}"), F.col("origin").alias(f"_o{a}"))
    met = marks.join(side("x"), list(keys)).join(side("y"), list(keys))
    return met.select(*keys, "id", (F.col("_sx") * F.col("x") + F.col("_ox")).alias("x"), (F.col("_sy") * F.col("y") + F.col("_oy")).alias("y"))
