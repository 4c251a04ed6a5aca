"""Drawn boxes of a page: which of them touch, grow together, frame, divide, or belong to a figure.

A drawing is a row (keys.., id, x0, y0, x1, y1, parts): its box and the number of paths it is
made of; id is unique within keys. Boxes meet in the cells of a grid, so a page's pairs are
those of neighbours, not all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.layout import as_of, growing_blocks, overlapping
from gradeloom.operators.stored import checkpointed, forget

#: Letters are so wide and tall; delimiters are taller but narrow; rules are flat and may be wide.
LETTER_W, LETTER_H = (0.5, 14.0), (0.5, 16.0)
DELIMITER_W, DELIMITER_H = (2.5, 5.5), 26.0
RULE_W, RULE_H, RULE_LEAST_H = 90.0, 2.2, 0.2
#: A frame is one path this large; a rule without so many siblings near it is an answer blank.
FRAME_W, FRAME_H, BLANK_W, BLANK_H, NEAR_RULE, COMPANY = 300.0, 100.0, 40.0, 1.5, 30.0, 4
#: A figure's parts lie this close; it has structure, parts and an area; its labels lie this near it.
ZONE_GAP, STRUCTURE, ZONE_PARTS, ZONE_AREA, ZONE_EDGE = 14.0, 2, 6, 2000.0, 4.0
#: How far a fraction's content lies from its bar and beside it; the least width of a bar.
REACH, SLACK, BAR_W = 14.0, 1.5, 3.0
#: An overbar's distance from what it covers and the share it spans.
OVERBAR_GAP, OVERBAR_SHARE = 5.0, 0.6
#: A box goes on from another one that ends this little before it.
TOUCH = (-1.0, 6.0)
#: What a line of prose reaches above and below its top, and how far text may overhang a drawing.
LINE_ABOVE, LINE_BELOW, OVERHANG = 2.0, 11.0, 0.4
#: Side of a cell of the grid.
CELL = 32.0


def _width() -> Column:
    return F.col("x1") - F.col("x0")


def _height() -> Column:
    return F.col("y1") - F.col("y0")


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def meeting(a: DataFrame, b: DataFrame, *keys: str, cell: float = CELL) -> DataFrame:
    """Pairs of rows of ``a`` and ``b`` whose areas (``area`` and ``area2``) have a point in common.

    Both are dealt to the cells they cover; a pair is emitted in the one where its common
    part starts, so once.
    """

    def dealt(df: DataFrame, name: str) -> DataFrame:
        along = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"{name}.{lo}") / cell), F.floor(F.col(f"{name}.{hi}") / cell)))
        return df.withColumn("_cx", along("x0", "x1")).withColumn("_cy", along("y0", "y1"))

    first = lambda d: F.greatest(f"area.{d}0", f"area2.{d}0")
    met = dealt(a, "area").join(dealt(b, "area2"), [*keys, "_cx", "_cy"])
    both = [(first(d) <= F.least(f"area.{d}1", f"area2.{d}1")) & (F.floor(first(d) / cell) == F.col(f"_c{d}")) for d in "xy"]
    return met.where(both[0] & both[1]).drop("_cx", "_cy")


def is_glyph() -> Column:
    """Whether a drawing has the size of a letter, a delimiter or a rule."""
    rule = (_height() < RULE_H) & (_width() < RULE_W)
    delimiter = (_height() >= LETTER_H[1]) & (_height() < DELIMITER_H) & (_width() > DELIMITER_W[0]) & (_width() < DELIMITER_W[1])
    letter = (_width() > LETTER_W[0]) & (_width() < LETTER_W[1]) & (_height() > LETTER_H[0]) & (_height() < LETTER_H[1])
    return (rule & (_width() > LETTER_W[0]) & (_height() > RULE_LEAST_H)) | (~rule & (delimiter | letter))


# --- growth ------------------------------------------------------------------------


def touching(boxes: DataFrame, *keys: str, least: float = TOUCH[0], most: float = TOUCH[1]) -> DataFrame:
    """(keys.., a, b): b goes on from a: it starts between ``least`` and ``most`` behind a's end, level with it."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    a = boxes.select(*keys, F.col("id").alias("a"), "y0", "y1", area(x1 + least, y0, x1 + most, y1).alias("area"))
    b = boxes.select(*keys, F.col("id").alias("b"), area(x0, y0, x0, y1).alias("area2"))
    level = (F.col("area2.y0") < F.col("y1")) & (F.col("area2.y1") > F.col("y0"))
    return meeting(a, b, *keys).where(level & (F.col("a") != F.col("b"))).select(*keys, "a", "b")


def least_reaching(starts: DataFrame, steps: DataFrame, *keys: str) -> DataFrame:
    """(keys.., id, start): of the starts (keys.., id) that reach a node along steps (a, b), the least;
    starts reach themselves.

    Steps are doubled: after k rounds a step stands for 2**k of them, and a node knows of the
    starts that are nearer. So there are as many rounds as the longest way has binary digits,
    and none after one in which nothing was gained. Ways may part, meet and run in circles.
    """
    known = checkpointed(starts.select(*keys, "id", F.col("id").alias("start")).distinct())
    hops = checkpointed(steps.select(*keys, "a", "b").distinct())
    while True:
        gained = hops.join(known.select(*keys, F.col("id").alias("a"), "start"), [*keys, "a"]).select(*keys, F.col("b").alias("id"), "start", F.lit(None).cast(starts.schema["id"].dataType).alias("_old"))
        both = known.select(*keys, "id", "start", F.col("start").alias("_old")).unionByName(gained).groupBy(*keys, "id").agg(F.min("start").alias("start"), F.min("_old").alias("_old"))
        more = checkpointed(both)
        lower = not more.where("_old IS NULL OR start < _old").isEmpty()
        forget(known)
        known = more
        if not lower:
            break
        twice = hops.join(hops.select(*keys, F.col("a").alias("b"), F.col("b").alias("_c")), [*keys, "b"]).select(*keys, "a", F.col("_c").alias("b")).distinct()
        further = checkpointed(twice)
        forget(hops)
        hops = further
    forget(hops)
    return known.select(*keys, "id", "start")


def grown(boxes: DataFrame, starts: DataFrame, *keys: str, least: float = TOUCH[0], most: float = TOUCH[1]) -> DataFrame:
    """boxes with ``run``: the least of the starts (keys.., id) whose run, growing box by touching box,
    takes them in; null where none does."""
    found = least_reaching(starts, touching(boxes, *keys, least=least, most=most), *keys)
    return boxes.join(found.withColumnRenamed("start", "run"), [*keys, "id"], "left")


# --- furniture, figures ----------------------------------------------------------------


def furniture(boxes: DataFrame, *keys: str) -> DataFrame:
    """boxes with ``furniture``: frames, and rules with too little company near them to be a figure's."""
    frame = (F.col("parts") == 1) & (_width() > FRAME_W) & (_height() > FRAME_H)
    thin = (_height() < BLANK_H) & (_width() > BLANK_W)
    x0, y0, x1 = F.col("x0"), F.col("y0"), F.col("x1")
    rules = boxes.where(thin & ~frame).select(*keys, "id", "x0", "y0", "x1", area(x0, y0 - NEAR_RULE, x1, y0 + NEAR_RULE).alias("area"))
    tops = boxes.select(*keys, F.col("id").alias("_o"), area(x0, y0, x1, y0).alias("area2"))
    near = (F.abs(F.col("area2.y0") - y0) < NEAR_RULE) & (F.col("area2.x1") > x0) & (F.col("area2.x0") < x1) & (F.col("_o") != F.col("id"))
    company = meeting(rules, tops, *keys).where(near).groupBy(*keys, "id").agg(F.count("*").alias("_n"))
    met = boxes.join(company, [*keys, "id"], "left")
    return met.withColumn("furniture", frame | (thin & (F.coalesce("_n", F.lit(0)) < COMPANY))).drop("_n")


def box_around() -> list[Column]:
    """Aggregates x0, y0, x1, y1 around boxes; those without an area only count where there are no others."""
    solid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    return [F.coalesce(f(F.when(solid, F.col(c))), F.min_by(c, F.struct("y0", "id"))).alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]


def figure_zones(boxes: DataFrame, *keys: str) -> DataFrame:
    """(keys.., block, x0, y0, x1, y1, parts): blocks of drawings that have a figure's structure, size and parts.

    boxes: without furniture. Paths that are no glyphs are structure, but for short flat ones, which are
    fraction bars.
    """
    structure = ~is_glyph() & ~((_height() < 2.0) & (_width() < BLANK_W))
    blocks = growing_blocks(boxes.withColumn("_s", structure), "y0", "y1", *keys, gap=ZONE_GAP)
    zones = blocks.groupBy(*keys, "block").agg(*box_around(), F.count_if("_s").alias("_n"), F.count("*").alias("parts"))
    return zones.where((F.col("_n") >= STRUCTURE) & (F.col("parts") >= ZONE_PARTS) & (_width() * _height() >= ZONE_AREA)).drop("_n")


def in_zones(boxes: DataFrame, zones: DataFrame, *keys: str) -> DataFrame:
    """boxes with ``in_figure``: whether their centre lies in a zone or just beside it.

    A page's zones lie below each other, so the one that starts last above a centre decides.
    """
    cx, cy = F.expr("(x0 + x1) / 2"), F.expr("(y0 + y1) / 2")
    e = ZONE_EDGE
    held = zones.select(*keys, (F.col("y0") - e).alias("_at"), F.struct(F.col("x0").alias("x0"), F.col("x1").alias("x1"), F.col("y1").alias("y1")).alias("_zone"))
    met = as_of(boxes.withColumn("_at", cy), held, "_at", "_zone", *keys)
    inside = (cx >= F.col("_zone.x0") - e) & (cx <= F.col("_zone.x1") + e) & (cy <= F.col("_zone.y1") + e)
    return met.withColumn("in_figure", F.coalesce(inside, F.lit(False))).drop("_at", "_zone")


# --- bars --------------------------------------------------------------------------------


def _beside(rules: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    """Pairs of rules and boxes (o0, p0, o1, p1) whose centre stands above or below the rule, near it."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    a = rules.select(*keys, "id", "x0", "y0", "x1", "y1", area(x0 - SLACK, y0 - REACH, x1 + SLACK, y1 + REACH).alias("area"))
    b = others.select(*keys, F.col("id").alias("_o"), x0.alias("o0"), y0.alias("p0"), x1.alias("o1"), y1.alias("p1"), area(cx, cy, cx, cy).alias("area2"))
    met = meeting(a, b, *keys).where("_o <> id")
    mid = F.col("area2.y0")
    over, under = (mid < y0) & (y0 - mid < REACH), (mid > y1) & (mid - y1 < REACH)
    return met.withColumns({"_above": over, "_below": ~over & under}).drop("area", "area2")


def fraction_bars(boxes: DataFrame, *keys: str) -> DataFrame:
    """boxes with ``bar``: flat ones with something above and something below them; decimal points, minus
    signs and answer blanks have one side at most. Boxes that share their keys and id are judged each by its own sides."""
    own = [*keys, "id", "x0", "y0", "x1", "y1"]
    flat = (_height() < RULE_H) & (_width() > BAR_W) & (_width() < RULE_W)
    sides = _beside(boxes.where(flat), boxes, *keys).groupBy(*own).agg((F.bool_or("_above") & F.bool_or("_below")).alias("_bar"))
    return boxes.join(sides, own, "left").withColumn("bar", F.coalesce("_bar", F.lit(False))).drop("_bar")


def bar_pieces(boxes: DataFrame, bars: DataFrame, *keys: str) -> DataFrame:
    """(keys.., id, bar_id): the boxes that complete a bar, above or below it; of several bars' the first one's."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    cx, cy, mid = (x0 + x1) / 2, (y0 + y1) / 2, (y0 + y1) / 2
    a = bars.select(*keys, F.col("id").alias("bar_id"), mid.alias("_m"), area(x0 - SLACK, mid - REACH, x1 + SLACK, mid + REACH).alias("area"))
    b = boxes.select(*keys, "id", area(cx, cy, cx, cy).alias("area2"))
    met = meeting(a, b, *keys).where((F.col("bar_id") != F.col("id")) & (F.abs(F.col("area2.y0") - F.col("_m")) < REACH))
    return met.groupBy(*keys, "id").agg(F.min("bar_id").alias("bar_id"))


def overbars(boxes: DataFrame, *keys: str) -> DataFrame:
    """boxes with ``overbar``: rules (column ``rule``) that lie on top of what they cover and span it.

    Nothing may stand above. A rule below counts only inside the bar's own span, and what is
    covered by half of its width or less isn't covered.
    """
    x0, x1 = F.col("x0"), F.col("x1")
    rules = boxes.where("rule")
    kinds = boxes.select(*keys, F.col("id").alias("_o"), F.col("rule").alias("_r"))
    met = _beside(rules, boxes, *keys).join(kinds, [*keys, "_o"])
    met = met.where(~F.col("_r") | ((F.col("o0") > x0 - 0.5) & (F.col("o1") < x1 + 0.5)))
    covered = F.col("_below") & (F.least(x1, F.col("o1")) - F.greatest(x0, F.col("o0")) > 0.5 * (F.col("o1") - F.col("o0")))
    group = [*keys, "id", "x0", "x1", "y1"]
    seen = met.groupBy(*group).agg(F.bool_or("_above").alias("_a"), *[f(F.when(covered, F.col(c))).alias(n) for n, f, c in (("_gap", F.min, "p0"), ("_lo", F.min, "o0"), ("_hi", F.max, "o1"))])
    gap, span = F.col("_gap") - F.col("y1"), F.col("_hi") - F.col("_lo")
    wide = F.least(x1, F.col("_hi")) - F.greatest(x0, F.col("_lo")) > OVERBAR_SHARE * span
    ok = seen.select(*keys, "id", (~F.col("_a") & (gap >= 0) & (gap < OVERBAR_GAP) & (span > 0) & wide).alias("_ok"))
    return boxes.join(ok, [*keys, "id"], "left").withColumn("overbar", F.coalesce("_ok", F.lit(False))).drop("_ok")


# --- drawings and lines of prose ---------------------------------------------------------


def line_ends(text: DataFrame, *keys: str) -> DataFrame:
    """(keys.., y, first_end, last_start, right) of lines of text pieces (y, x0, x1): where the first piece to
    end ends, where the last one to start starts, and how far the line reaches."""
    return text.groupBy(*keys, "y").agg(F.min("x1").alias("first_end"), F.max("x0").alias("last_start"), F.max("x1").alias("right"))


def in_lines(boxes: DataFrame, lines: DataFrame, *keys: str) -> DataFrame:
    """boxes with each line (y, ..) whose band they are level with."""
    level = overlapping(
        boxes.withColumns({"lo": F.col("y0"), "hi": F.col("y1")}),
        lines.withColumns({"lo2": F.col("y") - LINE_ABOVE, "hi2": F.col("y") + LINE_BELOW}),
        *keys,
        width=CELL,
    )
    return level.where((F.col("y0") < F.col("hi2")) & (F.col("y1") > F.col("lo2"))).drop("lo", "hi", "lo2", "hi2")


def bracketed() -> Column:
    """Whether a box in a line (see in_lines, line_ends) has text before and behind it."""
    return (F.col("first_end") <= F.col("x0") + OVERHANG) & (F.col("last_start") >= F.col("x1") - OVERHANG)


def free(boxes: DataFrame, text: DataFrame, *keys: str) -> DataFrame:
    """boxes in lines (column y) that no text piece (y, x0, x1) of the line stands on."""
    a = boxes.select(*keys, "y", "id", F.col("x0").alias("lo"), F.col("x1").alias("hi"))
    b = text.select(*keys, "y", (F.col("x0") + OVERHANG).alias("lo2"), (F.col("x1") - OVERHANG).alias("hi2")).where("lo2 <= hi2")
    taken = overlapping(a, b, *keys, "y", width=CELL).where("lo < hi2 AND hi > lo2").select(*keys, "y", "id").distinct()
    return boxes.join(taken, [*keys, "y", "id"], "left_anti")


def neighbours_in_line(boxes: DataFrame, *keys: str, gap: float = TOUCH[1]) -> DataFrame:
    """boxes with ``hole``: those of a line (column y) that start less than ``gap`` behind the one before are one."""
    w = Window.partitionBy(*keys, "y").orderBy("x0", "id")
    new = F.when(F.col("x0") - F.lag("x1").over(w) < gap, 0).otherwise(1)
    return boxes.withColumn("_new", new).withColumn("hole", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
