"""Items of a page region: prose lines with holes for drawn maths, choices, displayed expressions, figures.

Drawings are claimed in an order of priority, each once: figure zones keep theirs, prose lines
take what stands in their gaps and grows from there, bars what completes them, choice letters
the blocks level with them; what is left is a displayed expression if it reads, else artwork.
Each claim is a join against what was claimed before; keys are a document, a page and an item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators import drawings as D
from gradeloom.operators.layout import growing_blocks, nearest
from gradeloom.operators.stored import checkpointed

#: Where prose starts and how far behind a line's text a run may start.
MARGIN, AHEAD, BEHIND = 70.0, 6.0, 12.0
#: A line is a choice's this near its letter; a block this level with it and this low.
CHOICE_LINE, CHOICE_LEVEL, CHOICE_DROP, CHOICE_HIGH = 20.0, 12.0, 4.0, 34.0
#: Gaps between blocks and between the parts of a figure; the most an expression may measure.
BLOCK_GAP, FIGURE_GAP, SHOWN_HIGH, SHOWN_WIDE = 10.0, 30.0, 70.0, 380.0
#: Lines that aren't the stem's.
CREDIT = r"^This question is worth (\d) credits?\.$"
INSTRUCTION = r"^(Show your work\.|Explain .*|Answer\b.*|Be sure to .*)$"
FOOTER = r"^(GO ON|STOP|Session \d+|Page \d+)\s*$"
CLOSING = ".,;:?!)"
UNREAD = "⟦?⟧"


def _read() -> list[Column]:
    """Aggregates text and unread of drawings (x0, label): labels from left to right."""
    parts = F.array_sort(F.collect_list(F.struct("x0", "id", F.coalesce("label", F.lit("")).alias("l"))))
    return [F.array_join(F.transform(parts, lambda p: p["l"]), "").alias("text"), F.count_if(F.col("label").isNull()).alias("unread")]


def claimed_by_lines(boxes: DataFrame, text: DataFrame, *keys: str) -> DataFrame:
    """(keys.., id, y): the glyphs that belong into a line of prose (see ``holes``); of several lines the first.

    boxes: with in_figure. A run starts at a free glyph right of the margin and not far behind the line's
    text, outside of figures or with text on both sides; what touches it joins. Then bars take
    what stands above and below them.
    """
    solid = text.where(F.trim("text") != "")
    glyphs = checkpointed(boxes.where(D.is_glyph() & (F.col("x0") > MARGIN - 20)))
    # a line without text of its own reaches as far as the item's text does
    right = solid.groupBy(*keys).agg(F.max("x1").alias("_column"))
    lines = text.select(*keys, "y").distinct().join(D.line_ends(solid, *keys), [*keys, "y"], "left").join(right, list(keys), "left")
    band = checkpointed(D.in_lines(glyphs, lines, *keys))
    reach = F.coalesce("right", "_column", F.lit(MARGIN + 400.0)) + BEHIND
    inside = (F.col("x0") >= MARGIN - AHEAD) & (F.col("x0") <= reach) & (~F.col("in_figure") | F.coalesce(D.bracketed(), F.lit(False)))
    starts = checkpointed(D.free(band, solid, *keys).where(inside).select(*keys, "y", "id", "x0", "y0", "x1", "y1"))
    group = [*keys, "y"]
    able = band.where("NOT in_figure").select(*group, "id", "x0", "y0", "x1", "y1").unionByName(starts).distinct()
    taken = D.least_reaching(starts.select(*group, "id"), D.touching(able, *group), *group)
    own = checkpointed(taken.groupBy(*keys, "id").agg(F.min("y").alias("y")))
    bars = D.fraction_bars(glyphs, *keys).where("bar").select(*keys, "id", "x0", "y0", "x1", "y1").join(own, [*keys, "id"])
    rest = glyphs.where("NOT in_figure").join(own, [*keys, "id"], "left_anti")
    more = D.bar_pieces(rest, bars, *keys).join(own.select(*keys, F.col("id").alias("bar_id"), "y"), [*keys, "bar_id"])
    return own.unionByName(more.select(*keys, "id", "y"))


def holes(boxes: DataFrame, claimed: DataFrame, *keys: str) -> DataFrame:
    """(keys.., y, hole, x0, y0, x1, y1, text, unread): the claimed drawings of each line, neighbours together."""
    met = D.neighbours_in_line(boxes.drop("y").join(claimed, [*keys, "id"]), *keys)
    return met.groupBy(*keys, "y", "hole").agg(*_read(), *D.box_around())


def rendered(text: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """(keys.., y, prose, html): lines with their holes filled in, set off by blanks; closing marks follow at once."""
    math = F.when(F.col("unread") > 0, UNREAD).otherwise(F.concat(F.lit('<span class="math">'), "text", F.lit("</span>")))
    pieces = text.select(*keys, "y", "x0", "text", F.lit(False).alias("_h")).unionByName(found.select(*keys, "y", "x0", math.alias("text"), F.lit(True).alias("_h")))
    w = Window.partitionBy(*keys, "y").orderBy("x0", "_h", "text")
    before, after = F.lag(F.struct("text", "_h")).over(w), F.lead("text").over(w)
    lead = F.when(F.col("_h") & ~F.col("_b._h") & ~F.col("_b.text").rlike(r"\s$") & (F.col("_b.text") != ""), " ").otherwise("")
    first = F.substring("_a", 1, 1)
    trail = F.when(F.col("_h") & (F.col("_a") != "") & ~first.rlike(r"^\s") & ~F.contains(F.lit(CLOSING), first), " ").otherwise("")
    set_ = pieces.withColumns({"_b": before, "_a": after}).withColumn("_s", F.concat(lead, "text", F.coalesce(trail, F.lit(""))))
    parts = F.array_sort(F.collect_list(F.struct("x0", "_h", "text", "_s")))
    joined = lambda only: F.trim(F.array_join(F.transform(only, lambda p: p["_s"]), ""))
    said = F.trim(F.array_join(F.transform(F.filter(parts, lambda p: ~p["_h"]), lambda p: p["text"]), ""))
    return set_.groupBy(*keys, "y").agg(said.alias("prose"), joined(parts).alias("html"))


def items(drawn: DataFrame, text: DataFrame, letters: DataFrame, *keys: str) -> dict[str, DataFrame]:
    """The parts of items: ``items`` (stem, credit_line, unread), ``lines`` (kind, prose, html), ``holes``,
    ``choices`` (letter, html), ``shown`` expressions and ``figures``.

    drawn: keys.., id, x0, y0, x1, y1, parts, label (what a glyph reads as, null if unknown); text:
    keys.., y, x0, x1, text: the prose pieces of lines; letters: keys.., letter, x, y of choices.
    A hole with an unknown glyph is marked, never dropped; a block that doesn't read is artwork.
    Blocks of artwork less than FIGURE_GAP below each other are one figure.
    """
    k = list(keys)
    marked = D.furniture(drawn, *keys)
    zones = checkpointed(D.figure_zones(marked.where("NOT furniture"), *keys))
    boxes = checkpointed(D.in_zones(marked, zones, *keys))
    claimed = checkpointed(claimed_by_lines(boxes, text, *keys))
    found = checkpointed(holes(boxes, claimed, *keys))
    lines = rendered(text, found, *keys)
    named = letters.withColumn("_id", F.struct("y", "x", "letter"))
    near = nearest(lines, named, "y", "y", *keys, within=CHOICE_LINE, right_id="_id")
    kind = F.when(F.col("prose").rlike(CREDIT), "credit").when(F.col("prose").rlike(FOOTER), "footer").when(F.col("prose").rlike(INSTRUCTION), "instruction")
    lines = checkpointed(lines.join(near.select(*k, "y", "_id"), [*k, "y"], "left").withColumn("kind", F.coalesce(kind, F.when(F.col("_id").isNotNull(), "choice"), F.lit("stem"))))
    # what is left, in blocks
    left = boxes.where("NOT furniture").join(claimed.select(*k, "id"), [*k, "id"], "left_anti")
    blocks = growing_blocks(left, "y0", "y1", *keys, gap=BLOCK_GAP)
    glyph = D.is_glyph()
    shape = blocks.withColumn("_g", glyph).groupBy(*k, "block").agg(*_read(), *D.box_around(), F.count("*").alias("parts"), F.count_if("_g").alias("glyphs"), F.count_if(F.col("_g") & F.col("label").isNull()).alias("_unknown"))
    shape = checkpointed(D.in_zones(shape.withColumn("id", F.col("block")), zones, *keys).drop("id"))
    high, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    level = (F.abs((F.col("y0") + F.col("y1")) / 2 - F.col("_id.y") - CHOICE_DROP) < CHOICE_LEVEL) & (F.col("x0") > F.col("_id.x")) & (high < CHOICE_HIGH) & (F.col("_unknown") == 0)
    owned = checkpointed(shape.join(named.select(*k, "_id"), k).where(level).groupBy(*k, "block").agg(F.min("_id").alias("_id"), F.first("x0").alias("x0"), F.first("text").alias("text")))
    rest = shape.join(owned.select(*k, "block"), [*k, "block"], "left_anti")
    reads = ~F.col("in_figure") & (high < SHOWN_HIGH) & (wide < SHOWN_WIDE) & (F.col("glyphs") == F.col("parts")) & (F.col("glyphs") >= 2) & (F.col("_unknown") == 0)
    shown, art = rest.where(reads), growing_blocks(rest.where(~reads).withColumn("id", F.col("block")).drop("block"), "y0", "y1", *keys, gap=FIGURE_GAP)
    figures = art.groupBy(*k, "block").agg(*D.box_around(), F.sum("parts").alias("parts"), F.sum("_unknown").alias("unread")).where(wide * high >= D.ZONE_AREA)
    # choices: their lines, then what is drawn beside their letters
    said = lines.where("kind = 'choice'").select(*k, "_id", F.lit(0).alias("_o"), F.col("y").alias("_p"), F.col("html").alias("_t"))
    drew = owned.select(*k, "_id", F.lit(1).alias("_o"), F.col("x0").alias("_p"), F.concat(F.lit('<span class="math">'), "text", F.lit("</span>")).alias("_t"))
    parts = F.array_sort(F.collect_list(F.struct("_o", "_p", "_t")))
    content = said.unionByName(drew).groupBy(*k, "_id").agg(F.trim(F.array_join(F.transform(parts, lambda p: p["_t"]), " ")).alias("html"))
    choices = named.join(content, [*k, "_id"], "left").select(*k, "letter", "x", "y", F.coalesce("html", F.lit("")).alias("html"))
    order = lambda c, only: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == only, F.struct("y", F.col(c).alias("t"))))), lambda p: p["t"]), " ")
    stems = lines.groupBy(*k).agg(F.trim(order("html", "stem")).alias("stem"), F.trim(order("prose", "stem")).alias("prose"), F.max(F.when(F.col("kind") == "credit", F.col("prose"))).alias("credit_line"))
    unread = found.groupBy(*k).agg(F.count_if(F.col("unread") > 0).alias("unread"))
    return {
        "items": stems.join(unread, k, "left").withColumn("unread", F.coalesce("unread", F.lit(0))), "lines": lines.drop("_id"), "holes": found, "choices": choices,
        "shown": shown.select(*k, "x0", "y0", "x1", "y1", F.concat(F.lit('<span class="math">'), "text", F.lit("</span>")).alias("html")), "figures": figures.drop("block"),
    }
