"""Single positioned characters to lines and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters this near to a line's first top are on it; prose starts this far right.
LINE_TOL, PROSE_X = 2.0, 50.0
#: A gap above this share of a font's usual advance is a blank.
BLANK_SHARE = 0.35


def line_tops(tops: Column, within: float = LINE_TOL) -> Column:
    """Tops (an array) to map<top, line>: from the top down, what is at most ``within`` below the first of a
    line is on it. A fold, since each line's first decides; a page has few tops."""
    kind = "array<struct<top:double,line:double>>"

    def step(done: Column, top: Column) -> Column:
        first = F.when(F.size(done) > 0, F.element_at(done, -1)["line"])
        line = F.when(first.isNotNull() & (top - first <= within), first).otherwise(top)
        return F.array_append(done, F.struct(top.alias("top"), line.alias("line")))

    return F.map_from_entries(F.aggregate(F.array_sort(F.array_distinct(tops)), F.array().cast(kind), step))


def prose_characters(chars: DataFrame, font: str, top: Column, bottom: Column) -> DataFrame:
    """Characters of the prose font between two heights, right of the margin; blanks are kept, for they
    part words."""
    return chars.where(F.contains("font", F.lit(font)) & (F.col("y0") >= top) & (F.col("y0") < bottom) & (F.col("x0") > PROSE_X))


def in_text_lines(chars: DataFrame, *keys: str, within: float = LINE_TOL) -> DataFrame:
    """chars with ``line``: the top of the line they are on (see line_tops). A null top is on none."""
    tops = chars.where("y0 IS NOT NULL").groupBy(*keys).agg(line_tops(F.collect_set(F.col("y0").cast("double")), within).alias("_lines"))
    return chars.join(tops, list(keys)).withColumn("line", F.col("_lines")[F.col("y0").cast("double")]).drop("_lines").where("line IS NOT NULL")


def advances(chars: DataFrame, *keys: str) -> DataFrame:
    """(keys.., font, advance): the most frequent step between neighbouring characters of a line in one
    font, to a tenth; of equally frequent ones the least."""
    w = Window.partitionBy(*keys, "line").orderBy("x0", "x1", "c")
    steps = chars.withColumns({"_next": F.lead("x0").over(w), "_font": F.lead("font").over(w)}).where("font = _font AND _next > x0")
    n = steps.groupBy(*keys, "font", F.round(F.col("_next") - F.col("x0"), 1).alias("advance")).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys, "font").agg(F.max_by("advance", F.struct(F.col("_n"), -F.col("advance"))).alias("advance"))


def words(chars: DataFrame, *keys: str, share: float = BLANK_SHARE) -> DataFrame:
    """(keys.., line, word, x0, x1, text): the words of each line, numbered from 1.

    chars: keys.., x0, x1, y0, c, font. A word ends at a blank character, or at a gap above ``share`` of what
    its font usually advances: so letters that are set wide stay together, and narrow gaps part in
    narrow type. A font without two characters side by side has no usual advance: gaps don't part.
    """
    lined = in_text_lines(chars, *keys)
    usual = advances(lined, *keys)
    w = Window.partitionBy(*keys, "line").orderBy("x0", "x1", "c")
    blank = F.trim("c") == ""
    met = lined.join(usual, [*keys, "font"], "left").withColumns({"_blank": blank, "_gap": F.col("x0") - F.lag("x1").over(w), "_after": F.lag(blank).over(w)})
    new = F.coalesce(F.col("_after"), F.lit(True)) | F.coalesce(F.col("_gap") > share * F.col("advance"), F.lit(False))
    seen = met.where("NOT _blank").withColumn("_new", new.cast("int")).withColumn("word", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("x0", "x1", "c")))
    return seen.groupBy(*keys, "line", F.col("word").cast("int").alias("word")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(parts, lambda p: p["c"]), "").alias("text"))


def line_texts(found: DataFrame, *keys: str) -> DataFrame:
    """(keys.., line, text): words() as text, a blank between words."""
    parts = F.array_sort(F.collect_list(F.struct("word", "text")))
    return found.groupBy(*keys, "line").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))
