"""From words and rules of a page to the tables printed on it.

Inputs are tables of positioned words (keys.., page, x0, y0, x1, y1, text), of drawn rectangles
(page, x0, y0, x1, y1) and of text spans with font and size, as a reader of the documents
yields them. Keys (a document, a test) run through, so many documents are one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import undotted_letter, unrepeated_prefix
from gradeloom.operators.layout import islands
from gradeloom.operators.stored import checkpointed

#: Fixed values of the booklets: where item numbers stand, and what lies between header and footer.
MARGIN_X, TOP, BOTTOM = 60.0, 60.0, 700.0
#: Fixed values of the charts: rules are this flat and wide; a code line is probed this much lower;
#: lines of one cell lie this close, closer still after a full stop; a mark is this near its line.
RULE_HEIGHT, RULE_WIDTH, PROBE, SAME_CELL, AFTER_SENTENCE, MARK_REACH = 2.5, 40.0, 2.0, 15.5, 13.5, 12.0
#: Fixed values of the maps: what belongs to a row above its anchor; the pitch without neighbours; how
#: far the last row reaches, in pitches.
LEAD, PITCH, LAST_PITCHES = 4.0, 12.0, 1.5
#: Fixed values of the maps: how a code and a statistic are printed.
CODE = r"(?:NGLS|CCSS)\.Math\.Content\.((?:NY-)*\d[A-Za-z0-9.]*)"
STATISTIC = r"^\d?\.\d{1,2}$|^[0-3](?:\.\d{1,2})?$"
TITLE = r"Map to the (?:Learning )?Standards"


def _w(*keys: str) -> Window:
    return Window.partitionBy(*keys)


# --- pages ---------------------------------------------------------------------------


def map_pages(words: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """(keys.., page): the first run of neighbouring pages with the table's title or enough codes."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda w: w["text"]), " ")
    per = words.groupBy(*keys, "page").agg(line.alias("_t"), F.count_if(F.col("text").rlike(CODE)).alias("_n"))
    hits = per.where(F.col("_t").rlike(TITLE) | (F.col("_n") >= least))
    return islands(hits, "page", *keys).where("island = 0").select(*keys, "page")


def section_pages(lines: DataFrame, heading: str, *keys: str) -> DataFrame:
    """(keys.., page): the longest run of pages with a heading, gaps of one page tolerated; of equal
    ones the first. lines: page, text."""
    hits = islands(lines.where(F.contains("text", F.lit(heading))).select(*keys, "page").distinct(), "page", *keys, gap=2)
    size = hits.withColumn("_n", F.count("*").over(_w(*keys, "island")))
    best = size.withColumn("_b", F.max(F.struct(F.col("_n"), -F.col("island"))).over(_w(*keys)))
    return best.where((F.col("_n") == F.col("_b._n")) & (-F.col("island") == F.col("_b")["col2"])).select(*keys, "page")


def margin_numbers(words: DataFrame, *keys: str) -> DataFrame:
    """(keys.., item, page, y): bare numbers in the left margin between header and footer."""
    inside = (F.col("x0") < MARGIN_X) & (F.col("y0") > TOP) & (F.col("y0") < BOTTOM)
    return words.where(inside & F.trim("text").rlike(r"^\d{1,2}$")).select(*keys, F.trim("text").cast("int").alias("item"), "page", F.col("y0").alias("y"))


def printed_pages(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys.., page, printed): the number that a footer line prints."""
    n = F.regexp_extract(F.trim("text"), r"^Page\s+(\d{1,3})$", 1)
    return lines.where(n != "").groupBy(*keys, "page").agg(F.min_by(n.try_cast("int"), "y0").alias("printed"))


def choice_pages(words: DataFrame, *keys: str) -> DataFrame:
    """(keys.., page): pages with each of A, B, C and D as a word of its own."""
    one = words.where(F.trim("text").isin("A", "B", "C", "D") & (F.col("y0") > TOP) & (F.col("y0") < BOTTOM))
    return one.groupBy(*keys, "page").agg(F.countDistinct(F.trim("text")).alias("_n")).where("_n = 4").drop("_n")


def page_map(words: DataFrame, lines: DataFrame, items: DataFrame, skip: DataFrame, *keys: str) -> dict[str, DataFrame]:
    """Where items stand: located (item, page, printed, repeated), stray and unlocated numbers, items
    that don't rise through the booklet, and pages whose choices contradict the items' kind.

    items: keys.., item, type. skip: keys.., page of the map itself, which is full of numbers.
    """
    own = words.join(skip, [*keys, "page"], "left_anti")
    found = margin_numbers(own, *keys).groupBy(*keys, "item").agg(F.min("page").alias("page"), F.min("y").alias("y"), (F.countDistinct("page") > 1).alias("repeated"))
    located = found.join(items.select(*keys, "item", "type"), [*keys, "item"]).join(printed_pages(lines, *keys), [*keys, "page"], "left")
    stray = found.join(items, [*keys, "item"], "left_anti").select(*keys, "item")
    lost = items.join(found, [*keys, "item"], "left_anti").select(*keys, "item")
    falls = located.withColumn("_b", F.lag("item").over(_w(*keys).orderBy("page", "y"))).where(F.col("item") < F.col("_b")).select(*keys, "item", "page")
    kinds = located.groupBy(*keys, "page").agg(F.countDistinct("type").alias("_k"), F.min("type").alias("type")).where("_k = 1")
    both = kinds.join(choice_pages(own, *keys).withColumn("_c", F.lit(True)), [*keys, "page"], "left").withColumn("choices", F.coalesce("_c", F.lit(False)))
    clash = both.where((F.col("type") == "mc") != F.col("choices")).select(*keys, "page", "type", "choices")
    return {"located": located.select(*keys, "item", "page", "printed", "repeated"), "stray": stray, "unlocated": lost, "falls": falls, "type_disagreements": clash}


def item_pages(located: DataFrame, counts: DataFrame, *keys: str) -> DataFrame:
    """(keys.., page): the distinct pages to read, in any order. Of a document with located items
    (keys.., page) those of the items, of one without a single one all pages 1 to ``page_count``.

    counts: (keys.., page_count), a row a document; documents that aren't listed have no pages.
    """
    own = located.where("page IS NOT NULL").select(*keys, F.col("page").cast("int").alias("page")).distinct().join(counts.select(*keys), list(keys), "left_semi")
    rest = counts.where("page_count > 0").join(own.select(*keys).distinct(), list(keys), "left_anti")
    return own.unionByName(rest.select(*keys, F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page")))


# --- item maps -------------------------------------------------------------------------


def header_bands(words: DataFrame, columns: tuple[tuple[str, tuple[str, ...], bool], ...], *keys: str) -> DataFrame:
    """(keys.., page, header_y, name, lo, hi): column bands from the first row that prints all required
    headings; borders lie halfway between their centres; ``stats`` is what lies right of them.

    columns: (name, accepted headings, required). Words within 200 of the last heading belong to it.
    Pages are merged: what is made of a small file may be large, and would be sent to the driver.
    """
    group = [*keys, "page"]
    rows = words.where(F.trim("text") != "").withColumns({"y": F.round("y0", 1), "cx": (F.col("x0") + F.col("x1")) / 2})
    name = F.lit(None).cast("string")
    for i, (n, accepted, _) in enumerate(columns):
        name = F.when(F.col("text").isin(*accepted), F.lit(n)).otherwise(name)
    heads = rows.withColumn("name", name).where("name IS NOT NULL").groupBy(*group, "y", "name").agg(F.min_by(F.struct("cx", "x0", "x1"), "x0").alias("h"))
    needed = [n for n, _, required in columns if required]
    full = heads.groupBy(*group, "y").agg(F.count_if(F.col("name").isin(*needed)).alias("_n")).where(F.col("_n") == len(needed)).groupBy(*group).agg(F.min("y").alias("header_y"))
    at = heads.join(full.hint("merge"), group).where(F.col("y") == F.col("header_y"))
    last = at.groupBy(*group, "header_y").agg(F.max_by("h.x0", "h.cx").alias("_last"))
    right = rows.join(last.hint("merge"), group).where((F.col("y") == F.col("header_y")) & (F.col("x0") <= F.col("_last") + 200)).groupBy(*group).agg(F.max("x1").alias("_right"))
    w = _w(*group).orderBy("h.cx")
    cx = F.col("h.cx")
    bands = at.join(right.hint("merge"), group).select(
        *group, "header_y", "name", F.coalesce((F.lag("h.cx").over(w) + cx) / 2, F.lit(0.0)).alias("lo"), F.coalesce((F.lead("h.cx").over(w) + cx) / 2, F.col("_right") + 8.0).alias("hi")
    )
    stats = last.join(right.hint("merge"), group).select(*group, "header_y", F.lit("stats").alias("name"), (F.col("_right") + 8.0).alias("lo"), F.lit(10_000.0).alias("hi"))
    return bands.unionByName(stats)


def banded_rows(words: DataFrame, bands: DataFrame, *keys: str, number: str = "Question", footnote: str = r"^\*|item map is intended") -> DataFrame:
    """(keys.., page, item, anchor_y, session, name, text): the cells of the logical rows between item
    numbers, a row from just above its anchor to just above the next, the last one and a half pitches.

    A word belongs to the column that holds its centre. What stands below a footnote is left
    out. session is that of the latest heading ``Session n`` above.
    """
    group = [*keys, "page"]
    rows = words.where(F.trim("text") != "").withColumns({"y": F.round("y0", 1), "cx": (F.col("x0") + F.col("x1")) / 2})
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "text"))), lambda w: w["text"]), " ")
    lines = rows.groupBy(*group, "y").agg(line.alias("_line"))
    cut = lines.where(F.trim("_line").rlike(footnote)).groupBy(*group).agg(F.min("y").alias("_cut"))
    head = bands.groupBy(*group).agg(F.first("header_y").alias("_h"))
    sessions = lines.select(*group, "y", F.regexp_extract(F.trim("_line"), r"^Session\s+(\d)$", 1).try_cast("int").alias("_s")).where("_s IS NOT NULL")
    body = rows.join(head, group).join(cut, group, "left").where((F.col("y") > F.col("_h")) & (F.col("_cut").isNull() | (F.col("y") < F.col("_cut"))))
    body = body.join(sessions.select(*group, "y"), [*group, "y"], "left_anti")  # a session's heading is in no row
    cells = checkpointed(body.join(bands.select(*group, "name", "lo", "hi"), group).where((F.col("cx") >= F.col("lo")) & (F.col("cx") < F.col("hi"))).select(*group, "y", "cx", "text", "name"))
    first = cells.where(F.col("name") == number).groupBy(*group, "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "text"))), lambda w: w["text"]), " ").alias("_q"))
    anchors = first.where(F.trim("_q").rlike(r"^\d{1,2}$")).select(*group, F.col("y").alias("anchor_y"), F.trim("_q").cast("int").alias("item"))
    w = _w(*group).orderBy("anchor_y")
    steps = anchors.withColumn("_next", F.lead("anchor_y").over(w)).withColumn("_gap", F.col("_next") - F.col("anchor_y"))
    stats = steps.groupBy(*group).agg(F.count("*").alias("_n"), F.median(F.when(F.col("_gap") > 0, F.col("_gap"))).alias("_m"))
    pitch = F.when(F.col("_n") > 2, F.coalesce("_m", F.lit(PITCH))).otherwise(PITCH)
    spans = steps.join(stats, group).select(*group, "item", "anchor_y", (F.col("anchor_y") - LEAD).alias("_lo"), F.coalesce(F.col("_next") - LEAD, F.col("anchor_y") + pitch * LAST_PITCHES).alias("_hi"))
    marks = spans.select(*group, "anchor_y", "item", "_lo", "_hi", F.lit(None).cast("int").alias("_s")).unionByName(sessions.withColumnRenamed("y", "anchor_y"), allowMissingColumns=True)
    carried = marks.withColumn("session", F.last("_s", ignorenulls=True).over(_w(*group).orderBy("anchor_y").rowsBetween(Window.unboundedPreceding, 0))).where("item IS NOT NULL")
    met = cells.select(*group, "y", "cx", "text", "name").join(carried.drop("_s"), group).where((F.col("y") >= F.col("_lo")) & (F.col("y") < F.col("_hi")))
    return met.groupBy(*group, "item", "anchor_y", "session", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cx", "y", "text"))), lambda w: w["text"]), " ").alias("text"))


def repaired_code(raw: Column) -> Column:
    """struct<code, era, repair>: a repeated prefix collapsed and blanks stripped, saying so."""
    bare = F.trim(raw)
    code = unrepeated_prefix(bare)
    repair = F.when(bare != code, F.concat(F.lit("collapsed a repeated prefix: "), bare)).when(raw != bare, "stripped surrounding white space")
    return F.struct(code.alias("code"), F.when(code.startswith("NY-"), "nextgen").otherwise("ccls").alias("era"), repair.alias("repair"))


def statistics(text: Column, kind: Column) -> Column:
    """struct<p_value, avg_points, ok>: one number of a choice row, two of a constructed one, average
    first; not ok where there are more or fewer."""
    numbers = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda t: t.rlike(STATISTIC)), lambda t: t.try_cast("double"))
    n, mc = F.size(numbers), kind == "mc"
    ok = F.when(mc, n == 1).otherwise(n == 2)
    return F.struct(F.when(ok, F.when(mc, F.get(numbers, F.lit(0))).otherwise(F.get(numbers, F.lit(1)))).alias("p_value"), F.when(ok & ~mc, F.get(numbers, F.lit(0))).alias("avg_points"), ok.alias("ok"))


def parsed_items(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per item of banded_rows(): type, key, credits, codes with their repairs, statistics, and
    what is wrong with it; nothing is repaired beyond a code's prefix."""
    group = [*keys, "page", "item", "anchor_y", "session"]
    names = ("Type", "Key", "Points", "Standard", "Secondary", "Domain", "Subscore", "stats")
    wide = rows.groupBy(*group).agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.trim("text"))), F.lit("")).alias(f"_{n}") for n in names])
    kind = F.when(F.col("_Type").startswith("Multiple Choice"), "mc").when(F.col("_Type").startswith("Constructed"), "cr")
    credits = F.when(F.col("_Points").rlike("^[1-3]$"), F.col("_Points").try_cast("int"))
    codes = F.transform(F.regexp_extract_all(F.concat_ws(" ", "_Standard", "_Secondary"), F.lit(CODE), F.lit(1)), repaired_code)
    none = F.lower("_Key").isin("", "n/a", "na", "-")
    step = wide.withColumns({"type": kind, "credits": credits, "_codes": codes}).withColumns({"_stat": statistics(F.col("_stats"), F.col("type")), "key": F.when((F.col("type") == "mc") & F.col("_Key").rlike("^[A-D]$"), F.col("_Key"))})
    mc = F.col("type") == "mc"
    wrong = F.array_compact(F.array(
        F.when(F.col("type").isNull(), "type"), F.when(mc & F.col("key").isNull(), "key"), F.when((F.col("type") == "cr") & ~none, "key"), F.when(F.col("credits").isNull(), "credits"),
        F.when(mc & (F.col("credits") != 1), "credits"), F.when(F.size("_codes") == 0, "code"), F.when(~F.coalesce("_stat.ok", F.lit(False)), "statistics"),
        F.when(F.col("_stat.avg_points") > F.col("credits"), "average"),
    ))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return step.select(
        *group, "type", "key", "credits", F.get(F.col("_codes"), F.lit(0))["code"].alias("standard"), F.get(F.col("_codes"), F.lit(0))["era"].alias("era"),
        F.transform(F.slice("_codes", F.lit(2), F.greatest(F.size("_codes") - 1, F.lit(0))), lambda c: c["code"]).alias("secondary"), F.array_compact(F.transform("_codes", lambda c: c["repair"])).alias("repairs"),
        empty("_Domain").alias("domain_label"), empty("_Subscore").alias("subscore"), F.col("_stat.p_value").alias("p_value"), F.col("_stat.avg_points").alias("avg_points"), wrong.alias("wrong"),
    )


# --- charts of standards -----------------------------------------------------------------


def chart_bands(words: DataFrame, *keys: str) -> DataFrame:
    """(keys.., page, header_y, name, lo, hi): the four columns of a chart, from where its codes and
    marks stand, not from its headings, which are set off from them."""
    group = [*keys, "page"]
    rows = words.withColumn("y", F.round("y0", 1))
    head = rows.groupBy(*group, "y").agg(*[F.min(F.when(F.col("text") == t, F.col("x0"))).alias(n) for t, n in (("Domain", "_d"), ("Cluster", "_c"), ("Standard(s)", "_s"))])
    head = head.where("_d IS NOT NULL AND _c IS NOT NULL AND _s IS NOT NULL").groupBy(*group).agg(F.min_by(F.struct(F.col("y").alias("header_y"), "_d", "_c"), "y").alias("_h")).select(*group, "_h.*")
    body = rows.join(head, group).where(F.col("y") > F.col("header_y"))
    left = body.where(F.col("text").rlike(r"^NY-\d\.")).groupBy(*group).agg((F.min("x0") - 12.0).alias("_left"))
    met = body.join(left, group)
    marks = met.where((F.trim("text") == "X") & (F.col("x0") > F.col("_left") + 80.0)).groupBy(*group).agg((F.min("x0") - 12.0).alias("_post"))
    one = head.join(left, group).join(marks, group, "left").withColumns({"_mid": (F.col("_d") + F.col("_c")) / 2, "_post": F.coalesce("_post", F.col("_left") + 120.0)})
    bands = F.array(
        F.struct(F.lit("domain").alias("name"), F.lit(0.0).alias("lo"), F.col("_mid").alias("hi")), F.struct(F.lit("cluster").alias("name"), F.col("_mid").alias("lo"), F.col("_left").alias("hi")),
        F.struct(F.lit("standard").alias("name"), F.col("_left").alias("lo"), F.col("_post").alias("hi")), F.struct(F.lit("posttest").alias("name"), F.col("_post").alias("lo"), F.lit(10_000.0).alias("hi")),
    )
    return one.select(*group, "header_y", F.explode(bands).alias("_b")).select(*group, "header_y", "_b.*")


def column_lines(words: DataFrame, bands: DataFrame, *keys: str) -> DataFrame:
    """(keys.., page, name, y, text): the lines of each column below the header, words by their left end."""
    group = [*keys, "page"]
    rows = words.where(F.trim("text") != "").withColumn("y", F.round("y0", 1)).join(bands, group).where((F.col("y") > F.col("header_y")) & (F.col("x0") >= F.col("lo")) & (F.col("x0") < F.col("hi")))
    return rows.groupBy(*group, "name", "y").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"))


def sentence_blocks(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys.., block, top, bottom, text): lines of merged cells. A new cell starts after a large gap,
    or after a full stop and a gap of a line."""
    w = _w(*keys).orderBy("y")
    gap, ended = F.col("y") - F.lag("y").over(w), F.coalesce(F.lag("text").over(w).endswith("."), F.lit(False))
    new = F.when(gap.isNull() | ((gap < SAME_CELL) & ~(ended & (gap > AFTER_SENTENCE))), 0).otherwise(1)
    marked = lines.withColumn("_new", new).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("y", "text")))
    return marked.groupBy(*keys, "block").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def ruled_cells(rules: DataFrame, lines: DataFrame, bands: DataFrame, *keys: str) -> DataFrame:
    """(keys.., page, name, top, bottom, text): a column's merged cells between the rules drawn across it,
    with the lines inside; no rows for a column with fewer than two rules."""
    group = [*keys, "page", "name"]
    flat = rules.where((F.col("y1") - F.col("y0") <= RULE_HEIGHT) & (F.col("x1") - F.col("x0") >= RULE_WIDTH))
    across = flat.join(bands, [*keys, "page"]).where((F.col("x0") < F.col("hi") - 10.0) & (F.col("x1") > F.col("lo") + 10.0))
    edges = across.withColumn("top", F.round("y0", 1)).where(F.col("top") > F.col("header_y") - 12.0).select(*group, "top").distinct()
    cells = edges.withColumn("bottom", F.lead("top").over(_w(*group).orderBy("top"))).where("bottom IS NOT NULL")
    inside = (F.col("y") + PROBE >= F.col("top")) & (F.col("y") + PROBE < F.col("bottom"))
    held = cells.join(lines.select(*group, "y", "text"), group).where(inside).groupBy(*group, "top", "bottom").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "text"))), lambda p: p["text"]), " ").alias("text")
    )
    return cells.join(held, [*group, "top", "bottom"], "left")


def cell_owners(codes: DataFrame, cells: DataFrame, blocks: DataFrame, *keys: str) -> DataFrame:
    """codes (keys.., y, ..) with the text of the cell each falls in: by rules where the column has them,
    else by the blocks' boundaries, halfway from one block's end to the next one's start."""
    ruled = cells.select(*keys).distinct().withColumn("_ruled", F.lit(True))
    by_rule = cells.select(*keys, F.col("top").alias("_t"), F.col("bottom").alias("_b"), F.col("text").alias("_text"))
    probe = (F.col("y") + PROBE >= F.col("_t")) & (F.col("y") + PROBE < F.col("_b"))
    own = codes.select(*keys, "y").distinct()
    a = own.join(by_rule, list(keys)).where(probe).select(*keys, "y", F.col("_text").alias("_rule"))
    w = _w(*keys).orderBy("block")
    spans = blocks.withColumns({"_lo": (F.lag("bottom").over(w) + F.col("top")) / 2, "_hi": (F.col("bottom") + F.lead("top").over(w)) / 2})
    held = (F.col("_lo").isNull() | (F.col("y") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("y") < F.col("_hi")))
    b = own.join(spans.select(*keys, F.col("text").alias("_near"), "_lo", "_hi"), list(keys)).where(held).select(*keys, "y", "_near")
    met = codes.join(ruled, list(keys), "left").join(a, [*keys, "y"], "left").join(b, [*keys, "y"], "left")
    return met.withColumn("owner", F.when(F.col("_ruled"), F.col("_rule")).otherwise(F.col("_near"))).drop("_ruled", "_rule", "_near")


def code_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines with those that only go on with sub-letters folded into the line above, after a comma."""
    w = _w(*keys).orderBy("y")
    goes_on = F.trim("text").rlike(r"^(?:\d+[a-z]\s*,?\s*)+$")
    marked = lines.withColumn("_on", goes_on).withColumn("_entry", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    bare = lambda t: F.regexp_replace(F.trim(t), r"\s*,$", "")
    parts = F.array_sort(F.collect_list(F.struct("y", "text")))
    joined = F.array_join(F.transform(parts, lambda p: bare(p["text"])), ", ")
    return marked.groupBy(*keys, "_entry").agg(F.min("y").alias("y"), F.when(F.count("*") == 1, F.first("text")).otherwise(joined).alias("text")).drop("_entry")


def line_codes(line: Column) -> Column:
    """array<struct<code, note>> of a line such as ``NY-7.EE.4a (Fluency), 4b``: later members take the
    stem of the first; a note in brackets belongs to the code that it follows."""
    first = F.regexp_extract(line, r"(NY-\d\.[A-Z]{1,3}\.)\d+[a-z]?", 1)
    rest = F.regexp_extract(line, r"NY-\d\.[A-Z]{1,3}\.(\d+[a-z]?.*)$", 1)
    parts = F.filter(F.transform(F.split(rest, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+[a-z]?"))
    note = lambda p: F.nullif(F.trim(F.regexp_extract(p, r"\(([^)]+)\)", 1)), F.lit(""))
    each = F.transform(parts, lambda p: F.struct(F.concat(first, F.regexp_extract(p, r"^(\d+[a-z]?)", 1)).alias("code"), note(p).alias("note")))
    return F.when(first != "", each).otherwise(F.array().cast("array<struct<code:string,note:string>>"))


def marked_lines(codes: DataFrame, marks: DataFrame, *keys: str) -> DataFrame:
    """codes (keys.., y, ..) with whether a mark's nearest line is theirs, within reach; ties go up."""
    near = marks.select(*keys, F.col("y").alias("_m")).distinct().join(codes.select(*keys, F.col("y").alias("_y")).distinct(), list(keys))
    best = near.groupBy(*keys, "_m").agg(F.min(F.struct(F.abs(F.col("_y") - F.col("_m")).alias("d"), F.col("_y").alias("y"))).alias("_b"))
    hit = best.where(F.col("_b.d") < MARK_REACH).select(*keys, F.col("_b.y").alias("y")).distinct().withColumn("_hit", F.lit(True))
    return codes.join(hit, [*keys, "y"], "left").withColumn("marked", F.coalesce("_hit", F.lit(False))).drop("_hit")


def chart(words: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """(keys.., page, y, code, note, domain_name, cluster_text, marked): the standards of a chart page."""
    group = [*keys, "page"]
    bands = checkpointed(chart_bands(words, *keys))
    lines = checkpointed(column_lines(words, bands, *keys))  # every column and its cells are read off these
    column = lambda n: lines.where(F.col("name") == n).drop("name")
    codes = code_lines(column("standard"), *group).withColumn("_codes", line_codes(F.col("text"))).where(F.size("_codes") > 0)
    cells = checkpointed(ruled_cells(rules, lines, bands, *keys))
    codes = checkpointed(codes)
    for name, out in (("domain", "domain_name"), ("cluster", "cluster_text")):
        own = cells.where(F.col("name") == name).drop("name")
        codes = cell_owners(codes, own, sentence_blocks(column(name), *group), *group).withColumnRenamed("owner", out)
    codes = marked_lines(codes, column("posttest").where(F.trim("text") == "X"), *group)
    return codes.select(*group, "y", F.explode("_codes").alias("_c"), "domain_name", "cluster_text", "marked").select(*group, "y", "_c.*", "domain_name", "cluster_text", "marked")


def post_test_tables(lines: DataFrame) -> DataFrame:
    """(taught, tested, codes) from pages titled ``Grade n Post-Test Standards Assessed in Grade m``: of
    several pages of a grade the last one counts. lines: page, y, text."""
    title = r"Grade (\d) Post-Test Standards Assessed in Grade (\d)"
    heads = lines.where(F.col("text").rlike(title)).groupBy("page").agg(F.min_by("text", "y").alias("_t")).select("page", F.regexp_extract("_t", title, 1).cast("int").alias("taught"), F.regexp_extract("_t", title, 2).cast("int").alias("tested"))
    codes = code_lines(lines, "page").select("page", F.explode(line_codes(F.col("text"))).alias("_c")).join(heads, "page")
    own = codes.where(F.col("_c.code").startswith(F.concat(F.lit("NY-"), F.col("taught").cast("string"), F.lit("."))))
    per = own.groupBy("taught", "tested", "page").agg(F.array_sort(F.collect_set("_c.code")).alias("codes"))
    return per.groupBy("taught").agg(F.max_by(F.struct("tested", "codes"), "page").alias("_l")).select("taught", "_l.*")


def statements(lines: DataFrame, pages: DataFrame, heading: str, *keys: str) -> DataFrame:
    """(keys.., code, text): the wording of each standard from lines that start with its code and may
    wrap, over the pages of a section; a code that comes again keeps its first wording."""
    own = lines.join(pages, [*keys, "page"], "left_semi").withColumn("text", F.trim("text"))
    noise = F.col("text").isin("", heading) | F.col("text").rlike(r"^(Grade \d Teacher Course Guide|\d+)$|^[A-Z][A-Za-z ,&]+ \([A-Z]{1,3}\)$")
    kept = own.where(~noise)
    code = F.regexp_extract("text", r"^(NY-\d\.[A-Z]{1,3}\.\d+(?:\.?[a-z])?)(?=\s|$)", 1)
    w = _w(*keys).orderBy("page", "y").rowsBetween(Window.unboundedPreceding, 0)
    marked = kept.withColumn("_code", F.nullif(code, F.lit(""))).withColumns({"_entry": F.count("_code").over(w), "_of": F.last("_code", ignorenulls=True).over(w)}).where("_of IS NOT NULL")
    said = F.trim(F.when(F.col("_code").isNotNull(), F.expr("substring(text, length(_code) + 1)")).otherwise(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("page", "y", said.alias("t"))))
    each = marked.groupBy(*keys, "_entry", "_of").agg(F.trim(F.array_join(F.transform(parts, lambda p: p["t"]), " ")).alias("text")).where("text <> ''")
    return each.groupBy(*keys, undotted_letter(F.col("_of")).alias("code")).agg(F.min_by("text", "_entry").alias("text"))


# --- pacing tables -----------------------------------------------------------------------


def pacing_geometry(words: DataFrame, grades: tuple[int, ...] = (6, 7, 8), weeks: int = 35) -> DataFrame:
    """(page, header_y, grade, lo, hi) of pages whose headings ``Grade n`` of all grades share a line and
    whose margin has just so many ``week`` labels."""
    w = _w("page").orderBy("y0", "x0")
    pairs = words.withColumn("_next", F.lead(F.struct("text", "y0")).over(w)).where((F.col("text") == "Grade") & (F.abs(F.col("_next.y0") - F.col("y0")) < 2.0))
    heads = pairs.select("page", "x0", F.round("y0", 0).alias("header_y"), F.col("_next.text").try_cast("int").alias("grade")).where(F.col("grade").isin(*grades))
    full = heads.groupBy("page", "header_y").agg(F.countDistinct("grade").alias("_g"), F.min("x0").alias("_left")).where(F.col("_g") == len(grades))
    labels = words.where(F.col("text") == "week").join(full, "page").where((F.col("x0") < F.col("_left") - 20.0) & (F.col("y0") > F.col("header_y")))
    good = labels.groupBy("page", "header_y").agg(F.count("*").alias("_n")).where(F.col("_n") == weeks).drop("_n")
    at = heads.join(good, ["page", "header_y"]).groupBy("page", "header_y", "grade").agg(F.min("x0").alias("_x"))
    nxt = F.lead("_x").over(_w("page", "header_y").orderBy("_x"))
    return at.select("page", "header_y", "grade", (F.col("_x") - 8.0).alias("lo"), F.coalesce(nxt - 8.0, F.lit(10_000.0)).alias("hi"))


def optional_lessons(text: Column) -> Column:
    """struct<all, lessons> of ``16, 19``, ``none`` or ``all``; null where it reads as neither."""
    body = F.lower(F.regexp_replace(F.trim(text), r"\.$", ""))
    numbers = F.transform(F.regexp_extract_all(body, F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))
    some = F.struct((body == "all").alias("all"), F.when(body.isin("none", "all"), F.array().cast("array<int>")).otherwise(numbers).alias("lessons"))
    return F.when(body.isin("none", "all") | (F.size(numbers) > 0), some)


def pacing_units(lines: DataFrame, weeks: DataFrame, *keys: str) -> DataFrame:
    """(keys.., unit, title, days_lo, days_hi, mid_unit_assessment, all_optional, optional_lessons,
    start_week) of the lines (y, text) of a column; the week is that of the nearest label.

    weeks: page, week, y. Title lines are those before the days; a full stop at the end goes.
    """
    w = _w(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    unit = F.regexp_extract("text", r"^Unit (\d)$", 1).try_cast("int")
    marked = lines.withColumn("_u", unit).withColumns({"unit": F.last("_u", ignorenulls=True).over(w), "_top": F.last(F.when(F.col("_u").isNotNull(), F.col("y")), ignorenulls=True).over(w)}).where("unit IS NOT NULL")
    days = r"^\((\d+)(?:[–—-](\d+))?\s*days?\)\s*(\(MA\))?\s*$"
    is_days, optional = F.col("text").rlike(days), F.regexp_extract("text", r"^Optional Lessons?:\s*(.+?)\s*$", 1)
    seen = F.max(F.when(is_days, 1).otherwise(0)).over(_w(*keys, "unit").orderBy("y").rowsBetween(Window.unboundedPreceding, 0))
    step = marked.withColumns({"_days": is_days, "_opt": optional, "_after": seen})
    title = F.col("_u").isNull() & (F.col("_after") == 0) & (F.col("_opt") == "")
    parts = F.array_sort(F.collect_list(F.when(title, F.struct("y", "text"))))
    got = step.groupBy(*keys, "unit").agg(
        F.first("_top").alias("_top"), F.regexp_replace(F.trim(F.regexp_replace(F.array_join(F.transform(parts, lambda p: p["text"]), " "), r"\s+", " ")), r"\.$", "").alias("title"),
        F.max(F.when(F.col("_days"), F.regexp_extract("text", days, 1).try_cast("int"))).alias("days_lo"), F.max(F.when(F.col("_days"), F.regexp_extract("text", days, 2).try_cast("int"))).alias("_hi"),
        F.coalesce(F.bool_or(F.when(F.col("_days"), F.regexp_extract("text", days, 3) != "")), F.lit(False)).alias("mid_unit_assessment"), F.max(F.when(F.col("_opt") != "", F.col("_opt"))).alias("_o"),
    )
    near = got.join(weeks, [k for k in keys if k in weeks.columns]).groupBy(*keys, "unit").agg(F.min(F.struct(F.abs(F.col("y") - F.col("_top")).alias("d"), "week")).alias("_w"))
    return got.withColumn("_l", optional_lessons(F.col("_o"))).join(near, [*keys, "unit"], "left").select(
        *keys, "unit", "title", "days_lo", F.coalesce("_hi", "days_lo").alias("days_hi"), "mid_unit_assessment", F.col("_l.all").alias("all_optional"), F.col("_l.lessons").alias("optional_lessons"), F.col("_w.week").alias("start_week")
    )


# --- lesson pages --------------------------------------------------------------------------

#: Fixed values of the lesson pages: heads of fields, kinds of activities, labels of standards, fonts and sizes.
FIELD_HEADS = (
    "Goals", "Learning Targets", "Lesson Narrative", "Student Learning Goal", "Required Preparation", "Lesson Synthesis", "Lesson Summary", "Activity Narrative", "Launch",
    "Student Task Statement", "Building on Student Thinking", "Activity Synthesis", "Are You Ready for More?", "Responding to Student Thinking", "Lesson Timeline", "Practice Problems",
)
STANDARD_LABELS = ("Building On", "Addressing", "Building Towards", "Mathematical Practice")
KIND = r"^(Warm-up|Activity\d+|Cool-down)(:Optional)?$"
BODY, BOLD, SEMI, HAND = (10.0, 12.5), "Hellix-Bold", "Hellix-SemiBold", "Sketchnote"
TAB_Y, FOOT_Y, SAME_LINE = 46.0, 820.0, 6.0


def body_spans(spans: DataFrame) -> DataFrame:
    """Spans between the tab strip and the footer, blank ones aside."""
    return spans.where((F.trim("text") != "") & (F.col("y") >= TAB_Y) & (F.col("y") <= FOOT_Y))


def canonical_kind(text: Column) -> Column:
    """``Ac tivity 1`` is ``Activity 1``: the kind of an activity whatever blanks its heading has; null else."""
    bare = F.regexp_replace(text, r"\s+", "")
    name = F.regexp_replace(F.regexp_extract(bare, KIND, 1), r"^Activity(\d+)$", "Activity $1")
    return F.when(bare.rlike(KIND), F.concat(name, F.when(F.regexp_extract(bare, KIND, 2) != "", ": Optional").otherwise("")))


def canonical_field(text: Column) -> Column:
    """The field that a heading names, whatever blanks it has; null if none."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?i)\s*\(continued\)\s*$", ""), r"\s+", "")
    out = F.lit(None).cast("string")
    for h in FIELD_HEADS:
        out = F.when(bare == F.lit("".join(h.split())), F.lit(h)).otherwise(out)
    return out


def headings(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys.., y, x, text, kind): bold runs of a line and coarse column as field, kind, problem or bold."""
    bold = spans.where((F.col("font") == BOLD) & F.col("size").between(*BODY))
    parts = F.array_sort(F.collect_list(F.struct("x", "text")))
    g = bold.groupBy(*keys, F.round(F.col("y") / 3.0).alias("_l"), F.floor(F.col("x") / 200).alias("_c")).agg(F.min("y").alias("y"), F.min("x").alias("x"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("_t"))
    text = F.regexp_replace(F.trim(F.regexp_replace("_t", r"\s+", " ")), r"(?i)\s*\(continued\)\s*$", "")
    g = g.withColumn("_t", text)
    field, kind = canonical_field(F.col("_t")), canonical_kind(F.col("_t"))
    what = F.when(field.isNotNull(), "field").when(kind.isNotNull(), "kind").when(F.col("_t").rlike(r"^Problem\s+\d+$"), "problem").otherwise("bold")
    return g.select(*keys, "y", "x", F.coalesce(field, kind, "_t").alias("text"), what.alias("kind"))


def regions(spans: DataFrame, heads: DataFrame, *keys: str) -> DataFrame:
    """spans with the structural heading whose region holds them: right of its left edge, up to a heading
    beside it or the column's end, down to the next heading below in those bounds."""
    h = heads.where("kind <> 'bold'").select(*keys, F.col("y").alias("hy"), F.col("x").alias("hx"), F.col("text").alias("heading"), F.col("kind").alias("heading_kind"))
    o = heads.where("kind <> 'bold'").select(*keys, F.col("y").alias("oy"), F.col("x").alias("ox"))
    group = [*keys, "hy", "hx", "heading", "heading_kind"]
    beside = (F.abs(F.col("oy") - F.col("hy")) <= SAME_LINE) & (F.col("ox") > F.col("hx") + 5)
    a = h.join(o, list(keys)).groupBy(*group).agg(F.min(F.when(beside, F.col("ox"))).alias("_r"))
    a = a.withColumns({"_left": F.col("hx") - 15, "_right": F.coalesce(F.col("_r") - 5, F.when(F.col("hx") < 200, 470.0).otherwise(670.0))})
    below = (F.col("oy") > F.col("hy") + SAME_LINE) & (F.col("ox") >= F.col("_left")) & (F.col("ox") < F.col("_right"))
    b = a.join(o, list(keys)).groupBy(*group, "_left", "_right").agg(F.coalesce(F.min(F.when(below, F.col("oy"))), F.lit(FOOT_Y + 1)).alias("_bottom"))
    inside = (F.col("x") >= F.col("_left")) & (F.col("x") < F.col("_right")) & (F.col("y") > F.col("hy") + SAME_LINE) & (F.col("y") < F.col("_bottom"))
    return spans.join(b, list(keys)).where(inside).drop("_left", "_right", "_bottom")


def prompts_and_answers(spans: DataFrame, *keys: str) -> DataFrame:
    """spans with ``answer``: a semi-bold ``Sample`` or ``Possible`` opens an answer, the next bold list
    marker closes it; handwriting is always an answer and changes nothing."""
    hand = F.contains("font", F.lit(HAND))
    opens = ~hand & F.col("font").startswith(SEMI) & F.trim("text").rlike(r"^(Sample|Possible)\b")
    closes = ~hand & (F.col("font") == BOLD) & F.trim("text").rlike(r"^\d+\.$|^[a-h]\.$")
    state = F.when(opens, True).when(closes, False)
    w = _w(*keys).orderBy("y", "x").rowsBetween(Window.unboundedPreceding, 0)
    return spans.withColumn("_s", state).withColumn("answer", hand | F.coalesce(F.last("_s", ignorenulls=True).over(w), F.lit(False))).drop("_s")


def prose(spans: DataFrame, *keys: str, line: float = 5.0, space: float = 2.0) -> DataFrame:
    """(keys.., text): spans as running text. Spans within ``line`` of a line's first are one line; a gap
    above ``space`` is a blank; a line that ends in a hyphen runs on."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "x1", "text")))
    empty = "array<struct<y:double,parts:array<struct<x:double,x1:double,text:string>>>>"

    def lines(acc: Column, s: Column) -> Column:
        part = F.struct(s["x"].cast("double").alias("x"), s["x1"].cast("double").alias("x1"), s["text"].alias("text"))
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (s["y"] - F.coalesce(F.get(acc, F.size(acc) - 1)["y"], s["y"]) <= line)
        grown = F.struct(last["y"].alias("y"), F.array_append(last["parts"], part).alias("parts"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(F.struct(s["y"].cast("double").alias("y"), F.array(part).alias("parts"))))).cast(empty)

    def words(acc: Column, p: Column) -> Column:
        wide = acc["end"].isNotNull() & (p["x"] - acc["end"] > space) & ~acc["text"].endswith(" ")
        return F.struct(F.concat(acc["text"], F.when(wide, " ").otherwise(""), p["text"]).alias("text"), p["x1"].alias("end"))

    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))
    tidy = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "[­​‌‍﻿]", ""), "[\\s      ]+", " "))
    texts = F.filter(F.transform(F.aggregate(ordered, F.array().cast(empty), lines), lambda ln: tidy(F.aggregate(F.array_sort(ln["parts"]), start, words, lambda a: a["text"]))), lambda t: t != "")
    joined = F.aggregate(texts, F.lit(""), lambda out, t: F.when((out == "") | out.endswith("-"), F.concat(out, t)).otherwise(F.concat(out, F.lit(" "), t)))
    return spans.groupBy(*keys).agg(joined.alias("text"))


def sidebar_standards(spans: DataFrame, *keys: str, least: float = 8.6, most: float = 9.4, reach: float = 26.0) -> DataFrame:
    """(keys.., label, codes): codes in small type below each bold label of the margin, down to the next."""
    label = F.trim(F.regexp_replace("text", r"\s+", " "))
    marks = spans.where((F.col("font") == BOLD) & F.col("size").between(least, most) & label.isin(*STANDARD_LABELS)).select(*keys, label.alias("label"), F.col("x").alias("mx"), F.col("y").alias("top"))
    marks = marks.withColumn("bottom", F.coalesce(F.lead("top").over(_w(*keys).orderBy("top")), F.col("top") + reach))
    small = spans.where(F.col("font").startswith(SEMI) & F.col("size").between(7.6, 8.4))
    met = marks.join(small, list(keys)).where((F.abs(F.col("x") - F.col("mx")) < 40) & (F.col("y") > F.col("top")) & (F.col("y") < F.col("bottom")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda s: s["text"]), "")
    found = met.groupBy(*keys, "label", "top").agg(F.regexp_extract_all(line, F.lit(r"(NY-[0-9KA-Z][^,\s]*|MP\.\d+)"), F.lit(1)).alias("_c"))
    return found.where(F.size("_c") > 0).select(*keys, "label", F.explode("_c").alias("code")).groupBy(*keys, "label").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def inline_standards(spans: DataFrame, heads: DataFrame, *keys: str, band: float = 14.0) -> DataFrame:
    """(keys.., heading, hy, label, codes): codes printed beside an activity's heading, under the latest label."""
    h = heads.where("kind = 'kind'").select(*keys, F.col("text").alias("heading"), F.col("y").alias("hy"))
    near = spans.where(F.col("size").between(7.8, 8.6)).join(h, list(keys)).where(F.abs(F.col("y") - F.col("hy")) <= band)
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    w = _w(*keys, "heading", "hy").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    said = near.withColumn("_t", text).withColumn("label", F.last(F.when(F.col("_t").isin(*STANDARD_LABELS), F.col("_t")), ignorenulls=True).over(w))
    codes = said.where("label IS NOT NULL").select(*keys, "heading", "hy", "label", F.explode(F.regexp_extract_all("_t", F.lit(r"(NY-[0-9KA-Z][^,\s]*|MP\.\d+)"), F.lit(1))).alias("code"))
    return codes.groupBy(*keys, "heading", "hy", "label").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def outline_lessons(outline: DataFrame, *keys: str) -> DataFrame:
    """(keys.., lesson, page, section, section_title): lessons of an outline (pos, title, page) with the
    latest section above them."""
    section, letter = r"^Section\s+([A-F])\s*[:.]?\s*(.*)$", F.regexp_extract("title", r"^Section\s+([A-F])\b", 1)
    w = _w(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(letter != "", F.struct(letter.alias("l"), F.nullif(F.trim(F.regexp_extract("title", section, 2)), F.lit("")).alias("t")))
    carried = outline.withColumn("_s", F.last(mark, ignorenulls=True).over(w)).withColumn("lesson", F.regexp_extract("title", r"^Lesson\s+(\d+)\b", 1).try_cast("int"))
    return carried.where("lesson IS NOT NULL").select(*keys, "lesson", "page", F.col("_s.l").alias("section"), F.col("_s.t").alias("section_title"))


def number_shape(points: Column, digits: int = 2) -> Column:
    """array<double>: points moved and scaled to their own box, rounded; a flat side is not scaled."""
    lo = lambda f: F.array_min(F.transform(points, lambda p: p[f]))
    span = lambda f: F.array_max(F.transform(points, lambda p: p[f])) - lo(f)
    part = lambda p, f: F.round((p[f] - lo(f)) / F.when(span(f) > 0, span(f)).otherwise(1.0), digits)
    return F.flatten(F.transform(points, lambda p: F.array(part(p, "x"), part(p, "y"))))
