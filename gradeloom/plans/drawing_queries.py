"""Queries: drawings of a page, made of all sentences of all documents.

A document's characters run over rows of 500, fifty rows a page; a sentence's box stands where
its characters do, and its length and words give its height. So boxes touch, overlap, frame
and divide as the texts have it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.operators import characters, compare, drawings, fractions, glyphs, items
from gradeloom.operators.stored import checkpointed
from gradeloom.plans.registry import query, with_parts

ROW, ROWS = 500, 50

BOXES = r"""dlines AS (
  SELECT doc_id AS doc, i, t, length(t) AS n, len(regexp_extract_all(t, '[^ ]+')) AS words,
         sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1 AS off
  FROM (SELECT doc_id, unnest(p) AS t, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.\n]') AS p FROM documents))),
boxes AS (
  SELECT doc, CAST(off // 25000 AS BIGINT) AS page, CAST(i AS INTEGER) AS id, CAST(1 + words % 3 AS INTEGER) AS parts, CAST(n % 3 AS INTEGER) AS kind,
         CAST(72 + off % 500 AS DOUBLE) AS x0, 72 + off % 500 + CASE WHEN n % 7 = 0 THEN n % 90 ELSE least(n * 0.9, 500 - off % 500) END AS x1,
         CAST(60 + 14 * (off // 500 % 50) + n % 11 AS DOUBLE) AS y0,
         60 + 14 * (off // 500 % 50) + n % 11 + CASE WHEN n % 7 = 0 THEN 1.0 WHEN n > 800 THEN 120.0 ELSE 1 + words % 13 END AS y1
  FROM dlines WHERE n > 0)"""

KEYS = ("doc", "page")


def boxes(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(doc, page, id, parts, kind, x0, y0, x1, y1) of all sentences of all documents; more: ``t``, their texts."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.\n]", -1)).alias("id", "t"))
    n, words = F.length("t"), F.regexp_count("t", F.lit("[^ ]+"))
    slim = docs.select("doc", "id", n.alias("n"), words.alias("words"), *more)  # texts aren't shuffled unless they are asked for
    at = F.sum(F.col("n") + 1).over(Window.partitionBy("doc").orderBy("id")) - F.col("n") - 1
    box = slim.withColumn("at", at).where("n > 0")
    x0, y0 = F.expr(f"72 + at % {ROW}").cast("double"), F.expr(f"60 + 14 * (at div {ROW} % {ROWS}) + n % 11").cast("double")
    tenths = F.expr(f"CASE WHEN n % 7 = 0 THEN 10 * (n % 90) ELSE least(9 * n, 10 * ({ROW} - at % {ROW})) END")
    x1 = (x0 * 10 + tenths) / 10  # rounded once: a sum of rounded parts would miss the boxes that end exactly at a limit
    high = F.expr("CASE WHEN n % 7 = 0 THEN 1 WHEN n > 800 THEN 120 ELSE 1 + words % 13 END").cast("double")
    return box.select(
        "doc", F.expr(f"at div {ROW * ROWS}").alias("page"), F.col("id").cast("int").alias("id"), F.expr("1 + words % 3").cast("int").alias("parts"),
        F.expr("n % 3").cast("int").alias("kind"), x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), (y0 + high).alias("y1"), *more,
    )


TOUCHING = """touch AS (
  SELECT a.doc, a.page, a.id AS a, b.id AS b FROM boxes a JOIN boxes b USING (doc, page)
  WHERE a.id <> b.id AND b.y0 < a.y1 AND b.y1 > a.y0 AND b.x0 - a.x1 BETWEEN -1 AND 6)"""


@query(with_parts(BOXES, TOUCHING) + "SELECT doc, page, a, b FROM touch")
def touching_boxes(spark: SparkSession, d: str) -> DataFrame:
    return drawings.touching(boxes(spark, d), *KEYS)


@query(
    "WITH RECURSIVE " + BOXES + ", " + TOUCHING
    + """, reach(doc, page, id, start) AS (
  SELECT doc, page, id, id FROM boxes WHERE kind = 0
  UNION SELECT t.doc, t.page, t.b, r.start FROM reach r JOIN touch t ON t.doc = r.doc AND t.page = r.page AND t.a = r.id)
SELECT doc, page, b.id, min(start) AS run FROM boxes b LEFT JOIN reach r USING (doc, page, id) GROUP BY doc, page, b.id"""
)
def grown_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs from every third sentence on, over boxes that touch: they break at gaps, bend and join."""
    all_ = checkpointed(boxes(spark, d))
    return drawings.grown(all_, all_.where("kind = 0"), *KEYS).select(*KEYS, "id", "run")


THIN = "y1 - y0 < 1.5 AND x1 - x0 > 40"
FRAMED = """furnished AS (
  SELECT b.*, parts = 1 AND x1 - x0 > 300 AND y1 - y0 > 100 OR y1 - y0 < 1.5 AND x1 - x0 > 40 AND (
    SELECT count(*) FROM boxes o WHERE o.doc = b.doc AND o.page = b.page AND o.id <> b.id AND abs(o.y0 - b.y0) < 30 AND o.x1 > b.x0 AND o.x0 < b.x1) < 4 AS furniture
  FROM boxes b)"""


@query(with_parts(BOXES, FRAMED) + "SELECT doc, page, id, furniture FROM furnished")
def page_furniture(spark: SparkSession, d: str) -> DataFrame:
    return drawings.furniture(checkpointed(boxes(spark, d)), *KEYS).select(*KEYS, "id", "furniture")


GLYPH = """(CASE WHEN y1 - y0 < 2.2 AND x1 - x0 < 90 THEN x1 - x0 > 0.5 AND y1 - y0 > 0.2
  ELSE y1 - y0 >= 16 AND y1 - y0 < 26 AND x1 - x0 > 2.5 AND x1 - x0 < 5.5 OR x1 - x0 > 0.5 AND x1 - x0 < 14 AND y1 - y0 > 0.5 AND y1 - y0 < 16 END)"""
ZONES = f"""deep AS (SELECT *, max(y1) OVER (PARTITION BY doc, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deepest FROM furnished WHERE NOT furniture),
blocks AS (SELECT *, sum(CASE WHEN y0 > deepest + 14 THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS block FROM deep),
zones AS (
  SELECT doc, page, block, count(*) AS parts, min(x0) FILTER (WHERE x1 > x0 AND y1 > y0) AS x0, min(y0) FILTER (WHERE x1 > x0 AND y1 > y0) AS y0,
         max(x1) FILTER (WHERE x1 > x0 AND y1 > y0) AS x1, max(y1) FILTER (WHERE x1 > x0 AND y1 > y0) AS y1
  FROM blocks GROUP BY doc, page, block
  HAVING count(*) FILTER (WHERE NOT {GLYPH} AND NOT (y1 - y0 < 2 AND x1 - x0 < 40)) >= 2 AND count(*) >= 6)"""


@query(
    with_parts(BOXES, FRAMED, ZONES)
    + """SELECT doc, page, b.id, furniture, EXISTS (SELECT 1 FROM zones z WHERE z.doc = b.doc AND z.page = b.page AND (z.x1 - z.x0) * (z.y1 - z.y0) >= 2000
  AND (b.x0 + b.x1) / 2 BETWEEN z.x0 - 4 AND z.x1 + 4 AND (b.y0 + b.y1) / 2 BETWEEN z.y0 - 4 AND z.y1 + 4) AS in_figure
FROM furnished b"""
)
def figure_parts(spark: SparkSession, d: str) -> DataFrame:
    """Which boxes lie in a figure: blocks of drawings with structure, parts and an area."""
    all_ = checkpointed(drawings.furniture(checkpointed(boxes(spark, d)), *KEYS))
    zones = drawings.figure_zones(all_.where("NOT furniture"), *KEYS)
    return drawings.in_zones(all_, zones, *KEYS).select(*KEYS, "id", "furniture", "in_figure")


SIDE = "o.doc = b.doc AND o.page = b.page AND o.id <> b.id AND (o.x0 + o.x1) / 2 BETWEEN b.x0 - 1.5 AND b.x1 + 1.5"
UP, DOWN = "b.y0 - (o.y0 + o.y1) / 2", "(o.y0 + o.y1) / 2 - b.y1"


@query(
    with_parts(BOXES)
    + f"""SELECT doc, page, id, y1 - y0 < 2.2 AND x1 - x0 > 3 AND x1 - x0 < 90
    AND EXISTS (SELECT 1 FROM boxes o WHERE {SIDE} AND {UP} > 0 AND {UP} < 14)
    AND EXISTS (SELECT 1 FROM boxes o WHERE {SIDE} AND {DOWN} > 0 AND {DOWN} < 14 AND NOT ({UP} > 0 AND {UP} < 14)) AS bar
FROM boxes b"""
)
def fraction_bars(spark: SparkSession, d: str) -> DataFrame:
    return drawings.fraction_bars(checkpointed(boxes(spark, d)), *KEYS).select(*KEYS, "id", "bar")


OVERBARS = f"""sides AS (
  SELECT b.doc, b.page, b.id, b.x0, b.x1, b.y1, {UP} > 0 AND {UP} < 14 AS above, o.x0 AS o0, o.x1 AS o1, o.y0 AS p0,
         NOT ({UP} > 0 AND {UP} < 14) AND least(b.x1, o.x1) - greatest(b.x0, o.x0) > 0.5 * (o.x1 - o.x0) AS covered
  FROM boxes b JOIN boxes o ON {SIDE} AND (o.y1 - o.y0 >= 2.2 OR o.x0 > b.x0 - 0.5 AND o.x1 < b.x1 + 0.5)
  WHERE b.y1 - b.y0 < 2.2 AND ({UP} > 0 AND {UP} < 14 OR {DOWN} > 0 AND {DOWN} < 14)),
spans AS (
  SELECT doc, page, id, x0, x1, y1, bool_or(above) AS above, min(p0) FILTER (WHERE covered) - y1 AS gap, min(o0) FILTER (WHERE covered) AS lo, max(o1) FILTER (WHERE covered) AS hi
  FROM sides GROUP BY doc, page, id, x0, x1, y1)"""


@query(
    with_parts(BOXES, OVERBARS)
    + """SELECT doc, page, b.id, coalesce(NOT above AND gap >= 0 AND gap < 5 AND hi > lo AND least(s.x1, hi) - greatest(s.x0, lo) > 0.6 * (hi - lo), false) AS overbar
FROM boxes b LEFT JOIN spans s USING (doc, page, id)"""
)
def overbars(spark: SparkSession, d: str) -> DataFrame:
    rules = boxes(spark, d).withColumn("rule", F.col("y1") - F.col("y0") < drawings.RULE_H)
    return drawings.overbars(checkpointed(rules), *KEYS).select(*KEYS, "id", "overbar")


@query(
    with_parts(BOXES)
    + """SELECT b.doc, b.page, b.id, t.y, min(t.x1) <= b.x0 + 0.4 AND max(t.x0) >= b.x1 - 0.4 AS bracketed
FROM boxes b JOIN (SELECT doc, page, floor(y0 / 14) * 14 AS y, x0, x1 FROM boxes WHERE kind > 0) t ON t.doc = b.doc AND t.page = b.page AND b.y0 < t.y + 11 AND b.y1 > t.y - 2
WHERE b.kind = 0 GROUP BY b.doc, b.page, b.id, b.x0, b.x1, t.y"""
)
def bracketed_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Drawings with prose of their line on both sides; two sentences in three are prose."""
    all_ = checkpointed(boxes(spark, d))
    text = all_.where("kind > 0").select(*KEYS, (F.floor(F.col("y0") / 14) * 14).cast("double").alias("y"), "x0", "x1")
    met = drawings.in_lines(all_.where("kind = 0"), drawings.line_ends(text, *KEYS), *KEYS)
    return met.select(*KEYS, "id", "y", drawings.bracketed().alias("bracketed"))


@query()
def observed_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of three numbers from all vectors, in the order of their numbers: whose cluster each joins."""
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    shapes = v.select(F.col("vec_id").alias("place"), F.lit("out").alias("form"), F.col("label").cast("string").alias("bucket"), F.transform(F.slice("embedding", 1, 3), lambda c: c.cast("double")).alias("points"))
    return glyphs.observed(shapes, 0.06)


PLOTS = """marks AS (
  SELECT doc_id AS doc, length(t) AS n, len(regexp_extract_all(t, '[^ ]+')) AS words, 4 + doc_id % 3 AS half
  FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '[.\n]')) AS t FROM documents))"""


@query(with_parts(PLOTS) + "SELECT DISTINCT doc, CAST(n % (2 * half + 1) - half AS INTEGER) AS px, CAST(words % (2 * half + 1) - half AS INTEGER) AS py FROM marks WHERE n % 2 = 0 AND n % 5 <> 0 AND doc % 5 <> 0")
def plotted_points(spark: SparkSession, d: str) -> DataFrame:
    """A plot a document, a dot a sentence: some unfilled, some beside the grid, one plot in five without
    an axis that stands out."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), (4 + F.col("doc_id") % 3).cast("int").alias("half"), (5.0 + F.col("doc_id") % 7).alias("step"), "text")
    lines = docs.select("doc", "half", "step", F.explode(F.expr("sequence(-half, half)")).alias("i"))
    over = F.expr("half * step + if(i = 0 and doc % 5 <> 0, 8, 0)")
    at = F.col("i") * F.col("step")
    flat = lambda x0, y0, x1, y1, filled: ["doc", *[c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))], filled.alias("filled")]
    drawn = lines.select(*flat(200 + at - 0.2, 300 - over, 200 + at + 0.2, 300 + over, F.lit(False)))
    drawn = drawn.unionByName(lines.select(*flat(200 - over, 300 + at - 0.2, 200 + over, 300 + at + 0.2, F.lit(False))))
    marks = docs.select("doc", "half", "step", F.explode(F.split(F.coalesce("text", F.lit("")), "[.\n]", -1)).alias("t"))
    marks = marks.select("doc", "half", "step", F.length("t").alias("n"), F.regexp_count("t", F.lit("[^ ]+")).alias("words"))
    x, y = F.expr("200 + step * (n % (2 * half + 1) - half + if(n % 5 = 0, 0.4, 0))"), F.expr("300 - step * (words % (2 * half + 1) - half)")
    dots = marks.select(*flat(x - 2, y - 2, x + 2, y + 2, F.col("n") % 2 == 0))
    return glyphs.plotted_points(drawn.unionByName(dots), "doc")


BUILDS = """old AS (SELECT doc_id AS k, string_split(text, chr(10)) AS p, lang, source, n_chars AS n FROM documents),
size AS (SELECT *, len(p) AS old_n, len(p) - CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 1 THEN 2 ELSE 0 END AS new_n FROM old WHERE k % 13 <> 0)"""


@query(
    with_parts(BUILDS)
    + """SELECT k, '' AS path, 'lost' AS kind FROM old WHERE k % 13 = 0
UNION ALL SELECT k + 1000000000, '', 'added' FROM old WHERE k % 17 = 0
UNION ALL SELECT k, 'meta.n', 'changed' FROM size WHERE k % 7 = 0 AND n IS NOT NULL
UNION ALL SELECT k, 'meta', 'changed' FROM size WHERE k % 29 = 1 AND k % 7 <> 0
UNION ALL SELECT k, 'lines[' || (old_n - 1) || ']', 'lost' FROM size WHERE k % 5 = 0
UNION ALL SELECT k, 'lines[' || (old_n + unnest([0, 1])) || ']', 'added' FROM size WHERE k % 5 = 1
UNION ALL SELECT k, 'lines[' || i || ']', 'changed' FROM (SELECT k, new_n, unnest(p) AS t, unnest(range(len(p))) AS i FROM size WHERE k % 3 = 0) WHERE i < new_n AND t LIKE '%a%'
UNION ALL SELECT k, 'marks[lang]', 'lost' FROM size WHERE k % 4 = 0
UNION ALL SELECT k, 'marks[text]', 'added' FROM size WHERE k % 4 = 0"""
)
def build_differences(spark: SparkSession, d: str) -> DataFrame:
    """All documents as nested rows, and a later build of them: rows, fields, lines and entries that went, came or changed."""
    k = F.col("k")
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("k"), F.split("text", "\n", -1).alias("lines"), "lang", "source", F.col("n_chars").alias("n"))
    meta = lambda n: F.struct("source", n.alias("n"))
    old = docs.select("k", meta(F.col("n")).alias("meta"), "lines", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("marks"))
    less = F.when(k % 5 == 0, F.slice("lines", F.lit(1), F.size("lines") - 1)).when(k % 5 == 1, F.concat("lines", F.array(F.lit("x"), F.lit("y")))).otherwise(F.col("lines"))
    said = lambda t, i: F.when((i < F.size("lines")) & (k % 3 == 0), F.replace(t, F.lit("a"), F.lit("A"))).otherwise(t)
    marks = F.create_map(F.when(k % 4 == 0, "text").otherwise("lang"), "lang", F.lit("source"), "source")
    gone = F.when((k % 29 == 1) & (k % 7 != 0), F.lit(None)).otherwise(meta(F.col("n") + F.when(k % 7 == 0, 1).otherwise(0)))
    new = docs.where(k % 13 != 0).select("k", marks.alias("marks"), F.transform(less, said).alias("lines"), gone.alias("meta"))
    more = old.where(k % 17 == 0).withColumn("k", k + 1_000_000_000)
    return compare.differences(old, new.unionByName(more), "k").select("k", "path", "kind")


@query("""WITH cut AS (SELECT page_id, p, unnest(p) AS t, unnest(range(len(p))) AS i FROM (SELECT page_id, regexp_extract_all(url, '[^/]+/?|/') AS p FROM pages)),
placed AS (SELECT page_id, 6 + page_id % 2 AS a, CAST(i + 1 AS INTEGER) AS word, t, sum(length(t)) OVER w - length(t) AS start, sum(CASE WHEN t LIKE '%/' THEN 1 ELSE 0 END) OVER w - CASE WHEN t LIKE '%/' THEN 1 ELSE 0 END AS gaps FROM cut WINDOW w AS (PARTITION BY page_id ORDER BY i))
SELECT page_id // 10 AS page, CAST(60 + 14 * (page_id % 10) AS DOUBLE) AS line, word, CAST(72 + a * start + 4 * gaps AS DOUBLE) AS x0, t AS text FROM placed""")
def words_of_characters(spark: SparkSession, d: str) -> DataFrame:
    """Every character of every url on its own, ten urls a page in type of two widths; a gap, not a blank, follows each slash."""
    urls = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.posexplode(F.split("url", "")).alias("i", "c")).where("c <> ''")
    a = 6 + F.col("page_id") % 2
    before = F.expr("length(substring(url, 1, i)) - length(replace(substring(url, 1, i), '/', ''))")
    x0 = (72 + a * F.col("i") + 4 * before).cast("double")
    y0 = (60 + 14 * (F.col("page_id") % 10) + F.when(F.col("i") % 3 == 2, 0.8).otherwise(0.0)).cast("double")
    chars = urls.select(F.floor(F.col("page_id") / 10).alias("page"), x0.alias("x0"), (x0 + a - 0.8).alias("x1"), y0.alias("y0"), "c", F.concat(F.lit("Prose-"), a).alias("font"))
    return characters.words(checkpointed(chars), "page").select("page", "line", "word", "x0", "text")


@query()
def page_items(spark: SparkSession, d: str) -> DataFrame:
    """Pages read as items: two sentences in three are prose, the others drawings that read as their first
    letter, if they have one; four choice letters a page."""
    all_ = checkpointed(boxes(spark, d, "t"))
    letter = F.regexp_extract("t", r"([A-Za-z])", 1)
    drawn = all_.where("kind = 0").select(*KEYS, "id", "x0", "y0", "x1", "y1", "parts", F.nullif(letter, F.lit("")).alias("label"))
    text = all_.where("kind > 0").select(*KEYS, (F.floor(F.col("y0") / 14) * 14).cast("double").alias("y"), "x0", "x1", F.col("t").alias("text"))
    pages = all_.select(*KEYS).distinct()
    letters = pages.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(c).alias("letter"), F.lit(75.0).alias("x"), F.lit(600.0 + 30 * i).alias("y")) for i, c in enumerate("ABCD")])).alias("l")).select(*KEYS, "l.*")
    found = items.items(drawn, text, letters, *KEYS)
    return found["items"].select(*KEYS, F.length("stem").cast("long").alias("stem_length"), F.md5("stem").alias("stem_md5"), "unread")


@query(with_parts("said AS (SELECT doc_id AS doc, unnest(p) AS t, unnest(range(len(p))) AS i FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.\\n]') AS p FROM documents))", "n AS (SELECT doc, i, t, length(t) AS n FROM said WHERE length(t) > 0)", "bodies AS (SELECT DISTINCT doc FROM n WHERE n % 4 = 0)") + """SELECT doc, CAST(4 * i AS INTEGER) AS id, CAST(40 * i AS DOUBLE) AS y, t AS text FROM n WHERE n % 4 = 0
UNION ALL SELECT doc, CAST(4 * i AS INTEGER), 40 * i + 1.5, n || '/' || (n + 1) FROM n JOIN bodies USING (doc) WHERE n % 4 = 1""")
def folded_fractions(spark: SparkSession, d: str) -> DataFrame:
    """A line a sentence, of all documents: body type, fractions of the sentence's length, rules that nothing stands above, small type."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "[.\n]", -1)).alias("i", "t"))
    n = F.length("t")
    piece = lambda k, dy, size, text: F.struct((F.col("i") * 4 + k).cast("int").alias("id"), F.lit(10.0).alias("x"), F.lit(30.0).alias("x1"), (F.col("i") * 40.0 + dy).alias("y"), F.lit(size).alias("size"), text.cast("string").alias("text"))
    rule, above, below = piece(0, 0.0, 9.7, F.lit("___")), piece(1, -6.0, 8.25, n), piece(2, 6.0, 8.25, n + 1)
    line = F.when(n % 4 == 0, F.array(piece(0, 0.0, 11.0, F.col("t")))).when(n % 4 == 1, F.array(rule, above, below)).when(n % 4 == 2, F.array(rule, below)).otherwise(F.array(above))
    spans = docs.where(n > 0).select("doc", F.explode(line).alias("s")).select("doc", "s.*")
    return fractions.folded_fractions(spans, "doc").select("doc", "id", "y", "text")
