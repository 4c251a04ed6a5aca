"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Every document gets text measures. Their distribution is kept per (language,
source) as a log-linear histogram: a value keeps its leading ``PRECISION`` bits, so
a bucket is at most 1/32 of its value wide. Such sketches merge by adding counts,
whatever the order, and so the language's and the corpus's sketches are sums of the
sources' ones. Two quantiles of a sketch give a fence: the outer one plus ``fence`` times
its distance from the inner one. Where damage comes in large shares (symbols, word length)
they are the quartiles, which up to a quarter of damaged documents can't move; where good
texts have long tails (repetitions) they are the percentiles 90 and 99, so the fence follows
the tail. A source's fences are drawn towards those of its language, and these towards the
corpus's, as if ``WEIGHT`` documents of the coarser sketch had been added: few documents
hardly move the coarser fences, many decide alone, and no count switches from one to the
other. Documents outside are rejected.

The distance is at least a measure's resolution: a bucket of the sketch, or for symbols one
of them in the shortest text that passes the base rules.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import WORD, saved, table, text_or_empty

PRECISION = 6
#: Documents of the coarser sketch that a finer one's fences are mixed with.
WEIGHT = 50
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Measure:
    """A per-document integer measure, the percentiles its fences are made from, how many of
    their distances lie between the outer one and the fence, and the measure's resolution."""

    name: str
    expr: str
    inner: int
    outer: int
    fence: int
    resolution: int
    low_side: bool = False


MEASURES = (
    Measure("symbols", "n_symbols * 1000 div greatest(n_words, 1)", 25, 75, 3, 20),
    Measure("word_length", "word_chars * 100 div greatest(n_words, 1)", 25, 75, 9, 16, low_side=True),
    Measure("dup_lines", "n_dup_lines * 1000 div greatest(n_words, 1)", 90, 99, 3, 1),
    Measure("repeats", "n_repeat_words * 1000 div greatest(n_words, 1)", 90, 99, 3, 1),
)


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to ``docs``.

    A null or empty text has 0 everywhere; a long one is measured whole. Columns of those
    names in ``docs`` are replaced; columns starting with ``_q_`` are used inside.
    """
    t = text_or_empty(text)
    n = F.size("_q_words")
    step = docs.withColumns({
        "_q_words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        "_q_lines": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
    })
    step = step.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_hash": F.transform(
            F.slice("_q_words", F.lit(1), F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_q_words", i + 1), F.get("_q_words", i + 2)),
        ),
    }).drop("_q_words", "_q_lines")
    # windows by hash, with their places; only where some window comes twice
    placed = F.transform("_q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeated = F.size(F.array_distinct("_q_hash")) < F.size("_q_hash")
    step = step.withColumn("_q_sorted", F.when(repeated, F.sort_array(placed)).otherwise(F.slice(placed, 1, 0))).drop("_q_hash")
    same = lambda x, k: F.get("_q_sorted", k)["h"].eqNullSafe(x["h"])
    step = step.withColumn(
        "_q_starts",
        F.array_sort(F.transform(F.filter("_q_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])),
    ).drop("_q_sorted")
    covered = F.transform("_q_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("_q_starts", k + 1) - s, F.lit(3))))
    return step.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long")).drop("_q_starts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def sketch_bucket(v: Column) -> Column:
    """Lower end of the sketch bucket of a non-negative long."""
    shift = F.greatest(F.length(F.bin(v)) - PRECISION, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., measure, bucket, n): one sketch for each group and measure, as rows."""
    pairs = ", ".join(f"'{m.name}', {m.expr}" for m in MEASURES)
    long = measured.select(*keys, F.expr(f"stack({len(MEASURES)}, {pairs}) as (measure, value)"))
    return long.groupBy(*keys, "measure", sketch_bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser sketches as sums of finer ones."""
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., total, <measure>_lo, <measure>_hi) from the percentiles of each sketch."""
    w = Window.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({"cum": F.sum("n").over(w.orderBy("bucket")), "total": F.sum("n").over(w)})
    percents = sorted({p for m in MEASURES for p in (m.inner, m.outer, 100 - m.outer)})
    at = [F.min(F.when(F.col("cum") * 100 >= F.col("total") * p, F.col("bucket"))).alias(f"p{p}") for p in percents]
    points = ranked.groupBy(*keys, "measure").agg(*at, F.max("total").alias("total"))
    cols = [F.max("total").alias("total")]
    for m in MEASURES:
        reach = F.greatest(F.col(f"p{m.outer}") - F.col(f"p{m.inner}"), F.lit(m.resolution)) * m.fence
        mine = F.col("measure") == m.name
        cols.append(F.max(F.when(mine, F.greatest(F.col(f"p{100 - m.outer}") - reach, F.lit(0)))).alias(f"{m.name}_lo"))
        cols.append(F.max(F.when(mine, F.col(f"p{m.outer}") + reach)).alias(f"{m.name}_hi"))
    return points.groupBy(*keys).agg(*cols)


def source_fences(measured: DataFrame, weight: int) -> DataFrame:
    """(f_lang, f_source, f_<measure>_lo, f_<measure>_hi): one row per (language, source).

    Each fence is (n * own + weight * coarser) / (n + weight), in whole numbers, over the
    sketch's n documents; the coarser one is the language's, mixed likewise with the corpus's.
    """
    fine = saved(sketches(measured, ["lang", "source"]), "sketches")
    by_lang = merged(fine, ["lang"])
    whole = merged(by_lang, [])
    names = [f"{m.name}_{side}" for m in MEASURES for side in ("lo", "hi")]
    a = fences(fine, ["lang", "source"])
    b = fences(by_lang, ["lang"]).select(F.col("lang").alias("b_lang"), F.col("total").alias("b_total"), *[F.col(x).alias(f"b_{x}") for x in names])
    one = whole.withColumn("one", F.lit(1))
    c = fences(one, ["one"]).select("one", *[F.col(x).alias(f"c_{x}") for x in names])
    joined = a.join(b, F.col("lang").eqNullSafe(F.col("b_lang")), "left").withColumn("one", F.lit(1)).join(c, "one", "left")
    own = lambda x: F.expr(f"(total * {x} + {weight} * ((b_total * b_{x} + {weight} * c_{x}) div (b_total + {weight}))) div (total + {weight})")
    return joined.select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *[own(x).alias(f"f_{x}") for x in names])


def inside() -> Column:
    """Whether a row's measures lie within its fences."""
    ok = F.lit(True)
    for x in MEASURES:
        v = F.expr(x.expr)
        ok = ok & (v <= F.col(f"f_{x.name}_hi"))
        if x.low_side:
            ok = ok & (v >= F.col(f"f_{x.name}_lo"))
    return ok


def judged(measured: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """Adds base_failed and kept to a table with the text measures, lang and source.

    Sketches are taken over the documents that pass the base rules. A (language,
    source) none of whose documents passes has no fences, and its documents fail
    anyway. Null languages and sources form groups of their own.
    """
    m = measured.withColumn("base_failed", base_failed())
    limits = source_fences(m.where(~F.col("base_failed")), weight)
    joined = m.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside(), F.lit(False)))
    return joined.withColumn("kept", kept).drop(*[c for c in limits.columns])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """doc_id, the five counts, base_failed, kept: one row per row of ``docs``.

    Defined results: null or empty text: zero counts, base_failed; very long texts are
    measured whole; a value that ties with a fence is inside; repeated rows are judged each
    and count each; an empty table gives an empty result; other columns of ``docs`` are not
    used, whatever their names.
    """
    own = text_measures(docs.select("doc_id", "text", "lang", "source")).drop("text")
    return judged(saved(own, "measures"), weight).select("doc_id", *COUNTS, "base_failed", "kept")


def filter_quality(docs: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """The rows of ``docs`` that quality() keeps, with their own columns.

    Every text is measured once: the rows are stored beside their measures, the fences come
    from the measures alone, and the stored rows are joined with them, so texts are never
    shuffled unless the fences outgrow a broadcast. Nulls, empty and very long texts, ties
    and repeated rows are judged as by quality(); an empty table stays empty; columns may
    have any names.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_q_row"))
    measured = saved(text_measures(packed, "_q_row.text"), "measured").where(~base_failed())
    m = measured.select("*", F.col("_q_row.lang").alias("lang"), F.col("_q_row.source").alias("source"))
    limits = saved(source_fences(m.select("lang", "source", *COUNTS), weight), "fences")
    joined = m.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")))
    return joined.where(inside()).select("_q_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


#: The measures and fences in SQL, over the table {docs}.
MEASURE_SQL = r"""
m_words AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS rid
  FROM {docs}),
m_windows AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM m_words)),
m_twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM m_windows) WHERE k > 1),
m_covered AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM m_twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
measured AS (
  SELECT doc_id, lang, source, rid, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM m_words LEFT JOIN m_covered USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
         n_symbols * 1000 // greatest(n_words, 1) AS v1, word_chars * 100 // greatest(n_words, 1) AS v2,
         n_dup_lines * 1000 // greatest(n_words, 1) AS v3, n_repeat_words * 1000 // greatest(n_words, 1) AS v4
  FROM measured),
vals AS (
  SELECT coalesce(lang, '?') AS l, coalesce(source, '?') AS s, u.m,
         CASE WHEN length(bin(u.v)) > 6 THEN (u.v >> (length(bin(u.v)) - 6)) << (length(bin(u.v)) - 6) ELSE u.v END AS b
  FROM (SELECT lang, source, unnest([{{'m': 1, 'v': v1}}, {{'m': 2, 'v': v2}}, {{'m': 3, 'v': v3}}, {{'m': 4, 'v': v4}}]) AS u
        FROM judged WHERE NOT base_failed)),
groups AS (
  SELECT l, s, m, b, count(*) AS n FROM vals GROUP BY GROUPING SETS ((l, s, m, b), (l, m, b), (m, b))),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY l, s, m ORDER BY b) AS cum, sum(n) OVER (PARTITION BY l, s, m) AS total FROM groups),
points AS (
  SELECT l, s, m, min(b) FILTER (WHERE cum * 4 >= total) AS p25, min(b) FILTER (WHERE cum * 4 >= total * 3) AS p75,
         min(b) FILTER (WHERE cum * 10 >= total * 9) AS p90, min(b) FILTER (WHERE cum * 100 >= total * 99) AS p99, max(total) AS total
  FROM ranked GROUP BY l, s, m),
fence AS (
  SELECT l, s, max(total) AS total,
         max(p75 + 3 * greatest(p75 - p25, 20)) FILTER (WHERE m = 1) AS hi1,
         max(greatest(p25 - 9 * greatest(p75 - p25, 16), 0)) FILTER (WHERE m = 2) AS lo2,
         max(p75 + 9 * greatest(p75 - p25, 16)) FILTER (WHERE m = 2) AS hi2,
         max(p99 + 3 * greatest(p99 - p90, 1)) FILTER (WHERE m = 3) AS hi3,
         max(p99 + 3 * greatest(p99 - p90, 1)) FILTER (WHERE m = 4) AS hi4
  FROM points GROUP BY l, s),
mixed AS (
  SELECT f1.l, f1.s, {mixed}
  FROM fence f1 JOIN fence f2 ON f2.l = f1.l AND f2.s IS NULL JOIN fence f3 ON f3.l IS NULL AND f3.s IS NULL
  WHERE f1.s IS NOT NULL),
chosen AS (
  SELECT j.*, f FROM judged j LEFT JOIN mixed f ON f.l = coalesce(j.lang, '?') AND f.s = coalesce(j.source, '?'))"""

_MIXED = ", ".join(f"CAST((f1.total * f1.{x} + {WEIGHT} * ((f2.total * f2.{x} + {WEIGHT} * f3.{x}) // (f2.total + {WEIGHT}))) // (f1.total + {WEIGHT}) AS BIGINT) AS {x}" for x in ("hi1", "lo2", "hi2", "hi3", "hi4"))

ORACLE = (
    "WITH "
    + MEASURE_SQL.format(docs="documents", mixed=_MIXED)
    + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(v1 <= f.hi1 AND v2 BETWEEN f.lo2 AND f.hi2 AND v3 <= f.hi3 AND v4 <= f.hi4, false) AS kept
FROM chosen"""
)
