"""Scalar column functions: rounding, parsing, codes, markup, text normal forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 3) -> Column:
    """Rounds half towards plus infinity, keeping null (``round`` goes away from zero)."""
    k = 10**places
    return F.floor(x.cast("double") * k + F.lit(0.5)).cast("double") / F.lit(float(k))


def exact_mean(x: Column, places: int = 4) -> Column:
    """An aggregate: the mean of numbers with so many decimals, whatever their order."""
    k = 10**places
    return F.sum(F.round(x * k).cast("long")) / (F.lit(k) * F.count(x))


def cell_text(x: Column) -> Column:
    """A cell as trimmed text; null is empty."""
    return F.coalesce(F.trim(x.cast("string")), F.lit(""))


def leading_number(x: Column) -> Column:
    """The number a text starts with, or null: ``2.5pts`` is 2.5."""
    found = F.regexp_extract(x, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def difficulty(p: Column) -> Column:
    return F.when(p < 0.5, "hard").when(p < 0.75, "mid").when(p.isNotNull(), "easy")


def gap_class(gap: Column) -> Column:
    """far-below, below, near, above by -.15, -.05 and +.05; null stays null."""
    return F.when(gap <= -0.15, "far-below").when(gap <= -0.05, "below").when(gap < 0.05, "near").when(gap.isNotNull(), "above")


def percent_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")))


def signed_text(x: Column) -> Column:
    """A gap in points with its sign."""
    v = F.floor(x * 100 + 0.5)
    return F.when(x.isNotNull(), F.concat(F.when(v > 0, "+").otherwise(""), v.cast("string")))


# --- codes -------------------------------------------------------------------------


def code_part(code: Column, part: str) -> Column:
    """grade, domain, number or letter of a code such as ``NY-7.RP.2a``; null if absent."""
    group = {"grade": 1, "domain": 2, "number": 3, "letter": 4}[part]
    got = F.nullif(F.regexp_extract(code, r"^(?:NY-)?(\d+)\.([A-Z]+)\.(\d+)([a-z]?)$", group), F.lit(""))
    return got.cast("int") if part in ("grade", "number") else got


def prefixed(code: Column, prefix: str = "NY-") -> Column:
    return F.when(code.startswith(prefix), code).otherwise(F.concat(F.lit(prefix), code))


def unrepeated_prefix(code: Column, prefix: str = "NY-") -> Column:
    """Collapses a repeated prefix to one."""
    return F.regexp_replace(F.trim(code), f"^({prefix}){{2,}}", prefix)


def undotted_letter(code: Column) -> Column:
    """Drops the dot before a sub-letter; other codes stay."""
    return F.regexp_replace(code, r"\.(\d+)\.([a-z])$", ".$1$2")


def base_code(code: Column) -> Column:
    return F.upper(F.translate(code, ".-", ""))


def expanded_codes(line: Column) -> Column:
    """``7.RP.2a, 2b, 3`` as the array of full codes: later members take the stem of the first."""
    parts = F.transform(F.split(line, ","), lambda x: F.trim(x))
    stem = F.regexp_extract(F.get(parts, 0), r"^(.*\.)[^.]*$", 1)
    return F.transform(parts, lambda x: F.when(x.contains("."), x).otherwise(F.concat(stem, x)))


def numeric_order(code: Column) -> Column:
    """Sort key of a dotted numeric code."""
    return F.transform(F.split(code, r"\."), lambda x: x.try_cast("int"))


# --- text --------------------------------------------------------------------------


def normal_title(x: Column) -> Column:
    """Lower case, straight quotes and dashes, runs of anything but [a-z0-9] as one blank."""
    straight = F.translate(F.lower(x), "‘’“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(straight, "[^a-z0-9]+", " "))


def squashed(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+", "")


def clean_text(x: Column) -> Column:
    """Without zero-width characters; special blanks become plain ones."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[​‌‍﻿]", ""), "[     ]", " "))


#: Ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}


def unligated(x: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), x)


def unkerned(x: Column) -> Column:
    """Joins a leading capital that was set apart from its word."""
    return F.regexp_replace(x, r"^([B-HJ-Z]) ([a-z])", "$1$2")


def without_tags(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))


#: The entities of markup, the ampersand last; those of attributes.
ENTITIES = (("&minus;", "\u2212"), ("&divide;", "\u00f7"), ("&le;", "\u2264"), ("&ge;", "\u2265"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))
QUOTES = (("&quot;", '"'), ("&#39;", "'"))

#: The spans of markup and what they read as, by their content; fractions and
#: radicals hold bare spans.
SPANS = (
    (r'<span class="frac"><span>([^<]*)</span><span>([^<]*)</span></span>', "($1)/($2)"),
    (r'<span class="radical"><span class="radicand">([^<]*)</span></span>', "\u221a($1)"),
    (r'<span class="segment">([^<]*)</span>', "segment $1"),
    (r'<span class="repeat">([^<]*)</span>', "$1-repeating"),
    (r"<sup>([^<]*)</sup>", "^$1"),
    (r"<sub>([^<]*)</sub>", "_$1"),
)


def _entities(x: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs, x)


def plain_markup(x: Column, passes: int = 4) -> Column:
    """Markup as text: fractions, radicals, segments, repeating decimals, exponents and indices
    read as such, nested up to ``passes`` deep, innermost first; other tags go. Null is empty.

    Tags without a meaning go before the spans are read, so that they can't hide one: an
    unread fraction would run two numbers into one.
    """
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"</?(?:br|div|p)(?![a-z])[^>]*>", " ")
    x = F.regexp_replace(x, r"</?(?!span[\s>]|su[pb]>)[a-z][^>]*>", "")
    for _ in range(passes):
        for pattern, text in reversed(SPANS):
            x = F.regexp_replace(x, pattern, text)
    x = F.regexp_replace(x, r"</?[a-z][^>]*>", "")
    return F.trim(F.regexp_replace(_entities(x, ENTITIES), r"\s+", " "))


def escaped(x: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), pairs, x)


def field_digest(*cols: Column) -> Column:
    """32 hex digits over fields joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *cols), 256), 1, 32)


def test_parts(name: Column) -> Column:
    """struct<grade, year, id> from a test's id or file name, such as ``g7-2024`` or ``2024-..-g7.pdf``."""
    grade = F.nullif(F.regexp_extract(name, r"(?:^|[-_])g(\d)(?=[-_.]|$)", 1), F.lit("")).try_cast("int")
    year = F.nullif(F.regexp_extract(name, r"(?:^|[^0-9])(20\d\d)(?=[^0-9]|$)", 1), F.lit("")).try_cast("int")
    return F.struct(grade.alias("grade"), year.alias("year"), F.when(grade.isNotNull() & year.isNotNull(), F.format_string("g%d-%d", grade, year)).alias("id"))


def number_list(x: Column) -> Column:
    """All whole numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("int"))


def digits(x: Column) -> Column:
    """The digits of a text as one number; null if it has none."""
    return F.nullif(F.regexp_replace(x, r"[^0-9]", ""), F.lit("")).try_cast("long")


def placed_grade(course: Column) -> Column:
    """The grade in a course's name, such as ``Grade 7 Accelerated``; null if it names none."""
    return F.nullif(F.regexp_extract(course, r"Grade\s+(\d)", 1), F.lit("")).cast("int")


def citation(x: Column) -> Column:
    """struct<grade, unit, lesson, title> from ``Grade 6 Unit 3 Lesson 5: Title``; nulls if none."""
    pattern = r"Grade\s+(\d+)[,\s]+Unit\s+(\d+)[,\s]+Lesson\s+(\d+)(?::\s*(.*))?"
    got = lambda i: F.nullif(F.regexp_extract(x, pattern, i), F.lit(""))
    return F.struct(got(1).cast("int").alias("grade"), got(2).cast("int").alias("unit"), got(3).cast("int").alias("lesson"), F.trim(got(4)).alias("title"))


def coordinates(x: Column) -> Column:
    """array<struct<x,y>> of the pairs in a text; ``negative 3`` reads as -3."""
    signed = F.regexp_replace(x, r"(?i)negative\s+", "-")
    pairs = F.regexp_extract_all(signed, F.lit(r"\(\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*\)"), F.lit(0))
    parts = F.transform(pairs, lambda p: F.split(F.regexp_replace(p, r"[()\s]", ""), ","))
    return F.transform(parts, lambda p: F.struct(F.get(p, 0).cast("double").alias("x"), F.get(p, 1).cast("double").alias("y")))


def mean_distance(a: Column, b: Column) -> Column:
    """Mean L1 distance per coordinate of two equally long arrays of points; else null."""
    total = F.aggregate(
        F.zip_with(a, b, lambda p, q: F.abs(p["x"] - q["x"]) + F.abs(p["y"] - q["y"])), F.lit(0.0), lambda s, d: s + d
    )
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / (2 * F.size(a)))


def word_count(x: Column) -> Column:
    return F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), r"\s+")))


#: Suffixes that the stemmer takes off, in this order.
SUFFIXES = ("ations", "ation", "ings", "ing", "ies", "es", "s")

#: Words without meaning for retrieval.
STOP_WORDS = """
a an the and or but if then than that this these those of to in on at by for with from as is are was
were be been being it its it's he she they them his her their you your we our i me my do does did not
no yes so such can could will would shall should may might must have has had what which who whom whose
when where why how all any both each few more most other some only own same too very just about into
over under again further once here there also use used using show shows shown find finds found give
gives given let lets make makes made get gets got put puts one two three four five six seven eight nine
ten problem problems lesson activity activities student students teacher answer answers response
responses sample explain reasoning following below above table figure figures
""".split()


def stemmed(w: Column) -> Column:
    out = w
    for suffix in reversed(SUFFIXES):
        cut = F.concat(F.left(w, F.length(w) - len(suffix)), F.lit("y" if suffix == "ies" else ""))
        fits = w.endswith(suffix) & (F.length(w) - len(suffix) >= 4)
        # the first suffix that the word ends with and that leaves a stem decides
        out = F.when(fits, cut).otherwise(out)
    return out


def terms(text: Column) -> Column:
    """Stems of the words of three letters or more that aren't stop words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z0-9']+"), F.lit(0))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.transform(kept, stemmed)
