"""Rule packs: what must hold of published tables, as findings (key, rule, level).

Packs over single rows are lists of ``quality.Rule``; packs that compare tables are functions
that return findings. A rule that applies to nothing is skipped by ``quality.outcomes``, never
passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import code_part, field_digest, normal_title, placed_grade, word_count
from gradeloom.operators.expressions import balanced
from gradeloom.operators.quality import Rule

#: The shape of a code, keys, credits of constructed items, and tolerances.
CODE_SHAPE = r"^NY-\d\.[A-Z]{1,3}\.\d+[a-z]?$"
KEYS, CR_CREDITS, SHARE_TOLERANCE, QUOTE_WORDS = ("A", "B", "C", "D"), (1, 2, 3), 8.0, 15

#: Words of which a domain's cluster descriptions use one at least.
DOMAIN_WORDS = {
    "NS": ("rational", "irrational", "number", "fraction", "divide", "multiply", "factor", "integer", "radical", "exponent"),
    "EE": ("exponent", "equation", "expression", "slope", "linear", "radical", "inequalit", "variable", "arithmetic", "proportional"),
    "F": ("function",),
    "RP": ("ratio", "proportional", "rate", "percent", "unit"),
    "G": ("congruen", "transformation", "similar", "angle", "pythagor", "volume", "rotation", "dilat", "area", "surface", "circle", "geometr", "coordinate", "classify", "two-dimensional", "shapes", "perimeter", "figures"),
    "SP": ("scatter", "bivariate", "associat", "pattern", "data", "frequenc", "distribution", "variabilit", "probabilit", "chance", "random", "sample", "inference", "population", "statistic"),
    "OA": ("expression", "pattern", "operation"),
    "NBT": ("place value", "decimal", "multi-digit", "operations"),
    "MD": ("measure", "data", "volume", "angle", "convert"),
    "NF": ("fraction", "decimal"),
}


def _finding(key: str, rule: str, level: str = "fail") -> list[Column]:
    return [F.col(key).cast("string").alias("key"), F.lit(rule).alias("rule"), F.lit(level).alias("level")]


def item_structure() -> list[Rule]:
    """Thirteen properties of an item, over columns id, type, key, credits, avg_points, p_value,
    session, item, designed_items, grade, standard, in_registry, assessed_on, registry_grade, post_test."""
    mc, cr = F.col("type") == "mc", F.col("type") == "cr"
    known = F.col("in_registry")
    return [
        Rule("mc-key", ~F.coalesce(F.col("key").isin(*KEYS), F.lit(False)), applies=mc),
        Rule("mc-one-credit", F.col("credits") != 1, applies=mc),
        Rule("cr-no-key", F.col("key").isNotNull(), applies=cr),
        Rule("cr-credits", ~F.col("credits").isin(*CR_CREDITS), applies=cr),
        Rule("cr-average", F.col("avg_points").isNull(), applies=cr),
        Rule("average-within-credits", F.col("avg_points") > F.col("credits"), applies=cr & F.col("avg_points").isNotNull()),
        Rule("p-value", ~F.coalesce((F.col("p_value") > 0) & (F.col("p_value") <= 1), F.lit(False))),
        Rule("session", ~F.coalesce(F.col("session").isin(1, 2), F.lit(False))),
        Rule("designed-number", F.col("item") > F.col("designed_items")),
        Rule("in-registry", ~F.coalesce(known, F.lit(False))),
        Rule("assessed-on-grade", ~F.coalesce(F.array_contains("assessed_on", F.col("grade")), F.lit(False)), applies=known),
        Rule("post-test-agrees", (F.col("registry_grade") != F.col("grade")) != F.coalesce("post_test", F.lit(False)), applies=known),
        Rule("code-shape", ~F.coalesce(F.col("standard").rlike(CODE_SHAPE), F.lit(False))),
    ]


def page_links() -> list[Rule]:
    """Over pdf_page, page_count, source_url: a link points at its own item's page, or at none."""
    url, page = F.coalesce("source_url", F.lit("")), F.col("pdf_page")
    has = page.isNotNull()
    return [
        Rule("page-in-document", page > F.col("page_count"), applies=has),
        Rule("fragment-is-page", ~url.endswith(F.concat(F.lit("#page="), page.cast("string"))), applies=has),
        Rule("no-page-no-fragment", url.contains("#page="), applies=~has),
    ]


def domain_shares(items: DataFrame, ranges: DataFrame, tolerance: float = SHARE_TOLERANCE) -> DataFrame:
    """Warnings (test:domain) where the released share of credits is off its range by more than that.

    ranges: grade, domain, lo, hi in percent; a domain that a test doesn't release has share 0.
    """
    total = items.groupBy("test", "grade").agg(F.sum("credits").alias("_all"))
    got = items.groupBy("test", "domain").agg(F.sum("credits").alias("_c"))
    met = total.join(ranges, "grade").join(got, ["test", "domain"], "left").withColumn("share", F.coalesce("_c", F.lit(0)) * 100 / F.col("_all"))
    off = met.where((F.col("share") < F.col("lo") - tolerance) | (F.col("share") > F.col("hi") + tolerance))
    return off.withColumn("key", F.concat_ws(":", "test", "domain")).select(*_finding("key", "domain-share", "warn"))


def registry(codes: DataFrame) -> DataFrame:
    """Domains printed with several names, and descriptions that aren't sentences or not about
    their domain. codes: code, domain, printed_name, cluster_text."""
    names = codes.where(F.col("printed_name").isNotNull()).groupBy("domain").agg(F.countDistinct("printed_name").alias("_n")).where("_n > 1")
    text = F.col("cluster_text")
    said = codes.where(text.isNotNull() & (text != ""))
    words = F.create_map(*[x for d, ws in DOMAIN_WORDS.items() for x in (F.lit(d), F.array(*[F.lit(w) for w in ws]))])
    own = F.coalesce(F.element_at(words, F.col("domain")), F.array().cast("array<string>"))
    about = F.exists(own, lambda w: F.contains(F.lower(text), w))
    return (
        names.select(*_finding("domain", "one-name-per-domain"))
        .unionByName(said.where(~F.rtrim(text).endswith(".")).select(*_finding("code", "description-is-a-sentence")))
        .unionByName(said.where(~about).select(*_finding("code", "description-is-about-its-domain")))
    )


def curriculum(units: DataFrame, lessons: DataFrame, cites: DataFrame, codes: DataFrame, bare: DataFrame, grades: tuple[int, ...] = (6, 7, 8)) -> DataFrame:
    """The index of lessons: every grade, pacing of every unit, resolvable codes, and lessons without
    a citation just where they are recorded.

    units: grade, unit, days, start_week. lessons: grade, unit, lesson. cites: grade, unit,
    lesson, code. codes: code. bare: grade, unit, lesson. A parent of known codes resolves; an
    unresolved code is a warning.
    """
    spark = units.sparkSession
    lesson = ["grade", "unit", "lesson"]
    label = lambda df: df.withColumn("key", F.concat_ws(".", *[F.col(c).cast("string") for c in lesson]))
    every = spark.createDataFrame([(g,) for g in grades], "grade int")
    gone = every.join(units.select("grade").distinct(), "grade", "left_anti")
    unpaced = units.where(F.col("days").isNull() | F.col("start_week").isNull()).withColumn("key", F.concat_ws(".", F.col("grade").cast("string"), F.col("unit").cast("string")))
    known = codes.select("code").unionByName(codes.where(F.col("code").rlike("[A-Za-z0-9]$")).select(F.expr("substring(code, 1, length(code) - 1)").alias("code"))).distinct()
    lost = cites.select("code").distinct().join(known, "code", "left_anti")
    empty = lessons.select(*lesson).join(cites.select(*lesson).distinct(), lesson, "left_anti")
    return (
        gone.select(*_finding("grade", "grade-is-indexed"))
        .unionByName(unpaced.select(*_finding("key", "unit-is-paced")))
        .unionByName(lost.select(*_finding("code", "cited-code-resolves", "warn")))
        .unionByName(label(empty.join(bare, lesson, "left_anti")).select(*_finding("key", "bare-lesson-is-recorded")))
        .unionByName(label(bare.select(*lesson).join(empty, lesson, "left_anti")).select(*_finding("key", "recorded-lesson-is-bare")))
    )


def unit_filter(items: DataFrame, taught: DataFrame) -> DataFrame:
    """(id, how, units) by a second derivation of an item's units, to hold against the explorer's.

    items: id, grade, course, unit, standard, secondary. taught: grade, standard, unit, already
    expanded to the codes that items cite. how: judged, elsewhere, derived or none.
    """
    codes = F.array_union(F.array("standard"), F.coalesce("secondary", F.array().cast("array<string>")))
    cited = items.where("unit IS NULL").select("id", "grade", F.explode(codes).alias("standard")).join(taught.select("grade", "standard", F.col("unit").alias("_u")).distinct(), ["grade", "standard"])
    derived = cited.groupBy("id").agg(F.array_sort(F.collect_set("_u")).alias("_units"))
    met = items.join(derived, "id", "left")
    judged = F.col("unit").isNotNull()
    mine = judged & F.coalesce(placed_grade(F.col("course")) == F.col("grade"), F.lit(False))
    how = F.when(mine, "judged").when(judged, "elsewhere").when(F.col("_units").isNotNull(), "derived").otherwise("none")
    units = F.when(mine, F.array("unit")).when(judged | F.col("_units").isNull(), F.array().cast("array<int>")).otherwise(F.col("_units"))
    return met.select("id", how.alias("how"), units.alias("units"))


#: Damage that no published text may have.
KERNED = r"(?<![A-Za-z0-9])[A-Za-z] \([A-Za-z](?:\s*[-+\x{2212}]\s*\d+)?\)"
BROKEN, THIN = "[Āā�]", "[  ]"
REPEATED = r'<span class="repeat">(.*?)</span>'


def transcription() -> list[Rule]:
    """Over id, type, stem, stem_after, choices (label, text, is_correct), choices_in_image, answer,
    answer_source, official_key: texts are whole, undamaged and answered by the official key."""
    texts = F.array_union(F.array(F.coalesce("stem", F.lit("")), F.coalesce("stem_after", F.lit(""))), F.coalesce(F.transform("choices", lambda c: F.coalesce(c["text"], F.lit(""))), F.array().cast("array<string>")))
    blob = F.array_join(texts, " ")
    bare = lambda x: F.regexp_replace(x, r"<[^>]+>", "")
    n = F.coalesce(F.size("choices"), F.lit(0))
    right = F.coalesce(F.size(F.filter("choices", lambda c: c["is_correct"])), F.lit(0))
    mc, printed = F.col("type") == "mc", ~F.coalesce("choices_in_image", F.lit(False))
    marked = F.get(F.transform(F.filter("choices", lambda c: c["is_correct"]), lambda c: c["label"]), F.lit(0))
    letters = F.exists(F.regexp_extract_all(blob, F.lit(REPEATED), F.lit(1)), lambda m: bare(m).rlike(r"[^0-9.,]"))
    cr = F.col("type") == "cr"
    return [
        Rule("balanced-tags", ~F.forall(texts, balanced)),
        Rule("four-choices", n < 4, applies=mc & printed),
        Rule("one-correct-choice", right != 1, applies=mc & printed & (n >= 4)),
        Rule("choice-not-empty", F.exists("choices", lambda c: F.trim(bare(F.coalesce(c["text"], F.lit("")))) == ""), applies=mc & printed & (n >= 4) & (right == 1)),
        Rule("cr-has-answer", F.col("answer").isNull(), applies=cr),
        Rule("answer-has-source", F.coalesce(F.trim("answer_source"), F.lit("")) == "", applies=F.col("answer").isNotNull()),
        Rule("no-glyph-damage", blob.rlike(BROKEN)),
        Rule("no-thin-space", blob.rlike(THIN)),
        Rule("no-open-kerning", bare(blob).rlike(KERNED)),
        Rule("bars-say-what-they-are", blob.contains("√") | letters),
        Rule("key-is-official", marked != F.col("official_key"), applies=marked.isNotNull() & F.col("official_key").isNotNull()),
    ]


def figures() -> list[Rule]:
    """Over file, type, alt, long_description, present: figures are there and described alike."""
    alt, said = F.lower(F.coalesce("alt", F.lit(""))), F.lower(F.coalesce("long_description", F.lit("")))
    word = lambda c, w: c.rlike(rf"\b{w}\b")
    clash = (word(alt, "radius") & word(said, "diameter") & ~word(said, "radius")) | (word(alt, "diameter") & word(said, "radius") & ~word(said, "diameter"))
    described = F.coalesce("long_description", F.lit(""))
    choices = F.contains(F.lower(F.coalesce("type", F.lit(""))), F.lit("answer choices"))
    named = F.lit(True)
    for letter in KEYS:
        named = named & word(described, letter)
    return [
        Rule("figure-is-there", ~F.coalesce("present", F.lit(False))),
        Rule("figure-has-alt", F.trim(F.coalesce("alt", F.lit(""))) == ""),
        Rule("alt-agrees", clash, applies=(alt != "") & (said != "")),
        Rule("choices-are-told-apart", ~named, applies=choices),
    ]


def prose_fidelity(published: DataFrame, drafts: DataFrame) -> DataFrame:
    """Items whose stem, bare of markup and mathematics, isn't the draft's prose; that keep unread
    holes; that have no draft. published: id, bare (see expressions.bare_prose). drafts: id, prose, holes."""
    d = drafts.select("id", F.regexp_replace("prose", r"\s+", "").alias("_p"), "holes", F.lit(True).alias("_d"))
    met = published.join(d, "id", "left")
    return (
        met.where(F.col("_d") & ~F.col("bare").eqNullSafe(F.col("_p"))).select(*_finding("id", "prose-is-the-page's"))
        .unionByName(met.where(F.coalesce("holes", F.lit(0)) > 0).select(*_finding("id", "no-hole-left")))
        .unionByName(met.where(F.col("_d").isNull()).select(*_finding("id", "draft-behind-it")))
    )


def activity_lookup(evidence: DataFrame, activities: DataFrame, problems: DataFrame) -> DataFrame:
    """evidence (grade, unit, lesson, activity, ..) with the page and body of the activity of that
    name in its lesson, else of the practice problem; ``found`` is null where neither is.

    activities: grade, unit, lesson, name, page, body; problems: the same shape.
    """
    keys = ["grade", "unit", "lesson", "_name"]
    first = lambda df, p: df.withColumn("_name", normal_title(F.col("name"))).groupBy(*keys).agg(F.min_by(F.struct("page", "body"), "page").alias(p))
    met = evidence.withColumn("_name", normal_title(F.col("activity"))).join(first(activities, "_a"), keys, "left").join(first(problems, "_b"), keys, "left")
    hit = F.coalesce("_a", "_b")
    found = F.when(F.col("_a").isNotNull(), "activity").when(F.col("_b").isNotNull(), "problem")
    return met.select(*evidence.columns, found.alias("found"), hit["page"].alias("index_page"), hit["body"].alias("body"))


def alignment(entries: DataFrame, evidence: DataFrame, items: DataFrame, lessons: DataFrame, activities: DataFrame, problems: DataFrame) -> DataFrame:
    """Entries name items that exist, lessons by number and title, activities by page, and quote them.

    entries: id, course, unit, primary_lesson, lesson_title. evidence: id, lesson, lesson_title,
    activity, page, quote, role. items: id. lessons: grade, unit, lesson, title.
    """
    ghosts = entries.join(items.select("id"), "id", "left_anti")
    e = entries.withColumn("grade", F.coalesce(placed_grade(F.col("course")), F.regexp_extract("id", r"^g(\d)", 1).try_cast("int")))
    index = lessons.select("grade", "unit", "lesson", F.col("title").alias("_title"))
    cited = evidence.join(e.select("id", "grade", "unit"), "id").join(index, ["grade", "unit", "lesson"], "left")
    here = cited.where(F.col("_title").isNotNull())
    prime = e.where(F.col("primary_lesson").isNotNull()).withColumn("lesson", F.col("primary_lesson")).join(index, ["grade", "unit", "lesson"], "left")
    supported = evidence.select("id", F.col("lesson").alias("primary_lesson")).distinct().withColumn("_yes", F.lit(True))
    with_evidence = prime.join(evidence.select("id").distinct(), "id", "left_semi").join(supported, ["id", "primary_lesson"], "left")
    differs = lambda a, b: ~normal_title(F.coalesce(a, F.lit(""))).eqNullSafe(normal_title(F.coalesce(b, F.lit(""))))
    thin = F.coalesce("activity", F.lit("")) == ""
    looked = activity_lookup(here.where(~thin), activities, problems)
    quote = normal_title(F.coalesce("quote", F.lit("")))
    unquoted = F.col("found").isNotNull() & (F.coalesce("quote", F.lit("")) != "") & ~F.contains(normal_title(F.coalesce("body", F.lit(""))), quote)
    twice = evidence.groupBy("id", "lesson", normal_title(F.col("activity")).alias("_a"), "role").agg(F.count("*").alias("_n")).where("_n > 1")
    found = [
        (ghosts, "item-exists"),
        (cited.where(F.col("_title").isNull()), "lesson-exists"),
        (prime.where(F.col("_title").isNull()), "lesson-exists"),
        (here.where(differs(F.col("_title"), F.col("lesson_title"))), "title-is-the-lesson's"),
        (prime.where(F.col("_title").isNotNull() & differs(F.col("_title"), F.col("lesson_title"))), "title-is-the-lesson's"),
        (with_evidence.where(F.col("_title").isNotNull() & F.col("_yes").isNull()), "primary-lesson-has-evidence"),
        (here.where(thin | F.col("page").isNull()), "activity-and-page"),
        (here.where(word_count(F.coalesce("quote", F.lit(""))) > QUOTE_WORDS), "quote-is-short"),
        (looked.where(F.col("found").isNull()), "activity-exists"),
        (looked.where(unquoted), "quote-is-there"),
        (looked.where(F.col("index_page").isNotNull() & ~F.col("page").eqNullSafe(F.col("index_page"))), "page-is-the-activity's"),
        (twice, "activity-cited-once"),
    ]
    out = None
    for df, rule in found:
        rows = df.select(*_finding("id", rule))
        out = rows if out is None else out.unionByName(rows)
    return out


def citation_index(evidence: DataFrame, activities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Activities that verified citations name (with page), and the digests of their quotes.

    evidence: grade, course, unit, lesson, activity, quote. A citation is verified if the
    activity's body holds its quote; one that isn't has no row in either.
    """
    none = activities.limit(0)
    met = activity_lookup(evidence, activities, none)
    good = met.where(F.col("found").isNotNull() & F.contains(normal_title(F.coalesce("body", F.lit(""))), normal_title(F.coalesce("quote", F.lit("")))))
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))
    digests = good.select(field_digest(*[tidy(F.col(c)) for c in ("course", "lesson", "activity", "quote")]).alias("digest")).distinct()
    named = good.select("grade", "unit", "lesson", normal_title(F.col("activity")).alias("activity"), F.col("index_page").alias("page")).distinct()
    return named, digests


def misfiled(entries: DataFrame, taught: DataFrame) -> DataFrame:
    """Entries (id, grade, standard, unit) whose unit isn't one that the table gives for the standard,
    its parent or its children; entries of standards that the table doesn't have are left out."""
    stem = lambda c: F.regexp_replace(c, "[A-Za-z]+$", "")
    t = taught.select("grade", F.col("standard").alias("_code"), stem("standard").alias("_stem"), F.col("unit").alias("_unit")).distinct()
    met = entries.withColumn("_stem", stem("standard")).join(t, ["grade", "_stem"])
    near = (F.col("standard") == F.col("_code")) | (F.col("standard") == F.col("_stem")) | (F.col("_code") == F.col("_stem"))
    return met.where(near).groupBy("id").agg(F.bool_or(F.col("unit") == F.col("_unit")).alias("_in"), F.array_sort(F.collect_set("_unit")).alias("units")).where("NOT _in").select("id", "units")


def numbering(rows: DataFrame, number: str, *keys: str) -> DataFrame:
    """(keys.., missing, repeated) of groups whose numbers aren't 1..n: how many lack, how many come twice."""
    g = rows.groupBy(*keys).agg(F.max(number).alias("_max"), F.countDistinct(number).alias("_d"), F.count("*").alias("_n"))
    return g.select(*keys, (F.col("_max") - F.col("_d")).alias("missing"), (F.col("_n") - F.col("_d")).alias("repeated")).where("missing > 0 OR repeated > 0")


def not_rising(rows: DataFrame, value: str, order: str, *keys: str) -> DataFrame:
    """Rows whose value is no greater than the one before: letters that don't ascend, weeks that go back."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("before", before).where(F.col(value) <= F.col("before"))


def pacing_identity(units: DataFrame) -> DataFrame:
    """Units whose day range isn't lessons + 2, one more with a mid-unit assessment, down to that
    less the optional lessons; a last unit of optional lessons runs from 0 to its lessons.

    units: grade, unit, lessons, n_optional, all_optional, mid_unit_assessment, days_lo, days_hi.
    """
    hi = F.col("lessons") + 2 + F.when(F.coalesce("mid_unit_assessment", F.lit(False)), 1).otherwise(0)
    whole = F.coalesce("all_optional", F.lit(False))
    want_hi, want_lo = F.when(whole, F.col("lessons")).otherwise(hi), F.when(whole, 0).otherwise(hi - F.col("n_optional"))
    return units.withColumns({"want_lo": want_lo, "want_hi": want_hi}).where((F.col("days_lo") != F.col("want_lo")) | (F.col("days_hi") != F.col("want_hi")))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, status) of two tables (key, codes): overlap, disjoint, or only one has codes."""
    met = a.select(key, F.col("codes").alias("_a")).join(b.select(key, F.col("codes").alias("_b")), key, "full_outer")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    status = F.when(none("_a") & none("_b"), "neither").when(none("_a"), "only-b").when(none("_b"), "only-a").when(F.arrays_overlap("_a", "_b"), "overlap").otherwise("disjoint")
    return met.select(key, status.alias("status"))


def chart_and_table(chart: DataFrame, table: DataFrame, excused: tuple[int, ...] = ()) -> DataFrame:
    """(grade, code, side): codes that only the chart or only the table marks, grades excused aside."""
    a, b = chart.select("grade", "code").distinct(), table.select("grade", "code").distinct()
    both = a.exceptAll(b).withColumn("side", F.lit("chart")).unionByName(b.exceptAll(a).withColumn("side", F.lit("table")))
    return both.where(~F.col("grade").isin(*excused)) if excused else both


def item_map_faults(rows: DataFrame) -> DataFrame:
    """Parsed item maps (test, item, place, type, key, credits, avg_points, p_value): numbers that
    repeat or fall, keys in mostly one letter, credits and statistics out of range."""
    tag = rows.withColumn("key_", F.concat_ws("-", "test", F.col("item").cast("string")))
    w = Window.partitionBy("test").orderBy("place")
    repeats = tag.groupBy("test", "key_").agg(F.count("*").alias("_n")).where("_n > 1")
    falls = tag.withColumn("_b", F.lag("item").over(w)).where(F.col("item") < F.col("_b"))
    keys = rows.where("type = 'mc'").groupBy("test", "key").agg(F.count("*").alias("_n"))
    top = keys.groupBy("test").agg(F.max("_n").alias("_m"), F.sum("_n").alias("_t")).where("_m > _t * 0.6")
    cr = tag.where("type = 'cr'")
    return (
        repeats.select(*_finding("key_", "number-once"))
        .unionByName(falls.select(*_finding("key_", "numbers-rise")))
        .unionByName(top.select(*_finding("test", "keys-vary")))
        .unionByName(cr.where(~F.coalesce(F.col("credits").isin(*CR_CREDITS), F.lit(False))).select(*_finding("key_", "cr-credits")))
        .unionByName(cr.where("avg_points IS NULL").select(*_finding("key_", "cr-average")))
        .unionByName(tag.where(~F.coalesce((F.col("p_value") > 0) & (F.col("p_value") <= 1), F.lit(False))).select(*_finding("key_", "p-value")))
    )


def second_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, first, second): items that two extractions both have, with different keys."""
    met = a.select("id", F.col("key").alias("first")).join(b.select("id", F.col("key").alias("second")), "id")
    return met.where(F.col("first").isNotNull() & F.col("second").isNotNull() & (F.col("first") != F.col("second")))


def home_grade(code: Column, grade: Column, taught: tuple[int, ...] = (6, 7, 8)) -> Column:
    """The grade whose curriculum teaches a code, of those that are taught; else the item's own."""
    named = F.regexp_extract(code, r"^NY-([1-8])\.", 1).try_cast("int")
    return F.when(named.isin(*taught), named).otherwise(grade)
