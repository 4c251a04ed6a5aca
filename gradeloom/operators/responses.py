"""Wide response sheets as long cells, many sheets at once: header, guarded columns, students.

cells: keys.., r, c, value: row and column from 0 and the cell's text, null if empty. Every
step is grouped by the keys (the file and the sheet, unless others are given), so a hundred
thousand workbooks are one plan. Only question columns are read, and two guarded ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.scalars import cell_text, leading_number

KEYS = ("path", "sheet")
#: A question's header such as ``Q7 (6.RP.3a)``, and the rows that are searched.
HEADER = r"^Q\s*(\d+)\s*\(\s*([0-9]+(?:\.[A-Za-z0-9]+)+)\s*\)$"
HEADER_ROWS, LEAST_HEADERS = 40, 10
GUARD_ROWS, LEVEL_ROWS = 39, 399
NAME_SHAPED = r"^[A-Za-z][A-Za-z', .-]{3,}$"
LONGEST_SECTION, LEVELS = 8, (1.0, 4.6)
PREFIX = "NY-"


def questions(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys.., head, question, c, code) of the first row with enough different question headers.

    Of a question that is headed twice, the first column counts.
    """
    keys = keys or KEYS
    v = cell_text(F.col("value"))
    hits = cells.where((F.col("r") < HEADER_ROWS) & v.rlike(HEADER)).select(
        *keys, "r", "c", F.regexp_extract(v, HEADER, 1).try_cast("int").alias("question"), F.concat(F.lit(PREFIX), F.regexp_extract(v, HEADER, 2)).alias("code")
    )
    per = hits.groupBy(*keys, "r").agg(F.countDistinct("question").alias("_n")).where(F.col("_n") >= LEAST_HEADERS)
    head = per.groupBy(*keys).agg(F.min("r").alias("head"))
    first = hits.join(head, list(keys)).where(F.col("r") == F.col("head"))
    return first.groupBy(*keys, "head", "question").agg(F.min_by(F.struct("c", "code"), "c").alias("_f")).select(*keys, "head", "question", "_f.*")


def left_cells(cells: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """(keys.., head, r, c, v): what stands left of the column of the lowest question, from the header on."""
    keys = keys or KEYS
    frame = asked.groupBy(*keys, "head").agg(F.min_by("c", "question").alias("_first"))
    return cells.join(frame, list(keys)).where((F.col("c") < F.col("_first")) & (F.col("r") >= F.col("head"))).select(*keys, "head", "r", "c", cell_text(F.col("value")).alias("v"))


def looks_like_identity(left: DataFrame, *keys: str, least: int = 3) -> DataFrame:
    """(keys.., names): sheets with that many different name-shaped values in the first three columns."""
    keys = keys or KEYS
    near = left.where((F.col("c") < 3) & (F.col("r") > F.col("head")) & (F.col("r") <= F.col("head") + GUARD_ROWS) & F.col("v").rlike(NAME_SHAPED))
    return near.groupBy(*keys).agg(F.countDistinct("v").alias("names")).where(F.col("names") >= least)


def _guarded(left: DataFrame, headed: Column, rows: int, good: Column, some: bool, *keys: str) -> DataFrame:
    """(keys.., c): the first column with that header, unless a value below it is not good."""
    first = left.where((F.col("r") == F.col("head")) & headed).groupBy(*keys).agg(F.min("c").alias("c"))
    below = left.where((F.col("r") > F.col("head")) & (F.col("r") <= F.col("head") + rows) & (F.col("v") != ""))
    judged = below.join(first, [*keys, "c"]).groupBy(*keys, "c").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("_good"))
    met = first.join(judged, [*keys, "c"], "left")
    return met.where(F.coalesce("_good", F.lit(not some))).select(*keys, "c")


def section_column(left: DataFrame, *keys: str) -> DataFrame:
    """(keys.., c): the column headed ``class`` whose values are short codes; refused as a whole else."""
    v = F.col("v")
    good = (F.length(v) <= LONGEST_SECTION) & ~v.contains(",") & ~v.rlike(NAME_SHAPED)
    return _guarded(left, F.lower("v") == "class", GUARD_ROWS, good, False, *(keys or KEYS))


def level_column(left: DataFrame, *keys: str) -> DataFrame:
    """(keys.., c): the column headed ``nys math``, not the first one, whose values all lie in the
    scale of levels; there must be one at least."""
    headed = (F.col("c") >= 1) & (F.lower("v") == "nys math")
    return _guarded(left, headed, LEVEL_ROWS, leading_number(F.col("v")).between(*LEVELS), True, *(keys or KEYS))


@dataclass
class Sheets:
    """What is read of sheets, by their keys.

    status (usable, why, identities); questions (question, code); students (student, section,
    level), a student being a row's number; responses (student, question, value) without
    empty cells; levels: the sheets that have a column of levels.
    """

    keys: tuple[str, ...]
    status: DataFrame
    questions: DataFrame
    students: DataFrame
    responses: DataFrame
    levels: DataFrame


def _column(cells: DataFrame, which: DataFrame, name: str, value: Column, keys: tuple[str, ...]) -> DataFrame:
    return cells.join(which, [*keys, "c"]).select(*keys, F.col("r").alias("student"), value.alias(name)).where(F.col(name).isNotNull())


def kept_sections(students: DataFrame, *keys: str) -> DataFrame:
    """The sheets whose sections are sections: half of the codes or more are shared, and there
    are at most half as many codes as students. Others would be codes of students."""
    keys = keys or KEYS
    sizes = students.groupBy(*keys, "section").agg(F.count("*").alias("_n"))
    codes = sizes.groupBy(*keys).agg(F.count("section").alias("_codes"), F.count_if(F.col("section").isNotNull() & (F.col("_n") > 1)).alias("_shared"), F.sum("_n").alias("_all"))
    return codes.where((F.col("_codes") > 0) & (F.col("_shared") * 2 >= F.col("_codes")) & (F.col("_codes") * 2 <= F.col("_all"))).select(*keys)


def parse(cells: DataFrame, *keys: str) -> Sheets:
    """Sheets as long tables. Students are the rows below the header with an answer.

    A sheet without cells doesn't appear; one without a header row or students is refused:
    its status says why, and it has no other rows.
    """
    keys = keys or KEYS
    k = list(keys)
    asked = questions(cells, *keys)
    left = left_cells(cells, asked, *keys)
    below = cells.join(asked.select(*k, "head", "question", "c"), [*k, "c"]).where(F.col("r") > F.col("head"))
    responses = below.select(*k, F.col("r").alias("student"), "question", F.nullif(cell_text(F.col("value")), F.lit("")).alias("value")).where("value IS NOT NULL")
    v = F.nullif(cell_text(F.col("value")), F.lit(""))
    levels = level_column(left, *keys)
    sections = _column(cells, section_column(left, *keys), "section", v, keys)
    scale = _column(cells, levels, "level", leading_number(v), keys)
    students = responses.select(*k, "student").distinct().join(sections, [*k, "student"], "left").join(scale, [*k, "student"], "left")
    good = kept_sections(students, *keys).withColumn("_good", F.lit(True))
    students = students.join(good, k, "left").withColumn("section", F.when(F.col("_good"), F.col("section"))).drop("_good")
    found = cells.select(*k).distinct().join(asked.select(*k).distinct().withColumn("_head", F.lit(True)), k, "left")
    found = found.join(responses.select(*k).distinct().withColumn("_rows", F.lit(True)), k, "left").join(looks_like_identity(left, *keys), k, "left")
    why = F.when(F.col("_head").isNull(), "no row of question headers").when(F.col("_rows").isNull(), "no student rows beneath the question headers")
    status = found.select(*k, why.isNull().alias("usable"), why.alias("why"), F.col("names").isNotNull().alias("identities"))
    return Sheets(tuple(keys), status, asked.select(*k, "question", "code"), students, responses, levels.select(*k))
