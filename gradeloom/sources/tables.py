"""Stored tables: JSON and CSV readers with stable shapes, manifests, source targets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _kind(ddl: str) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in _fields(ddl)])


def _fields(ddl: str) -> list[tuple[str, T.DataType]]:
    kinds = {"int": T.IntegerType(), "string": T.StringType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "ints": T.ArrayType(T.IntegerType())}
    return [(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))]


ITEM_MAP = _kind(
    "item int, session int, type string, key string, credits int, standard string, standardsEra string, secondaryStandards strings, "
    "domainLabel string, subscore string, pValue double, avgPointsEarned double"
)
PACING = _kind("grade int, unit int, title string, days ints, midUnitAssessment boolean, optionalLessons ints, startWeek int")


def read_json(spark: SparkSession, path: str, schema: T.StructType, optional: bool = False) -> DataFrame:
    """Documents of a known schema; a missing optional table is empty with the same shape."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if optional and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


#: A published payload's items and tests, as far as reports read them; other fields are passed over.
PAYLOAD = T.StructType([
    T.StructField("items", T.ArrayType(_kind(
        "id string, testId string, grade int, year int, item int, session int, type string, key string, credits int, standard string, domain string, domainLabel string, secondary strings, "
        "pValue double, avgPointsEarned double, postTest boolean, course string, unit int, lesson int, lessonTitle string, alignmentBasis string, transcribed boolean, sourceUrl string"
    ))),
    T.StructField("tests", T.ArrayType(_kind("testId string, grade int, year int, label string"))),
])


def payload_table(payload: DataFrame, name: str) -> DataFrame:
    """A table of a payload document as rows."""
    return payload.select(F.explode(name).alias("_r")).select("_r.*")


def embedded_payload(pages: DataFrame, schema: T.StructType = PAYLOAD, html: str = "html", element: str = "data") -> DataFrame:
    """The payload that a page carries in its script element of JSON; pages without one have no row."""
    found = F.regexp_extract(F.col(html), rf'(?s)<script[^>]*id="{element}"[^>]*>(.*?)</script>', 1)
    raw = F.replace(found, F.lit("<\\/"), F.lit("</"))
    return pages.where(found != "").select(F.from_json(raw, schema).alias("_p")).select("_p.*")


def read_documents(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Many JSON documents as one table, with the file that each comes from."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("source_file", F.input_file_name())


def read_csv(spark: SparkSession, path: str, **roles: str) -> DataFrame:
    """A CSV file with a header; role=part renames the one column whose name contains part."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    for role, part in roles.items():
        hits = [c for c in df.columns if part.lower() in c.lower()]
        if len(hits) != 1:
            raise ValueError(f"{len(hits)} columns contain {part!r}")
        df = df.withColumnRenamed(hits[0], role)
    return df


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_changes(stored: DataFrame, now: DataFrame) -> DataFrame:
    """(path, status): added, removed or changed files."""
    met = stored.select("path", F.col("sha256").alias("_old")).join(now.select("path", F.col("sha256").alias("_new")), "path", "full_outer")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return met.select("path", status.alias("status")).where("status IS NOT NULL")


def wanted_sources(spark: SparkSession, kinds: list[str], grades: list[int], years: list[int]) -> DataFrame:
    """Every (kind, grade, year); a small product of literal lists."""
    one = spark.range(1)
    for name, values in (("kind", kinds), ("grade", grades), ("year", years)):
        one = one.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return one.drop("id")


def by_year(year: Column, since: int, new: str, old: str, *args: Column) -> Column:
    """A format string chosen by a year, filled with the arguments."""
    return F.when(year >= since, F.format_string(new, *args)).otherwise(F.format_string(old, *args))


def page_link(base: Column, page: Column) -> Column:
    """The base address with a page anchor; without a page, the base; null without a base."""
    return F.when(page.isNotNull(), F.concat(base, F.lit("#page="), page.cast("string"))).otherwise(base)


def words(df: DataFrame) -> DataFrame:
    """Positioned words (page, x0, y0, x1, y1, text) with the centre x and rounded y of each."""
    return df.withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": F.round("y0", 1)})


def in_region(df: DataFrame, x: tuple[float, float] | None = None, y: tuple[float, float] | None = None) -> DataFrame:
    """Words or paths inside a band of the page, ends included."""
    for name, span in (("x", x), ("y", y)):
        if span:
            df = df.where(F.col(name).between(*span))
    return df


def table_pages(df: DataFrame, title: str, code: str, least: int = 3) -> DataFrame:
    """(page): the first run of neighbouring pages with the title or ``least`` codes."""
    from gradeloom.operators.layout import islands

    per = df.groupBy("page").agg(F.bool_or(F.contains("text", F.lit(title))).alias("_t"), F.count_if(F.col("text").rlike(code)).alias("_n"))
    hits = islands(per.where(F.col("_t") | (F.col("_n") >= least)), "page")
    return hits.where("island = 0").select("page")
