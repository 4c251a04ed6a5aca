"""Writing tables: upserts with backups, references, payloads, manifests, reports as pages."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.operators import quality


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def upsert(stored: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """Reviewed rows replace stored ones of the same key; the others stay."""
    rest = stored.join(reviewed.select(key).distinct(), key, "left_anti")
    return rest.unionByName(reviewed, allowMissingColumns=True)


def upsert_table(path: str, reviewed: DataFrame, key: str, stamp: str) -> str:
    """Upserts into a stored table; what it held stays beside it, named by ``stamp``. Returns that path.

    The new table is written first and only then takes the old one's place, so a failure
    on the way leaves the stored table as it was.
    """
    spark = reviewed.sparkSession
    backup, new = f"{path}-{stamp}.bak", f"{path}-{stamp}.new"
    upsert(spark.read.parquet(path), reviewed, key).write.mode("errorifexists").parquet(new)
    fs, old = _files(spark, path)
    if not fs.rename(old, _files(spark, backup)[1]) or not fs.rename(_files(spark, new)[1], old):
        raise OSError(f"{path} could not be replaced; its rows are in {path} or {backup}")
    return backup


def write_table(df: DataFrame, path: str, generated: str) -> None:
    """Overwrites a stored table, stamped with the date it was generated."""
    df.withColumn("generated", F.lit(generated)).write.mode("overwrite").parquet(path)


def write_manifest(manifest: DataFrame, path: str, **facts: Column) -> None:
    """Writes (path, bytes, sha256) with further facts of each file, such as its address."""
    manifest.withColumns(facts).write.mode("overwrite").json(path) if facts else manifest.write.mode("overwrite").json(path)


def missing_references(references: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return references.select(key).distinct().join(present, key, "left_anti")


def copied_references(references: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Present rows that are referenced; an error, when read, if a reference is missing."""
    met = references.select(key).distinct().join(present.withColumn("_here", F.lit(True)), key, "left")
    return met.where(F.when(F.col("_here"), True).otherwise(F.raise_error(F.concat(F.lit("missing: "), F.col(key).cast("string"))).cast("boolean"))).drop("_here")


def payload(tables: dict[str, DataFrame]) -> dict[str, list[str]]:
    """Small tables as JSON lines by name, for a published document.

    Only for tables of a published report's size; large ones are written as tables.
    """
    return {name: [r[0] for r in df.select(F.to_json(F.struct("*"))).collect()] for name, df in tables.items()}


def write_payload(tables: dict[str, DataFrame], path: str, meta: dict | None = None, exempt: tuple[str, ...] = ()) -> None:
    """One JSON document of tables of a report's size, through Spark's file systems.

    Refused, with nothing written, if a table has a banned field, could identify somebody, or
    holds a long text in a field that may not.
    """
    for name, df in tables.items():
        quality.assert_private(df, exempt, label=name, cap=quality.LONGEST_TEXT)
    doc = {"meta": meta or {}} | {name: [json.loads(x) for x in rows] for name, rows in payload(tables).items()}
    spark = next(iter(tables.values())).sparkSession
    fs, p = _files(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(doc, ensure_ascii=False).encode()))
    finally:
        out.close()


def report_page(title: str, sections: dict[str, DataFrame], most: int = 500) -> str:
    """Sections of a report's size as one page of tables; texts are escaped, nulls are blank.

    A section with more than ``most`` rows is an error: it isn't a report.
    """
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        cell = lambda v: "" if v is None else html.escape(str(v))
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "\n".join(parts)
