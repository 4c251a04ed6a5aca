"""Shared helpers of the llm operators: table access, scratch tables, hashing."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words, as every word-based operator here splits them.
WORD = r"[^\x20\x09-\x0D]+"

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables, below ``spark.checkpoint.dir``.

    A local temporary folder is used only where that setting is absent and the
    session runs in one process (tests); a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key not in _roots:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        root = f"{base.rstrip('/')}/gradeloom-{uuid.uuid4().hex}"
        _roots[key] = root
        # the file system removes it when the driver's JVM ends, whether the session is stopped or not
        path = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _roots[key]


def _delete(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


#: Folders that the innermost scope() stored; none outside of any.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Frees at its end what saved() stores within it, in this thread: only what nobody else can read.

    Tables that are stored outside, or by another thread or run, stay.
    """
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in own:
            _delete(spark, path)


def saved(df: DataFrame, name: str, held: bool = True) -> DataFrame:
    """Write ``df`` once as a table in the scratch folder and read it back.

    A table that isn't ``held`` outlives the scope it is stored in.

    Cuts the lineage: later stages survive lost executors without recomputation,
    and the optimizer sees the true size of the table.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = (weakref.ref(out), path)
    own = _scope.get()
    if held and own is not None:
        own.append(path)
    return out


#: Stored tables by the DataFrame that reads them.
_stored: dict[int, tuple[weakref.ref, str]] = {}


def forget(df: DataFrame) -> None:
    """Frees a table that saved() returned and that no plan reads any more; others stay."""
    ref, path = _stored.pop(id(df), (None, ""))
    if ref is not None and ref() is df:
        _delete(df.sparkSession, path)


def unsigned_crc32(col: Column) -> Column:
    """CRC-32 of a string's UTF-8 bytes as an unsigned long."""
    return F.crc32(col).cast("long")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
