"""Tables that are computed once, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}
#: Stored tables by the DataFrame that reads them; folders that the innermost recorded() has seen.
_stored: dict[int, tuple[weakref.ref, str]] = {}
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def _path(spark: SparkSession, path: str) -> tuple:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def root(spark: SparkSession) -> str:
    """The folder of stored tables, below ``spark.checkpoint.dir``; it goes when the driver's JVM ends.

    A local temporary folder is used only where that setting is absent and the session runs
    in one process (tests); a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _roots:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
        _roots[sc.applicationId] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        fs, there = _path(spark, _roots[sc.applicationId])
        fs.mkdirs(there)
        fs.deleteOnExit(there)
    return _roots[sc.applicationId]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and read from a table from then on.

    Lineage ends there, columns that aren't read are pruned, and the optimizer knows the size.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = (weakref.ref(out), path)
    own = _scope.get()
    if own is not None:
        own.append(path)
    return out


def forget(df: DataFrame) -> None:
    """Frees a table that checkpointed() returned and that no plan reads any more; others stay."""
    ref, path = _stored.pop(id(df), (None, ""))
    if ref is not None and ref() is df:
        fs, there = _path(df.sparkSession, path)
        fs.delete(there, True)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that checkpointed() stores within, in this thread, for free()."""
    own: list[str] = []
    token = _scope.set(own)
    try:
        yield own
    finally:
        _scope.reset(token)


def free(spark: SparkSession, paths: list[str]) -> None:
    """Frees tables by their folders; what reads them can't be read any more."""
    for path in paths:
        fs, there = _path(spark, path)
        fs.delete(there, True)
    paths.clear()
