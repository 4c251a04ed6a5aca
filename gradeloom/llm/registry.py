"""Queries of the llm operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this package that defines it (and ORACLE, if SQL can express it)
MODULES = {
    "op1_quality_rules": "quality",
    "op2_language_id": "langid",
    "op3_secret_scans": "secrets",
    "op4_url_filters": "urls",
    "op5_sentencepiece": "pieces",
    "op6_sharding": "shards",
    "op7_warc": "warc",
    "op8_ngram_jaccard_join": "cpsjoin",
    "op9_best_fit_packing": "packing",
    "op10_media_columns": "mpegts",
    "op11_embedding_whitening": "whitening",
    "op12_source_divergence": "divergence",
    "op13_nearest_neighbours": "vptree",
}


def _module(name: str):  # noqa: ANN202
    return import_module(f"gradeloom.llm.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(_module(name), name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE", None))}
