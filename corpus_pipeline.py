"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that the one before it kept, as a stored table. So run()
frees what a stage stored for itself as soon as the stage's result is written, and that
result as soon as the next one is; tables of other queries and runs are never touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm import cpsjoin, langid, packing, quality, secrets
from gradeloom.llm.common import forget, saved, scope, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the adaptive fences stay, repeated ones each.

    Null and empty texts go (no words); very long texts are measured whole; a value that
    ties with a fence stays. Null languages and sources are groups of their own. An empty
    table stays empty; columns may have any names.
    """
    return quality.filter_quality(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay, repeated ones each.

    Null, empty and letterless texts go, and so do texts that tie between two languages;
    very long texts are parsed whole. An empty table stays empty; columns may have any names.
    """
    return langid.filter_language(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that with the least doc_id.

    Of repeated rows one stays. Null, empty and blank texts have no shingles and all stay;
    a null doc_id stays only where its class has no other; very long texts are compared
    whole. An empty table stays empty; columns may have any names.
    """
    return cpsjoin.one_per_class(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays, repeated ones each.

    A null text stays null, an empty one empty; very long texts are scanned whole; where
    spans overlap, the first one's kind is put. An empty table stays empty; columns may
    have any names.
    """
    return secrets.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset; repeated documents are packed each.

    A null or empty text is the end id alone; very long texts are cut into as many pieces
    as they need; pieces of one length are numbered by a hash. An empty table gives an empty
    result; other columns are not used, whatever their names.
    """
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, sketched similarity search and tokenizers are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the pieces of the packed sequences."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):
            before, docs = docs, saved(stage(spark, docs, sf_dir), name, held=False)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
