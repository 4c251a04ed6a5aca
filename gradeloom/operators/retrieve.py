"""Text retrieval: term statistics, BM25, promotion, tiers, recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions.scalars import half_up, terms

#: Fixed values.
K1, B, UNIT_PRIOR = 1.5, 0.6, 1.30


def term_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, tf, doc_terms)."""
    own = docs.select(key, terms(F.col(text)).alias("_t")).withColumn("doc_terms", F.size("_t"))
    return own.select(key, "doc_terms", F.explode("_t").alias("term")).groupBy(key, "doc_terms", "term").agg(F.count("*").alias("tf"))


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def collection(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n_docs, mean_terms): one row; documents without terms count."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(terms(F.col(text)))).alias("mean_terms"))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", query: str = "query_id") -> DataFrame:
    """(query, doc, score) of the pairs that share a term; a query's repeats of a term don't count.

    The log is of (N + 1) / (df + 1).
    """
    counts = term_counts(docs, doc)
    asked = queries.select(query, F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    # statistics only of terms that are asked for
    wanted = counts.join(asked.select("term").distinct(), "term", "left_semi")
    df = document_frequency(wanted)
    whole = F.broadcast(collection(docs))  # one row
    dl = F.col("doc_terms") / F.greatest(F.col("mean_terms"), F.lit(1e-9))
    idf = F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0))
    weighted = wanted.join(df, "term").join(whole, how="cross").withColumn("w", idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * dl)))
    return asked.join(weighted, "term").groupBy(query, doc).agg(F.sum("w").alias("score"))


def promoted_rank(scores: DataFrame, query: str, doc: str, promoted: Column | None = None, prior: Column | None = None) -> DataFrame:
    """Adds rank: promoted ones first, then by score (times UNIT_PRIOR where ``prior``), ties by id."""
    s = F.col("score") * F.when(prior, UNIT_PRIOR).otherwise(1.0) if prior is not None else F.col("score")
    first = F.when(promoted, 1).otherwise(0) if promoted is not None else F.lit(0)
    w = Window.partitionBy(query).orderBy(first.desc(), half_up(s, 6).desc(), F.col(doc))
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("score", s)


def top_k(ranked: DataFrame, k: int = 8) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def second_tier(pool: DataFrame, tier1: DataFrame, *keys: str) -> DataFrame:
    """The pool without what the first tier has."""
    return pool.join(tier1, list(keys), "left_anti")


def recall_at(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 8, 12, 20), query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(k, hits, relevant, recall): share of the relevant pairs ranked k or better."""
    met = relevant.join(ranked.select(query, doc, "rank"), [query, doc], "left")
    one = met.agg(F.count("*").alias("relevant"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    pairs = ", ".join(f"{k}, h{k}" for k in ks)
    return one.select("relevant", F.expr(f"stack({len(ks)}, {pairs}) as (k, hits)")).withColumn("recall", half_up(F.col("hits") / F.col("relevant")))
