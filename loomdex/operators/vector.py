"""Vector ranking, unrestricted or inside an allow-list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.vectors import best_cosines, cosine

SCORE_DIGITS = 6


def top_k(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    return scored.orderBy(F.desc("score"), F.asc(id_col)).limit(k)


def rank_all(vectors: DataFrame, query: list[float], k: int, *, id_col: str = "doc_id", vector_col: str = "embedding") -> DataFrame:
    """Exact top ``k`` over every vector: Arrow batches, one matrix product each, no shuffle but the top-k."""
    kind = vectors.schema[id_col].dataType.simpleString()
    scored = vectors.select(id_col, vector_col).mapInArrow(best_cosines(query, k, SCORE_DIGITS), f"id {kind}, score double")
    return top_k(scored.withColumnRenamed("id", id_col), k, id_col)


def rank_allowed(
    vectors: DataFrame,
    allowed: DataFrame,
    query: Column,
    k: int,
    *,
    id_col: str = "doc_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Top ``k`` among the ids of ``allowed``; ids without a vector drop out.

    The semi join comes before the scoring projection, so only allowed vectors are scored. How it runs is left to the
    optimizer, which knows the size of the list once it has been computed.
    """
    ids = allowed.select(id_col)
    kept = vectors.select(id_col, vector_col).join(ids, id_col, "left_semi").withColumn("__query", query)
    score = F.round(cosine(F.col(vector_col), F.col("__query")), SCORE_DIGITS)
    # a vector of another length, or with a null component, has no score and takes no place
    return top_k(kept.select(id_col, score.alias("score")).where("score IS NOT NULL"), k, id_col)
