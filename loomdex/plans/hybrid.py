"""Search plans: lexical recall, metadata filter, vector re-rank, context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import basename
from loomdex.operators.bm25 import candidate_budget, rank_texts
from loomdex.operators.filters import metadata_filter
from loomdex.operators.vector import rank_allowed


def candidates(
    corpus: DataFrame,
    query: str,
    k: int,
    filters: Mapping[str, object] | None = None,
    *,
    filter_mode: str = "post",
    text_col: str = "content",
    id_col: str = "doc_id",
    keep: Sequence[str] = (),
    mode: str = "and",
    budget: int | None = None,
) -> DataFrame:
    """BM25 candidates after metadata filters.

    ``post`` filters the top-n (rows the filter drops are not refilled);
    ``pre`` filters first, so the top-n is taken among matching rows. Corpus
    statistics always come from the whole corpus.
    """
    limit = candidate_budget(k, budget)
    test = metadata_filter(filters)
    meta = [c for c in ("department", "date") if c in corpus.columns and filters]
    columns = list(dict.fromkeys([*keep, *meta]))
    if filter_mode == "post" or not filters:
        top = rank_texts(corpus, query, limit, id_col=id_col, text_col=text_col, keep=columns, mode=mode)
        return top.where(test) if filters else top
    every = rank_texts(corpus, query, None, id_col=id_col, text_col=text_col, keep=columns, mode=mode)
    return every.where(test).orderBy(F.desc("bm25"), F.asc(id_col)).limit(limit)


def hybrid_search(
    corpus: DataFrame,
    vectors: DataFrame,
    query: str,
    query_vector: Column,
    k: int,
    filters: Mapping[str, object] | None = None,
    *,
    filter_mode: str = "post",
    text_col: str = "content",
    mode: str = "and",
    budget: int | None = None,
) -> DataFrame:
    """``doc_id, score``: top ``k`` by cosine among the BM25 candidates (``budget`` of them) that have a vector."""
    found = candidates(corpus, query, k, filters, filter_mode=filter_mode, text_col=text_col, mode=mode, budget=budget)
    return rank_allowed(vectors, found, query_vector, k)


def with_context(hits: DataFrame, chunks: DataFrame, *, collapse_parent: bool = False) -> DataFrame:
    """Hits (``doc_id, score``, at most k rows) -> nine-field results with the parent section.

    L1 hits and L2 hits without a parent have an empty context. With
    ``collapse_parent`` only the best hit of each section is kept.
    """
    own = chunks.join(F.broadcast(hits), "doc_id").select(
        "doc_id", "score", "filepath", "chunk_type", "content", "title", "parent_id"
    )
    # own has at most k rows, and so have the parents it asks for: both joins build the small side, chunks stay in place
    asked = own.select(F.col("parent_id").alias("__pid")).distinct()
    parent = chunks.select("doc_id", "content", "title").join(F.broadcast(asked), F.col("doc_id") == F.col("__pid"))
    parent = parent.select("__pid", F.col("content").alias("__pcontent"), F.col("title").alias("__ptitle"))
    is_child = F.col("chunk_type") == "L2"
    joined = own.join(F.broadcast(parent), F.col("parent_id") == F.col("__pid"), "left")
    if collapse_parent:
        section = F.coalesce(F.col("parent_id"), F.col("doc_id"))
        best = joined.groupBy(section.alias("__section")).agg(
            F.max_by(F.struct(*joined.columns), F.struct(F.col("score"), -F.col("doc_id"))).alias("r")
        )
        joined = best.select("r.*")
    return joined.select(
        F.col("doc_id").alias("id"),
        "score",
        F.col("filepath").alias("file_path"),
        basename(F.col("filepath")).alias("file_name"),
        "chunk_type",
        F.col("content").alias("matched_content"),
        F.col("title").alias("section_title"),
        F.when(is_child, F.coalesce("__pcontent", F.lit(""))).otherwise(F.lit("")).alias("parent_context"),
        F.when(is_child, F.coalesce("__ptitle", F.lit(""))).otherwise(F.lit("")).alias("parent_title"),
    ).orderBy(F.desc("score"), F.asc("id"))


def parent_chunks(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id`` -> its L1 chunk: itself for an L1, the parent for an L2 (NULL fields without one)."""
    child = chunks.join(ids.select("doc_id"), "doc_id").select(
        "doc_id", F.when(F.col("chunk_type") == "L1", F.col("doc_id")).otherwise(F.col("parent_id")).alias("__pid")
    )
    parent = chunks.select(
        F.col("doc_id").alias("parent_doc_id"), F.col("title").alias("parent_title"), F.col("content").alias("parent_content")
    )
    return child.join(parent, F.col("__pid") == F.col("parent_doc_id"), "left").drop("__pid")
