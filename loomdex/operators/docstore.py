"""Document store as DataFrame transformations: upsert, delete, point reads, mapping, consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(store: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Insert or replace by key."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def delete(store: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def by_filepath(store: DataFrame, path: str) -> DataFrame:
    return store.where(F.col("filepath") == path).orderBy("doc_id")


def chunk_mapping(chunks: DataFrame) -> DataFrame:
    """``file_id, doc_id`` pairs; a projection of the chunk table, stored nowhere else."""
    return chunks.select("file_id", "doc_id")


def max_chunk_id(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("bigint").alias("max_id"))


def metadata_to_json(metadata, datetime_keys=()):
    """Map column -> JSON text, NULL for an empty map."""
    return F.when(F.size(metadata) > 0, F.to_json(metadata))


def metadata_from_json(text):
    """JSON text -> map of strings; NULL or invalid JSON gives an empty map."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def missing_ids(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    return left.select(key).join(right.select(key), key, "left_anti")


def consistency(store: DataFrame, bm25: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of id-set differences between the three layers plus the verdict.

    One grouped pass over the three id columns; nothing is compared pairwise.
    """

    def tagged(df: DataFrame, layer: int) -> DataFrame:
        return df.select(F.col(key), F.lit(layer).alias("__layer"))

    per_id = (
        tagged(store, 1)
        .unionByName(tagged(bm25, 2))
        .unionByName(tagged(vectors, 4))
        .groupBy(key)
        .agg(F.bit_or("__layer").alias("__in"))
    )
    has = F.col("__in").bitwiseAND
    counts = per_id.agg(
        F.count_if((has(1) > 0) & (has(2) == 0)).alias("missing_in_bm25"),
        F.count_if((has(2) > 0) & (has(1) == 0)).alias("missing_in_store"),
        F.count_if((has(1) > 0) & (has(4) == 0)).alias("missing_in_vectors"),
        F.count_if((has(4) > 0) & (has(1) == 0)).alias("extra_vectors"),
    )
    total = (
        F.col("missing_in_bm25") + F.col("missing_in_store") + F.col("missing_in_vectors") + F.col("extra_vectors")
    )
    return counts.withColumn("consistent", total == 0)
