"""File registry as DataFrame transformations (each returns the next registry state)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions import identity
from loomdex.schemas import REGISTRY

_COLUMNS = REGISTRY.fieldNames()


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``file_path, change`` (added, modified, deleted); unchanged files give no row."""
    before = previous.select("file_path", F.col("content_hash").alias("__old"))
    after = current.select("file_path", F.col("content_hash").alias("__new"))
    change = (
        F.when(F.col("__old").isNull(), F.lit("added"))
        .when(F.col("__new").isNull(), F.lit("deleted"))
        .when(F.col("__old") != F.col("__new"), F.lit("modified"))
    )
    return before.join(after, "file_path", "full_outer").select("file_path", change.alias("change")).where("change IS NOT NULL")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("files"))


def upsert(registry: DataFrame, scan: DataFrame) -> DataFrame:
    """Register scanned files: new rows are pending; known rows take the new hash and
    become pending again, keeping ``file_id`` and ``chunk_count``; other rows stay."""
    old = registry.select("file_path", *[F.col(c).alias(f"__o_{c}") for c in _COLUMNS if c != "file_path"])
    new = scan.select("file_path", F.col("content_hash").alias("__n_hash"))
    seen = F.col("__n_hash").isNotNull()
    return old.join(new, "file_path", "full_outer").select(
        "file_path",
        F.coalesce(F.col("__o_file_id"), identity.file_id(F.col("file_path"))).alias("file_id"),
        F.coalesce(F.col("__n_hash"), F.col("__o_content_hash")).alias("content_hash"),
        F.coalesce(F.col("__o_chunk_count"), F.lit(0)).alias("chunk_count"),
        F.when(seen, F.lit("pending")).otherwise(F.col("__o_status")).alias("status"),
        F.when(~seen, F.col("__o_indexed_at")).alias("indexed_at"),
        F.when(~seen, F.col("__o_error_message")).alias("error_message"),
    )


def mark_indexed(registry: DataFrame, done: DataFrame, at: Column) -> DataFrame:
    """``done``: ``file_path, n_chunks`` of files that are now indexed."""
    hit = done.select("file_path", F.col("n_chunks").cast("int").alias("__n"))
    ok = F.col("__n").isNotNull()
    return registry.join(hit, "file_path", "left").select(
        "file_path",
        "file_id",
        "content_hash",
        F.coalesce(F.col("__n"), F.col("chunk_count")).alias("chunk_count"),
        F.when(ok, F.lit("indexed")).otherwise(F.col("status")).alias("status"),
        F.when(ok, at).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.when(~ok, F.col("error_message")).alias("error_message"),
    )


def mark_error(registry: DataFrame, failed: DataFrame, at: Column) -> DataFrame:
    """``failed``: ``file_path, error`` and, where the file's chunk count changes, ``n_chunks``."""
    count = F.col("n_chunks") if "n_chunks" in failed.columns else F.lit(None)
    hit = failed.select("file_path", F.col("error").alias("__e"), count.cast("int").alias("__n"))
    bad = F.col("__e").isNotNull()
    return registry.join(hit, "file_path", "left").select(
        "file_path",
        "file_id",
        "content_hash",
        F.coalesce(F.col("__n"), F.col("chunk_count")).alias("chunk_count"),
        F.when(bad, F.lit("error")).otherwise(F.col("status")).alias("status"),
        F.when(bad, at).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.coalesce(F.col("__e"), F.col("error_message")).alias("error_message"),
    )


def remove(registry: DataFrame, paths: DataFrame) -> DataFrame:
    return registry.join(paths.select("file_path"), "file_path", "left_anti")


def deleted_files(registry: DataFrame, scan: DataFrame) -> DataFrame:
    """Registered paths the scan no longer sees, sorted."""
    return registry.select("file_path").join(scan.select("file_path"), "file_path", "left_anti").orderBy("file_path")


def keep_scanned(registry: DataFrame, scan: DataFrame) -> DataFrame:
    return registry.join(scan.select("file_path"), "file_path", "left_semi")


def stats(registry: DataFrame) -> DataFrame:
    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return registry.agg(
        F.count("*").alias("total_files"),
        having("indexed").alias("indexed_count"),
        having("pending").alias("pending_count"),
        having("error").alias("error_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "indexed", F.col("chunk_count"))), F.lit(0))
        .cast("bigint")
        .alias("total_chunks"),
    )


def listing(registry: DataFrame, status: str | None = None) -> DataFrame:
    rows = registry if status is None else registry.where(F.col("status") == status)
    return rows.orderBy("file_path")


def pending(registry: DataFrame) -> DataFrame:
    return listing(registry, "pending")


def errors(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("status") == "error").orderBy(F.desc("indexed_at"), "file_path")
