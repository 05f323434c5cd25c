"""Outline algebra on row tables: one row per heading, one document may be huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.operators.prefix import BLOCK_ROWS, Running, running


def _checked(level: str, max_level: int) -> Column:
    """The level; one outside ``1..max_level`` ends the job instead of being passed over."""
    n = F.col(level)
    told = F.concat(F.lit(f"heading level outside 1..{max_level}: "), n.cast("string"))
    return F.when(n.between(1, max_level) | n.isNull(), n).otherwise(F.raise_error(told).cast("int"))


def parents(df: DataFrame, key: str, pos: str, level: str, max_level: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``parent_pos``: nearest previous position with a lower level.

    The candidates are the latest position of every level, so the work is one
    running maximum per level instead of a self join over the document.
    """
    seen = {f"__l{n}": Running(F.when(_checked(level, max_level) == n, F.col(pos)), "max") for n in range(1, max_level + 1)}
    nearest = F.greatest(
        F.lit(None).cast("bigint"),
        *[F.when(F.col(level) > n, F.col(f"__l{n}")) for n in range(1, max_level + 1)],
    )
    return running(df, [key], pos, seen, block_rows=block_rows).select(*df.columns, nearest.alias("parent_pos"))


def next_same_or_higher(
    df: DataFrame, key: str, pos: str, level: str, max_level: int, *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``next_pos``: next position with the same or a lower level number."""
    seen = {f"__l{n}": Running(F.when(_checked(level, max_level) == n, F.col(pos)), "min") for n in range(1, max_level + 1)}
    nearest = F.least(
        F.lit(None).cast("bigint"),
        *[F.when(F.col(level) >= n, F.col(f"__l{n}")) for n in range(1, max_level + 1)],
    )
    return running(df, [key], pos, seen, reverse=True, block_rows=block_rows).select(
        *df.columns, nearest.alias("next_pos")
    )


def enclosing_sections(
    df: DataFrame, key: str, pos: str, level: str, max_level: int, *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Interval join of every row with the sections it lies in: one output row per enclosing section.

    A row lies in the latest level-n heading before it unless a heading of a
    lower level came in between. At most ``max_level`` rows come out per input
    row, without comparing rows with each other. Heading rows have a level,
    body rows NULL; a heading belongs to its ancestors.
    """
    seen = {f"__l{n}": Running(F.when(_checked(level, max_level) == n, F.col(pos)), "max") for n in range(1, max_level + 1)}
    scanned = running(df, [key], pos, seen, block_rows=block_rows)
    found = []
    for n in range(1, max_level + 1):
        own = F.col(f"__l{n}")
        open_ = own.isNotNull() & (F.col(level).isNull() | (F.col(level) > n))
        for lower in range(1, n):
            open_ = open_ & (own > F.coalesce(F.col(f"__l{lower}"), F.lit(-1)))
        found.append(F.when(open_, own))
    return scanned.select(*df.columns, F.explode(F.array_compact(F.array(*found))).alias("section_pos"))
