"""Keyed running aggregates that survive one huge key.

A window partitioned by the key alone puts the whole key into one task. Here
every key is cut into blocks of consecutive positions: the window runs inside a
block, each block is also reduced to one summary row, and the running value of
the summaries (one row per block) is joined back as the carry-in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536

_AGG = {"max": F.max, "min": F.min, "sum": F.sum}


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` in max, min, sum over ``value`` (NULLs are skipped)."""

    value: Column
    how: str


def _merge(how: str, a: Column, b: Column) -> Column:
    if how == "max":
        return F.greatest(a, b)
    if how == "min":
        return F.least(a, b)
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
        F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    )


def running(
    df: DataFrame,
    keys: list[str],
    pos: str,
    values: dict[str, Running],
    *,
    reverse: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add one column per entry of ``values``: the aggregate over the rows before this one.

    ``pos`` is an integer position, unique per key; ``reverse`` looks at the
    rows after this one instead. Positions should be roughly dense, so that a
    block of ``block_rows`` positions holds at most that many rows. Keys are
    ids and must not be NULL.
    """
    blk = "__block"
    blocked = df.withColumn(blk, F.floor(F.col(pos) / F.lit(block_rows)))
    names = list(values)

    summaries = blocked.groupBy(*keys, blk).agg(*[_AGG[v.how](v.value).alias(n) for n, v in values.items()])
    order = F.col(blk).desc() if reverse else F.col(blk).asc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carries = summaries.select(
        *keys, blk, *[_AGG[values[n].how](n).over(before).alias(f"__carry_{n}") for n in names]
    )

    local_order = F.col(pos).desc() if reverse else F.col(pos).asc()
    local = Window.partitionBy(*keys, blk).orderBy(local_order).rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.select("*", *[_AGG[v.how](v.value).over(local).alias(f"__local_{n}") for n, v in values.items()])

    # same keys as the local window, so the rows are not shuffled again
    return inside.join(carries, [*keys, blk], "left").select(
        *df.columns,
        *[
            _merge(values[n].how, F.col(f"__local_{n}"), F.col(f"__carry_{n}")).alias(n)
            for n in names
        ],
    )
