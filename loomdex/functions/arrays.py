"""Higher-order helpers over ARRAY columns.

All of them stay inside one row, so they never shuffle: work on a file's lines,
sections or headings happens where the file already is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCAN_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan_left(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column, Column], tuple[Column, Column]],
    emit_type: str,
    block: int = SCAN_BLOCK,
) -> Column:
    """Running fold over ``items`` that keeps one emitted value per item.

    ``step(state, item, index)`` returns ``(new_state, emitted)``. A plain
    ``aggregate`` that appends to its output copies that output on every step,
    which is quadratic; emitting into short blocks and gluing the blocks at the
    end keeps the copying near-linear for arrays of millions of items.
    """
    no_values = F.array().cast(f"array<{emit_type}>")
    no_blocks = F.array().cast(f"array<array<{emit_type}>>")

    def run(arr: Column) -> Column:
        n = F.size(arr)

        def one_block(outer: Column, b: Column) -> Column:
            first = b * F.lit(block)
            last = F.least(n, first + F.lit(block)) - F.lit(1)

            def one_item(inner: Column, i: Column) -> Column:
                state, value = step(inner["state"], F.get(arr, i), i)
                return F.struct(
                    state.alias("state"),
                    F.concat(inner["out"], F.array(value.cast(emit_type))).alias("out"),
                )

            start = F.struct(outer["state"].alias("state"), no_values.alias("out"))
            return let(
                F.aggregate(F.sequence(first, last), start, one_item),
                lambda done: F.struct(
                    done["state"].alias("state"),
                    F.concat(outer["out"], F.array(done["out"])).alias("out"),
                ),
            )

        blocks = F.sequence(F.lit(0), F.floor((n - F.lit(1)) / F.lit(block)).cast("int"))
        folded = F.aggregate(
            blocks,
            F.struct(zero.alias("state"), no_blocks.alias("out")),
            one_block,
            lambda done: F.flatten(done["out"]),
        )
        return F.when(n > 0, folded).otherwise(no_values)

    return let(items, run)
