"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from loomdex.sources.tables import materialize, read_table, shared_folder

__all__ = ["ASCII_SPACE", "batch_rows", "fresh_name", "grouped", "materialize", "parts", "read_table", "shared_folder"]

#: The white space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` clashes with it (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside: a batch of whole texts is large at the default."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(values: pa.Array, size: int) -> Iterator[pa.Array]:
    """Runs of texts, binaries or lists of 32-bit numbers of about ``size`` bytes, so that what is made of a run stays small."""
    unit, lengths = (4, pc.list_value_length(values)) if pa.types.is_list(values.type) else (1, pc.binary_length(values))
    total = np.cumsum(unit * lengths.fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(values):
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + size)) + 1
        yield values.slice(at, end - at)
        at = end


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches whose rows are sorted by ``keys``; one group in memory at a time."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns))
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            if held and held_key != rows[start]:
                yield pa.concat_tables(held)
                held = []
            held_key = rows[start]
            held.append(table.slice(start, i - start))
            start = i
    if held:
        yield pa.concat_tables(held)
