"""Vector arithmetic on ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.arrays import let


def dot(a: Column, b: Column) -> Column:
    """Dot product folded in double precision; for the few rows left after an allow-list."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """Unit vector; the zero vector stays as it is."""
    return let(
        norm(v),
        lambda n: F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v),
    )


def best_cosines(query: list[float], k: int, digits: int):
    """For ``mapInArrow`` over ``id, vector``: each batch's best ``k`` by rounded cosine, then id.

    One matrix product per batch, and only ``k`` rows of it go on. Vectors of another length than the query, and null
    ones, have no score.
    """
    q = np.asarray(query, dtype=np.float64)
    q_norm = float(np.linalg.norm(q))
    unit = 10.0**digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(1).value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            usable = batch.filter(pa.array(lengths == len(q)))
            matrix = usable.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            scale = np.sqrt(np.einsum("ij,ij->i", matrix, matrix)) * q_norm
            raw = np.divide(matrix @ q, scale, out=np.zeros(len(matrix)), where=scale > 0)
            score = np.copysign(np.floor(np.abs(raw) * unit + 0.5) / unit, raw)  # halves away from zero, as Spark rounds
            ids = usable.column(0).to_numpy(zero_copy_only=False)
            best = np.lexsort((ids, -score))[:k]
            best = best[~np.isnan(score[best])]
            yield pa.RecordBatch.from_arrays([usable.column(0).take(pa.array(best)), pa.array(score[best])], ["id", "score"])

    return run


def quantize(v: Column, bits: int) -> Column:
    """Scalar quantisation to ``2**bits`` levels over the vector's own range (lossy)."""
    if bits not in (2, 3, 4):
        raise ValueError(f"bit width must be 2, 3 or 4, got {bits}")
    lo = F.array_min(v).cast("double")
    step = (F.array_max(v).cast("double") - lo) / F.lit(float(2**bits - 1))

    def encode(grid: Column) -> Column:
        return F.struct(
            grid["low"].alias("low"),
            grid["step"].alias("step"),
            F.transform(
                v,
                lambda x: F.when(grid["step"] > 0, F.round((x.cast("double") - grid["low"]) / grid["step"]))
                .otherwise(F.lit(0.0))
                .cast("tinyint"),
            ).alias("codes"),
        )

    return let(F.struct(lo.alias("low"), step.alias("step")), encode)


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: (q["low"] + c * q["step"]).cast("float"))


def compression_ratio(bits: int) -> str:
    return f"{32 / bits:.1f}x"
