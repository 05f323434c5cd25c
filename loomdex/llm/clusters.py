"""Exact k-means on integer vectors, with distances avoided by Ptolemaic pivots.

Vectors are integers, so distances, sums and centroids are exact. For fixed pivots p and s, Ptolemy's inequality bounds
the distance of a vector u and a centroid c from below by ``|d(u, p) d(c, s) - d(u, s) d(c, p)| / d(p, s)``. A vector's distances to the
pivots are computed once and stored with it; those of a centroid once per round. Per round and vector:

1. the bounds of all centroids from the stored distances, by the pairs of pivots that bound each centroid best on a sample;
2. the exact distance of the centroid with the smallest bound;
3. the exact distances of the centroids whose bound does not exceed it. The others are farther and are never computed.

Bounds are floating-point numbers: they are lowered by more than their rounding errors can be, and the threshold is raised, so that no
centroid is lost, ties included; the survivors' distances are integers, which decide.

A round is one pass over the stored vectors. Tasks add up their own vectors per centroid, so what is shuffled is a row per
task and centroid whatever the sizes of the clusters; k centroids are all that the driver holds.

Cases: vectors that are null, have another number of components than ``width``, or hold null or non-finite ones take no part; rows that
repeat an id count each; a row without an id is clustered but starts no centroid; of ids that share a hash the smaller vector starts
first; with fewer than k vectors each starts a centroid; an empty table gives no rows; a component beyond ``LARGEST`` ends in an
error, as its distances may not fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import materialize

PIVOTS = 8
#: Pairs of pivots that bound a centroid.
PAIRS = 4
#: Vectors whose bounds choose the pairs; any choice gives the same results.
SAMPLE = 1024
#: Relative slack of bounds, and of thresholds: many times the rounding errors of their few operations.
SLACK = 1e-12
#: Components of vectors; 64 squared differences of such fit 64 bits.
LARGEST = 1 << 27
#: Vectors whose bounds, and survivors whose distances, are computed together.
ROWS = 8_192


def integer_vectors(vectors: DataFrame, vec_id: str, vector: str, width: int, scale: int = 256) -> DataFrame:
    """``vec_id, v``: the components as ``floor(scale * x)``."""
    x = F.col(vector).cast("array<double>")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.size("x") == width).where(~F.exists("x", odd))
    large = F.raise_error(F.lit(f"a component lies beyond {LARGEST}"))
    floor = lambda c: F.when(F.abs(scale * c) <= LARGEST, F.floor(scale * c)).otherwise(large)
    return rows.select("vec_id", F.transform("x", floor).cast("array<int>").alias("v"))


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``a`` to those of ``b``, pair by pair."""
    apart = a.astype(np.int64) - b.astype(np.int64)
    return np.einsum("ij,ij->i", apart, apart)


def _to_all(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of every vector to every point, from exact squares."""
    return np.sqrt(np.stack([squares(vectors, p[None, :]) for p in points], axis=1).astype(np.float64))


class Bounds:
    """Lower bounds of the distances of vectors to centroids by fixed pairs of pivots."""

    def __init__(self, pivots: np.ndarray, sample: np.ndarray):
        self.pivots, self.sample = pivots, sample
        self.between = _to_all(pivots, pivots) if len(pivots) else np.zeros((0, 0))
        self.pairs = [(p, s) for p, s in combinations(range(len(pivots)), 2) if self.between[p, s] > 0]

    def of_pair(self, stored: np.ndarray, own: np.ndarray, p: np.ndarray, s: np.ndarray) -> np.ndarray:
        """``stored``: distances of vectors to pivots, ``own``: of centroids; ``p`` and ``s`` name a pair per centroid."""
        each = np.arange(len(own))
        a, b = stored[:, p] * own[each, s], stored[:, s] * own[each, p]
        return (np.abs(a - b) - SLACK * (a + b)) / self.between[p, s] * (1 - SLACK)

    def prepare(self, centroids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every centroid its ``PAIRS`` pairs with the largest mean bound over the sample."""
        self.own = _to_all(centroids, self.pivots)
        if not self.pairs or not len(self.sample):
            self.chosen = []
            return self.chosen
        every = [(np.full(len(centroids), p), np.full(len(centroids), s)) for p, s in self.pairs]
        worth = np.stack([self.of_pair(self.sample, self.own, p, s).mean(axis=0) for p, s in every])
        best = np.argsort(-worth, axis=0, kind="stable")[:PAIRS]
        pairs = np.array(self.pairs)
        self.chosen = [(pairs[row, 0], pairs[row, 1]) for row in best]
        return self.chosen

    def __call__(self, stored: np.ndarray) -> np.ndarray:
        low = np.zeros((len(stored), len(self.own)))
        for p, s in self.chosen:
            np.maximum(low, self.of_pair(stored, self.own, p, s), out=low)
        return low


def nearest(vectors: np.ndarray, stored: np.ndarray, centroids: np.ndarray, bounds: Bounds) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of every vector (of equal ones the first), the squared distance, and how many distances were computed."""
    cluster, distance, computed = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64), 0
    for at in range(0, len(vectors), ROWS):
        own = vectors[at : at + ROWS]
        low = bounds(stored[at : at + ROWS])
        first = low.argmin(axis=1)
        best, least = first, squares(own, centroids[first])
        open_ = low <= (np.sqrt(least.astype(np.float64)) * (1 + SLACK))[:, None]
        open_[np.arange(len(own)), first] = False
        rows, columns = np.nonzero(open_)
        computed += len(own) + len(rows)
        best, least = best.copy(), least.copy()
        for k in range(0, len(rows), ROWS):
            r, c = rows[k : k + ROWS], columns[k : k + ROWS]
            d = squares(own[r], centroids[c])
            order = np.lexsort((c, d, r))
            r, c, d = r[order], c[order], d[order]
            head = np.concatenate([[True], r[1:] != r[:-1]])  # the best of each vector in this part
            r, c, d = r[head], c[head], d[head]
            better = (d < least[r]) | (d == least[r]) & (c < best[r])
            best[r[better]], least[r[better]] = c[better], d[better]
        cluster[at : at + ROWS], distance[at : at + ROWS] = best, least
    return cluster, distance, computed


def _far_apart(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the points, each the farthest from those before it."""
    chosen = [0] if len(points) else []
    while chosen and len(chosen) < min(count, len(points)):
        gap = np.stack([squares(points, points[i][None, :]) for i in chosen]).min(axis=0)
        if gap.max() == 0:
            break
        chosen.append(int(gap.argmax()))
    return points[chosen]


def starts(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the ``k`` smallest SHA-256 digests of ``seed`` and id, in the order of the digests."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in first if r["key"] is not None], np.int64)


def with_pivots(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``vec_id, v, d``: the vectors with their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = _to_all(_matrix(batch.column(1), width, "i8"), pivots)
            stored = pa.ListArray.from_arrays(pa.array(np.arange(len(to) + 1) * len(pivots), pa.int32()), pa.array(to.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, stored], ["vec_id", "v", "d"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<int>, d array<double>")


def _sums(stored: DataFrame, centroids: np.ndarray, bounds: Bounds, width: int) -> list:
    """Count and component sums of every cluster: tasks add up their own vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
        for batch in batches:
            v = _matrix(batch.column(0), width, "i8")
            cluster, _, _ = nearest(v, _matrix(batch.column(1), len(bounds.pivots), "f8"), centroids, bounds)
            np.add.at(total, cluster, v)
            count += np.bincount(cluster, minlength=len(centroids))
        some = np.nonzero(count)[0]
        columns = [pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(total[some]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "rows", "total"])

    partial = stored.select("v", "d").mapInArrow(run, "cluster int, rows long, total array<long>")
    added = partial.groupBy("cluster").agg(F.sum("rows").alias("rows"), F.array(*[F.sum(F.get("total", i)) for i in range(width)]).alias("total"))
    return added.collect()  # k rows


def cluster(vectors: DataFrame, k: int, rounds: int, seed: str, width: int) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid`` of every vector (``vec_id, v``) after ``rounds`` rounds."""
    spark = vectors.sparkSession
    vectors = materialize(vectors, "vectors")
    centroids = starts(vectors, k, seed)
    out = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid array<long>")
    pivots = _far_apart(centroids, PIVOTS)
    stored = materialize(with_pivots(vectors, pivots, width), "pivots")
    by_hash = stored.select("d").orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE).collect()  # a bounded sample
    bounds = Bounds(pivots, np.array([r["d"] for r in by_hash], np.float64))
    for _ in range(rounds):
        bounds.prepare(centroids)
        for row in _sums(stored, centroids, bounds, width):
            centroids[row["cluster"]] = np.array(row["total"], np.int64) // row["rows"]
    bounds.prepare(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, d = _matrix(batch.column(1), width, "i8"), _matrix(batch.column(2), len(pivots), "f8")
            own, distance, _ = nearest(v, d, centroids, bounds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = materialize(stored.mapInArrow(assign, out), "assigned")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    found = [(c, inertia[c], sum(inertia.values()), centroids[c].tolist()) for c in sorted(inertia)]
    table = spark.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: str) -> Column:
    """SHA-256 of the components as decimal numbers joined by commas."""
    return F.sha2(F.array_join(F.col(centroid).cast("array<string>"), ","), 256)

