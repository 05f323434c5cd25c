"""Approximate nearest neighbours by cosine: stable projections in a kd-tree, with a chi-square stopping test.

Vectors are scaled to length one, so the largest cosine is the smallest distance. ``DIMENSIONS`` Gaussian projections (the normal
law is 2-stable) turn a distance d into a projected one whose square is d squared times a chi-square variable. A query takes its
projected neighbours in the order of their projected distance and verifies each on the original vectors; it stops when
the chi-square law says that a row nearer than its k-th best would have come already with probability ``sure``. There is
no other limit: without an early stop a query sees all rows.

The kd-tree is a table. Its upper part is cut from a bounded sample by medians of the widest projection and has at most ``CELLS``
leaves, so it fits into every task; every distinct vector goes to its cell. A cell is stored in pages of at most about ``PAGE_ROWS``
vectors, each a row with a kd-tree of its own down to buckets of ``BUCKET`` vectors.

Queries run in waves: to their own cell, to the next ``NEAR`` cells, then to all others. After every wave the best found so far
bound the distance at which the test holds, and only pairs of query and page within it are joined. Inside a page the
search is incremental, nodes and vectors in the order of their projected distance.

Equal vectors are one entry with their ``k + 1`` smallest ids, so groups of copies neither fill pages nor hide other rows; pages that many
queries visit are dealt with their queries over several tasks.

Cases: vectors that are null, zero or hold null or non-finite components, and vectors of another length than most, take no part; a
null id is no query and no answer; rows that repeat both id and vector are one; a query leaves out all rows of its own id; with
fewer than k candidates all are returned; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.llm.common import materialize

DIMENSIONS = 8
#: Probability that a nearer row has been seen when a query stops.
SURE = 0.97
#: Cells of the upper tree at most, distinct vectors of a cell that is wished for, rows of the sample that cuts it at most.
CELLS = 1 << 16
CELL_ROWS = 2_048
SAMPLE_ROWS = 1 << 18
PAGE_ROWS = 4_096
BUCKET = 64
#: Cells of the second wave.
NEAR = 16
#: Queries that meet a page in one task, about.
GROUP_QUERIES = 512


def chi_square(x: float, degrees: int = DIMENSIONS) -> float:
    """Probability that a chi-square variable of an even number of degrees is at most ``x``."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_ratio(sure: float, degrees: int = DIMENSIONS) -> float:
    """The squared projected distance, in squared distances of the k-th best, from which the test holds."""
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < sure:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < sure else (low, middle)
    return high


# Vectors


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``vec_id, v`` (doubles); see the module's cases for what is left out."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL").where(~F.exists("v", odd)).where(F.exists("v", lambda c: c != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; they are first scaled by powers of two, so that no square is too large or too small."""
    _, exponent = np.frexp(np.abs(v).max(axis=1))
    v = np.ldexp(v, -exponent[:, None])
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _blobs(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _wide(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def directions(width: int) -> np.ndarray:
    """The projections, the same in every task."""
    return np.random.default_rng(20_251_201).standard_normal((width, DIMENSIONS))


def project(vectors: DataFrame) -> DataFrame:
    """``vec_id, key, u, p``: a digest of the vector, the vector at length one, and its projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(_matrix(batch.column(1)))
            # row by row: equal rows get equal projections, whatever stands beside them in a batch
            p = np.einsum("ij,jk->ik", u, directions(u.shape[1])) if len(u) else np.zeros((0, DIMENSIONS))
            key = pa.array([blake2b(r.tobytes(), digest_size=16).digest() for r in u + 0.0], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), key, _blobs(u + 0.0), _blobs(p)], ["vec_id", "key", "u", "p"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, key binary, u binary, p binary")


def distinct_vectors(projected: DataFrame, k: int) -> DataFrame:
    """``key, u, p, ids``: equal vectors as one row with their ``k + 1`` smallest ids (as many do before the shuffle)."""
    place = F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))
    few = projected.withColumn("place", place).where(F.col("place") <= k + 1)
    return few.groupBy("key").agg(F.first("u").alias("u"), F.first("p").alias("p"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


# Trees


class Cells:
    """The upper kd-tree: inner nodes cut a projection at a value, leaves are the cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.left, self.right, self.cell = [], [], [], [], []
        self.low, self.high = [], []
        everywhere = np.full(DIMENSIONS, -np.inf), np.full(DIMENSIONS, np.inf)
        self._grow(sample, cells, *everywhere)
        self.axis, self.left, self.right, self.cell = (np.array(x, np.int64) for x in (self.axis, self.left, self.right, self.cell))
        self.cut, self.low, self.high = np.array(self.cut), np.array(self.low), np.array(self.high)

    def _grow(self, rows: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        node = len(self.axis)
        for column, value in ((self.axis, 0), (self.cut, 0.0), (self.left, node), (self.right, node), (self.cell, -1)):
            column.append(value)
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(DIMENSIONS)
        axis = int(spread.argmax())
        if cells < 2 or spread[axis] == 0:
            self.cell[node] = len(self.low)
            self.low.append(low)
            self.high.append(high)
            return node
        values = np.unique(rows[:, axis])
        cut = values[min(np.searchsorted(values, np.median(rows[:, axis]), side="right"), len(values) - 1) - 1]
        below = rows[:, axis] <= cut
        self.axis[node], self.cut[node] = axis, cut
        for side, own, count, bound in ((self.left, below, cells // 2, high), (self.right, ~below, cells - cells // 2, low)):
            edge = bound.copy()
            edge[axis] = cut
            side[node] = self._grow(rows[own], count, *((low, edge) if side is self.left else (edge, high)))
        return node

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of every point."""
        node = np.zeros(len(points), np.int64)
        while True:
            down = np.where(points[np.arange(len(points)), self.axis[node]] <= self.cut[node], self.left[node], self.right[node])
            if (down == node).all():
                return self.cell[node]
            node = down

    def by_distance(self, point: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """All cells from the nearest (the point's own) on, and their squared distances."""
        gap = box_squares(self.low, self.high, point)
        gap[home] = -1.0
        order = np.argsort(gap, kind="stable")
        return order, np.maximum(gap[order], 0.0)


def box_squares(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    gap = np.maximum(np.maximum(low - point, point - high), 0.0)
    return np.einsum("ij,ij->i", gap, gap)


PAGE = "page long, u binary, p binary, ids array<array<long>>, low binary, high binary, span binary"


def build_page(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree over a page: the order of its vectors, and by node the box and ``first, last, left, right`` (0: a bucket)."""
    order, low, high, span = np.arange(len(p)), [], [], []

    def grow(first: int, last: int) -> int:
        node = len(span)
        own = p[order[first:last]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        span.append([first, last, 0, 0])
        if last - first > BUCKET:
            axis = int((high[node] - low[node]).argmax())
            middle = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(own[:, axis], middle)]
            span[node][2] = grow(first, first + middle)
            span[node][3] = grow(first + middle, last)
        return node

    grow(0, len(p))
    return order, np.array(low), np.array(high), np.array(span, np.int64)


def pages(rows: DataFrame) -> DataFrame:
    """``page, u, p, ids`` of single vectors to one row per page."""

    def pack(table: pa.Table) -> pa.Table:
        p = _wide(table.column("p").to_pylist())
        order, low, high, span = build_page(p)
        u = _wide(table.column("u").to_pylist())[order]
        ids = table.column("ids").take(pa.array(order)).to_pylist()
        cells = [table.column("page")[0].as_py(), u.tobytes(), p[order].tobytes(), ids, low.tobytes(), high.tobytes(), span.tobytes()]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int64())), *[pa.binary()] * 3]
        names = ["page", "u", "p", "ids", "low", "high", "span"]
        return pa.Table.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds)], names)

    return rows.groupBy("page").applyInArrow(pack, PAGE)


class Page:
    """A stored page, opened for search."""

    def __init__(self, row: dict, width: int):
        self.u = np.frombuffer(row["u"], np.float64).reshape(-1, width)
        self.p, self.low, self.high = (np.frombuffer(row[c], np.float64).reshape(-1, DIMENSIONS) for c in ("p", "low", "high"))
        self.span = np.frombuffer(row["span"], np.int64).reshape(-1, 4).tolist()
        self.ids = row["ids"]

    def search(self, query_id: int, u: np.ndarray, p: np.ndarray, k: int, worst: float, ratio: float) -> list[tuple[float, int]]:
        """The query's best ``k`` of the page as ``(-cosine, id)``; ``worst``: the k-th best cosine so far (-inf: none).

        Nodes and vectors come in the order of their projected distance; the test ends the search.
        """
        best: list[tuple[float, int]] = []
        gaps = box_squares(self.low, self.high, p)
        nodes = [(gaps[0], 0)]
        far, rows = np.empty(0), np.empty(0, np.int64)  # vectors that wait for their turn
        while True:
            limit = max(0.0, 2 - 2 * worst) * ratio + 1e-12
            turn = nodes[0][0] if nodes else np.inf
            ready = far <= min(turn, limit)
            if ready.any():
                own, far, rows = rows[ready], far[~ready], rows[~ready]
                score = self.u[own] @ u
                for i in np.nonzero(score >= worst - 1e-12)[0].tolist():
                    # the value that counts does not depend on what was verified with it
                    cosine = float(np.einsum("i,i->", self.u[own[i]], u))
                    best += [(-cosine, x) for x in self.ids[own[i]] if x != query_id]
                best = heapq.nsmallest(k, best)
                if len(best) == k:
                    worst = max(worst, -best[-1][0])
                continue
            if not nodes or turn > limit:
                return best
            _, node = heapq.heappop(nodes)
            first, last, left, right = self.span[node]
            if left:
                heapq.heappush(nodes, (gaps[left], left))
                heapq.heappush(nodes, (gaps[right], right))
            else:
                gap = self.p[first:last] - p
                far = np.concatenate([far, np.einsum("ij,ij->i", gap, gap)])
                rows = np.concatenate([rows, np.arange(first, last)])


# Search


def _wave(queries: DataFrame, stored: DataFrame, in_cells: DataFrame, cells: Cells, wave: int, k: int, ratio: float, width: int) -> DataFrame:
    """``q, found`` of the pages that a wave's queries (``q, query_id, u, p, worst``) visit."""
    first, last = ((0, 1), (1, 1 + NEAR), (1 + NEAR, None))[wave]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, worst = _wide(batch.column(1).to_pylist()), batch.column(2).to_pylist()
            q, where = [], []
            for i, home in enumerate(cells.of(p)):
                limit = np.inf if worst[i] is None else max(0.0, 2 - 2 * worst[i]) * ratio + 1e-12
                order, gap = cells.by_distance(p[i], home)
                own = order[first:last][gap[first:last] <= limit]
                q.append(np.full(len(own), batch.column(0)[i].as_py()))
                where.append(own)
            columns = [pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64)) for x in (q, where)]
            yield pa.RecordBatch.from_arrays(columns, ["q", "cell"])

    own = queries.select("q", "p", "worst").mapInArrow(visits, "q long, cell long").join(in_cells, "cell")
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
    own = materialize(own.select("q", (F.col("cell") * (1 << 32) + F.col("part")).alias("page")), f"visits-{wave}")
    groups = own.groupBy("page").agg(F.ceil(F.count("*") / GROUP_QUERIES).alias("groups"))
    asked = own.join(groups, "page").select("q", "page", F.pmod(F.xxhash64("q", "page"), "groups").alias("part"))
    asked = asked.join(queries.select("q", "query_id", "u", "p", "worst"), "q")
    opened = stored.join(groups, "page").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")

    def search(key: tuple, rows: pa.Table, page: pa.Table) -> pa.Table:
        one = Page(page.to_pylist()[0], width)
        names, ids, scores = [], [], []
        for batch in rows.to_batches(max_chunksize=256):
            u, p = _wide(batch.column("u").to_pylist()), _wide(batch.column("p").to_pylist())
            columns = (batch.column(c).to_pylist() for c in ("q", "query_id", "worst"))
            for i, (q, query_id, worst) in enumerate(zip(*columns)):
                for score, vec_id in one.search(query_id, u[i], p[i], k, -np.inf if worst is None else worst, ratio):
                    names.append(q)
                    ids.append(vec_id)
                    scores.append(-score)
        return pa.Table.from_arrays([pa.array(names, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], ["q", "vec_id", "score"])

    columns = asked.select("q", "query_id", "u", "p", "worst", "page", "part").groupBy("page", "part")
    return columns.cogroup(opened.groupBy("page", "part")).applyInArrow(search, "q long, vec_id long, score double")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, sure: float = SURE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for every query; both sides as :func:`usable` gives them."""
    projected = materialize(project(rows), "projected")
    entries = materialize(distinct_vectors(projected, k), "entries")
    count = entries.count()
    head = entries.select(F.octet_length("u").alias("bytes")).first()
    if head is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, ratio = head["bytes"] // 8, stop_ratio(sure)
    # every row of a small table; of a large one a share of it by the digest, of a bounded expected size
    share = min(1 << 20, math.ceil((SAMPLE_ROWS << 20) / count))
    sample = entries.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share).select("p").collect()
    cells = Cells(_wide([r["p"] for r in sample]) if sample else np.zeros((0, DIMENSIONS)), min(CELLS, max(1, count // CELL_ROWS)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = cells.of(_wide(batch.column(1).to_pylist())) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], ["key", "p", "u", "ids", "cell"])

    placed = materialize(
        entries.select("key", "p", "u", "ids").mapInArrow(place, "key binary, p binary, u binary, ids array<long>, cell long"), "placed"
    )
    in_cells = materialize(placed.groupBy("cell").agg(F.ceil(F.count("*") / PAGE_ROWS).alias("pages")), "cells")
    page = F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("key"), F.col("pages"))
    stored = materialize(pages(placed.join(in_cells, "cell").select(page.alias("page"), "u", "p", "ids")), "pages")

    asked = project(queries).dropDuplicates(["vec_id", "key"]).select(F.col("vec_id").alias("query_id"), "u", "p")
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    found, state = None, asked.withColumn("worst", F.lit(None).cast("double"))
    for wave in range(3):
        new = _wave(state, stored, in_cells, cells, wave, k, ratio, width)
        every = new if found is None else found.select("q", "vec_id", "score").unionByName(new)
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
        found = materialize(every.withColumn("rank", rank).where(F.col("rank") <= k), f"found-{wave}")
        last = found.where(F.col("rank") == k).select("q", F.col("score").alias("worst"))
        state = asked.join(last, "q", "left")
    return found.join(asked.select("q", "query_id"), "q").select("query_id", "rank", "vec_id", "score")
