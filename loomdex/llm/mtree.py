"""Exact top-k inner products by best-first search in a paged M-tree.

Inner products become distances in a metric space: a row vector gets one more component so that all rows have the same
length, a query gets a zero there; the nearest row then has the largest inner product.

The tree is a table. Its upper level are the routing objects: at most ``ROUTING`` rows, chosen by a hash of their ids,
so their size is bounded. Every row goes to its nearest routing object; the rows of one object are cut into leaf pages of about
``PAGE_ROWS`` rows by a hash, so rows that are alike (or equal) never make a large page. A page is one table row:
its own centre, covering radius, distance of the centre to the routing object, and its entries with their distances
to the centre.

Search: pages are dealt to shelves of ``SHELF_PAGES``, queries to groups of ``GROUP_QUERIES``; a task holds one shelf and one
group. It visits a query's pages in the order of their lower bounds and stops at pages that cannot hold anything better. Two
stored distances save computations by the triangle inequality: centre to routing object before the distance to a
centre is computed, entry to centre before an entry's score is. Scores of the routing objects, which are rows
themselves, give the first threshold. Scores are exact integers; bounds have a small slack, so ties are never lost.

Cases: vectors that are null, empty or hold null or non-finite components, and vectors of another length than most, take no part; rows that
repeat an id count each, and a query leaves out all rows of its own id; a null id is no query and no answer; with fewer
than k rows all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.llm.common import grouped, materialize

#: Routing objects at most, and rows per routing object below that.
ROUTING = 1024
ROUTING_ROWS = 1024
PAGE_ROWS = 512
SHELF_PAGES = 8
GROUP_QUERIES = 4096
#: Relative slack of bounds: distances are floating-point numbers.
SLACK = 1e-9

PAGE = "page long, pivot int, radius double, to_pivot double, centre binary, n int, ids binary, vectors binary, to_centre binary"
FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """``vec_id, v``: components as ``floor(scale * x)``; see the module's cases for what is left out."""
    x = F.col(vector).cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v")).where(
        "vec_id IS NOT NULL AND size(v) > 0"
    )
    rows = rows.where(~F.exists("v", bad)).select("vec_id", F.transform("v", lambda c: F.floor(scale * c)).alias("v"))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (usual["d"] if usual else 0))


def _square(v: str) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda a, c: a + c * c)


def _lift(block: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that makes all their lengths equal."""
    return np.hstack([block, np.sqrt(np.maximum(0.0, top - (block * block).sum(axis=1)))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, square))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def routing_objects(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the routing objects."""
    count = max(1, min(ROUTING, total // ROUTING_ROWS))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    return np.array([r["vec_id"] for r in chosen], np.int64), np.array([r["v"] for r in chosen], np.float64)


def build(rows: DataFrame, objects: np.ndarray, top: float) -> DataFrame:
    """The leaf pages, as a written table."""
    width = objects.shape[1]
    lifted = _lift(objects, top)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _lift(_matrix(batch.column(1), width), top)
            pivot = np.argmin(_distances(block, lifted), axis=1).astype(np.int32) if len(block) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot)], ["vec_id", "v", "pivot"])

    placed = materialize(rows.mapInArrow(assign, "vec_id long, v array<long>, pivot int"), "mtree-rows")
    sizes = placed.groupBy("pivot").agg(F.count("*").alias("rows"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rows") / PAGE_ROWS))
    salted = placed.join(F.broadcast(sizes), "pivot").select(  # a row per routing object: bounded
        (F.col("pivot").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), parts)).alias("page"),
        "pivot",
        "vec_id",
        "v",
    )

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for table in grouped(batches, ["page"]):
            table = table.sort_by("vec_id")
            block = _matrix(table.column("v"), width)
            entries = _lift(block, top)
            pivot = table.column("pivot")[0].as_py()
            middle = entries.mean(axis=0, keepdims=True)
            centre = entries[np.argmin(_distances(entries, middle)[:, 0])][None, :]
            to_centre = _distances(entries, centre)[:, 0]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "page": table.column("page")[0].as_py(),
                        "pivot": pivot,
                        "radius": float(to_centre.max()),
                        "to_pivot": float(_distances(centre, lifted[pivot][None, :])[0, 0]),
                        "centre": centre.tobytes(),
                        "n": len(block),
                        "ids": table.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False).tobytes(),
                        "vectors": block.tobytes(),
                        "to_centre": to_centre.tobytes(),
                    }
                ],
                schema=_PAGE_SCHEMA,
            )

    built = salted.repartition("page").sortWithinPartitions("page").mapInArrow(pages, PAGE)
    return materialize(built, "mtree-pages")


_PAGE_SCHEMA = pa.schema(
    [("page", pa.int64()), ("pivot", pa.int32()), ("radius", pa.float64()), ("to_pivot", pa.float64()), ("centre", pa.binary()),
     ("n", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("to_centre", pa.binary())]
)


class Best:
    """The k best answers of each query of a group: larger scores first, then smaller ids."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.score = np.full((count, k), -np.inf)
        self.ids = np.full((count, k), np.iinfo(np.int64).max)

    def offer(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates as parallel arrays."""
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.score[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.score[query[keep], place[keep]] = score[keep]
        self.ids[query[keep], place[keep]] = ids[keep]


def search_shelf(pages: list[dict], ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, pivots: np.ndarray, top: float, k: int) -> Best:
    """Best-first visit of a shelf. ``floor``: a score that each query's k-th best reaches at least."""
    best = Best(len(ids), k)
    lifted = np.hstack([queries, np.zeros((len(queries), 1))])
    own = (queries * queries).sum(axis=1)
    used = sorted({p["pivot"] for p in pages})
    to_pivot = dict(zip(used, _distances(lifted, pivots[used]).T))

    def reach(q: np.ndarray) -> np.ndarray:
        """The distance within which a row must lie to matter still."""
        least = np.maximum(floor[q], best.score[q, -1])
        with np.errstate(invalid="ignore"):
            return np.where(np.isinf(least), np.inf, np.sqrt(np.maximum(0.0, own[q] + top - 2 * least)) * (1 + SLACK) + 1e-6)

    # bounds by the stored distance of centre and routing object
    bounds = np.stack([np.abs(to_pivot[p["pivot"]] - p["to_pivot"]) - p["radius"] for p in pages], axis=1)
    order = np.argsort(bounds, axis=1, kind="stable")
    for turn in range(len(pages)):
        for number in np.unique(order[:, turn]):
            q = np.nonzero(order[:, turn] == number)[0]
            q = q[bounds[q, number] <= reach(q)]
            if not len(q):
                continue
            page = pages[number]
            to_centre = _distances(lifted[q], page["centre"])[:, 0]
            near = to_centre - page["radius"] <= reach(q)
            q, to_centre = q[near], to_centre[near]
            if not len(q):
                continue
            possible = np.abs(to_centre[:, None] - page["to_centre"][None, :]) <= reach(q)[:, None]
            entries = np.nonzero(possible.any(axis=0))[0]
            if not len(entries):
                continue
            score = queries[q] @ page["vectors"][entries].T
            least = np.maximum(floor[q], best.score[q, -1])
            take = possible[:, entries] & (score >= least[:, None]) & (ids[q][:, None] != page["ids"][entries][None, :])
            a, b = np.nonzero(take)
            if len(a):
                best.offer(q[a], score[a, b], page["ids"][entries[b]])
    return best


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``queries`` (``vec_id, v``) against ``rows`` (``vec_id, v``)."""
    spark = rows.sparkSession
    rows = materialize(rows, "vectors")
    facts = rows.agg(F.count("*").alias("n"), F.max(_square("v")).alias("top"), F.max(F.size("v")).alias("d")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    top, width = float(facts["top"]), facts["d"]
    pivot_ids, objects = routing_objects(rows, facts["n"])
    pages = build(rows, objects, top)
    pivots = _lift(objects, top)
    shelves = max(1, math.ceil(pages.count() / SHELF_PAGES))
    groups = max(1, math.ceil(queries.count() / GROUP_QUERIES))
    shelved = pages.withColumn("shelf", F.pmod(F.xxhash64("page"), F.lit(shelves))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = queries.select(
        F.col("vec_id").alias("query_id"),
        "v",
        F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(groups)).cast("int").alias("group"),
    ).withColumn("shelf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shelves - 1).cast("long"))))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if left.empty or right.empty:
            return empty
        ids = right["query_id"].to_numpy(np.int64)
        asked_vectors = np.stack(right["v"].to_numpy()).astype(np.float64)
        opened = [
            {
                "pivot": p.pivot,
                "radius": p.radius,
                "to_pivot": p.to_pivot,
                "centre": np.frombuffer(p.centre).reshape(1, -1),
                "ids": np.frombuffer(p.ids, np.int64),
                "vectors": np.frombuffer(p.vectors).reshape(-1, width),
                "to_centre": np.frombuffer(p.to_centre),
            }
            for p in left.itertuples(index=False)
        ]
        first = Best(len(ids), k)
        score = asked_vectors @ objects.T
        a, b = np.nonzero(ids[:, None] != pivot_ids[None, :])
        if len(a):
            first.offer(a, score[a, b], pivot_ids[b])
        best = search_shelf(opened, ids, asked_vectors, first.score[:, -1], pivots, top, k)
        q, place = np.nonzero(~np.isinf(best.score))
        return pd.DataFrame(
            {"query_id": ids[q], "vec_id": best.ids[q, place], "score": best.score[q, place].astype(np.int64)}
        )

    found = (
        shelved.groupBy("shelf", "group")
        .cogroup(asked.groupBy("shelf", "group"))
        .applyInPandas(search, FOUND)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
