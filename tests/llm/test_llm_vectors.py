"""Clusters, approximate neighbours and Merkle manifests against brute force; odd rows and skew."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import clusters, merkle, projections

ODD = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan"), 0.0, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [1.0, 2.0])]


def vector_table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("u", F.lit(1))


# Clusters


def plain_clusters(rows, k, rounds, seed):
    """Lloyd's rounds in Python integers over ``(vec_id, components)``."""
    vectors = [[math.floor(256 * x) for x in v] for _, v in rows]
    order = sorted((hashlib.sha256(f"{seed}{i}".encode()).hexdigest(), v) for (i, _), v in zip(rows, vectors) if i is not None)
    centroids = [list(v) for _, v in order[:k]]

    def assign():
        squares = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in vectors]
        return [(d.index(min(d)), min(d)) for d in squares]

    for _ in range(rounds):
        own = assign()
        for c in range(len(centroids)):
            inside = [v for v, (x, _) in zip(vectors, own) if x == c]
            if inside:
                centroids[c] = [sum(column) // len(inside) for column in zip(*inside)]
    return assign(), centroids


def clustered_rows(rng, n):
    centres = [[rng.uniform(-3, 3) for _ in range(4)] for _ in range(6)]
    rows = [(i, [np.float32(x + rng.gauss(0, 0.3)).item() for x in rng.choice(centres)]) for i in range(n)]
    hot = [(1000 + i, [0.5, -0.25, 0.125, 1.0]) for i in range(n // 3)]
    return [*rows, *hot, rows[0], rows[1], (None, [0.5, 0.5, 0.5, 0.5]), (None, [9.0, 9.0, 9.0, 9.0])]


@pytest.mark.parametrize(("n", "k"), [(150, 7), (3, 9)])
def test_clusters(spark, n, k):
    rows = clustered_rows(random.Random(n), n)
    table = vector_table(spark, [*rows, *ODD])
    got = clusters.cluster(clusters.integer_vectors(table, "vec_id", "embedding", 4), k, 5, "2:", 4).collect()
    want, centroids = plain_clusters(rows, k, 5, "2:")
    inertia = sum(d for _, d in want)
    own = [sum(d for x, d in want if x == c) for c in range(len(centroids))]
    expected = [(i, c, d, own[c], inertia, centroids[c]) for (i, _), (c, d) in zip(rows, want)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(3)
    vectors = np.concatenate([rng.integers(-500, 500, (400, 8)), np.zeros((5, 8), np.int64)])
    centroids = np.concatenate([rng.integers(-500, 500, (9, 8)), vectors[:3], vectors[:1]])
    bounds = clusters.Bounds(centroids[:6], clusters._to_all(vectors[:50], centroids[:6]))
    bounds.prepare(centroids)
    stored = clusters._to_all(vectors, centroids[:6])
    true = clusters._to_all(vectors, centroids)
    assert (bounds(stored) <= true).all() and (bounds(stored) > 0.5 * true).any()
    own, distance, computed = clusters.nearest(vectors, stored, centroids, bounds)
    assert (own == true.argmin(axis=1)).all() and (distance == np.rint(true.min(axis=1) ** 2)).all()
    assert computed < true.size


def test_clusters_of_odd_tables(spark):
    none = clusters.integer_vectors(vector_table(spark, ODD), "vec_id", "embedding", 4)
    assert clusters.cluster(none, 3, 2, "2:", 4).count() == 0
    huge = clusters.integer_vectors(vector_table(spark, [(1, [1e30, 0.0, 0.0, 0.0])]), "vec_id", "embedding", 4)
    with pytest.raises(Exception, match="lies beyond"):
        huge.collect()


# Approximate neighbours


def plain_neighbours(rows, query, k):
    seen = {(i, tuple(v)): np.asarray(v, np.float64) for i, v in rows}
    q = next(np.asarray(v, np.float64) for i, v in rows if i == query)
    cosines = [(-float(v @ q / np.sqrt((v @ v) * (q @ q))), i) for (i, _), v in seen.items() if i != query]
    return sorted((round(c, 9), i) for c, i in cosines)[:k]


def neighbours(spark, rows, k, sure=0.999):
    table = projections.usable(vector_table(spark, rows), "vec_id", "embedding")
    found = projections.top_k(table, table.where("vec_id % 10 = 0"), k, sure).collect()
    by = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((round(-r.score, 9), r.vec_id))
        assert r["rank"] == len(by[r.query_id])
    return by


def test_neighbours(spark, monkeypatch):
    """Many cells and pages, a third of the rows equal, and a vector that many ids share at other lengths."""
    for name, value in (("CELL_ROWS", 40), ("PAGE_ROWS", 25), ("BUCKET", 4), ("GROUP_QUERIES", 5), ("NEAR", 3)):
        monkeypatch.setattr(projections, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(rng.standard_normal((400, 12)).astype(np.float32).tolist())]
    hot = [(1000 + i, rows[7][1]) for i in range(200)]
    scaled = [(2000 + i, [4.0 * x for x in rows[9][1]]) for i in range(30)]
    every = [*rows, *hot, *scaled, rows[20], rows[20]]
    odd = [(None, rows[3][1]), (910, [0.0] * 12), (920, [1.0] * 11), (930, None), (940, [math.nan] * 12), (950, [])]
    got = neighbours(spark, [*every, *odd], 5)
    asked = sorted({i for i, _ in every if i % 10 == 0})
    assert sorted(got) == asked
    hits = 0
    for i in asked:
        want = plain_neighbours(every, i, 5)
        assert len(got[i]) == 5
        hits += len({x for _, x in got[i]} & {x for _, x in want})
    assert hits >= 0.97 * 5 * len(asked)
    assert got[1000] == [(-1.0, i) for i in (7, 1001, 1002, 1003, 1004)] == plain_neighbours(every, 1000, 5)
    assert [i for _, i in got[2000]] == [9, 2001, 2002, 2003, 2004]


def test_few_neighbours(spark):
    assert neighbours(spark, [(10, [1.0, 0.0]), (11, [1.0, 1.0]), (10, [1.0, 0.0])], 5) == {10: [(round(-math.sqrt(0.5), 9), 11)]}
    assert neighbours(spark, [(10, [1.0, 0.0])], 5) == {}
    assert neighbours(spark, [(10, None)], 5) == {}


def test_stopping_test():
    draws = np.random.default_rng(1).chisquare(8, 100_000)
    for sure in (0.5, 0.9, 0.99):
        assert abs((draws <= projections.stop_ratio(sure, 8)).mean() - sure) < 0.01


def test_recall_on_given_vectors(spark):
    """Recall against brute force with production parameters."""
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    table = projections.usable(vector_table(spark, rows), "vec_id", "embedding")
    found = projections.top_k(table, table.where("vec_id % 50 = 0"), 5).collect()
    v = np.array([x for _, x in rows], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    place = {i: n for n, (i, _) in enumerate(rows)}
    hits = asked = 0
    for i in {r.query_id for r in found}:
        cosine = v @ v[place[i]]
        cosine[place[i]] = -2
        best = {rows[n][0] for n in np.argsort(-cosine)[:5]}
        hits += len(best & {r.vec_id for r in found if r.query_id == i})
        asked += 5
    assert asked == 5 * sum(i % 50 == 0 for i in place) and hits >= 0.9 * asked


# Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(digests):
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_proof(levels, k):
    """``(sibling or None, sibling is left)`` per level."""
    out = []
    for level in levels[:-1]:
        out.append((level[k ^ 1] if k ^ 1 < len(level) else None, k & 1))
        k >>= 1
    return out


def plain_manifest(rows, columns, group, order):
    text = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = {n: h(*(text(r[c]) for c in columns)) for n, r in enumerate(rows)}
    first_null = lambda v: (v is not None, v if v is not None else "")
    groups = sorted({r[group] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees, places = {}, {}
    for g in groups:
        own = sorted((n for n, r in enumerate(rows) if r[group] == g), key=lambda n: (rows[n][order] is not None, rows[n][order] or 0, leaf[n]))
        trees[g] = plain_tree([leaf[n] for n in own])
        places |= {n: k for k, n in enumerate(own)}
    top = plain_tree([trees[g][-1][0] for g in groups])
    root, out = top[-1][0], []
    for n, r in enumerate(rows):
        proof = plain_proof(trees[r[group]], places[n]) + plain_proof(top, groups.index(r[group]))
        folded = "f" * 64
        for sibling, left in proof:
            folded = h(folded) if sibling is None else h(sibling, folded) if left else h(folded, sibling)
        out.append((r[order], leaf[n], trees[r[group]][-1][0], root, h(*(s for s, _ in proof if s)), folded, folded == root))
    return sorted(out, key=lambda r: (first_null(r[0]), r[1:]))


@pytest.mark.parametrize(("height", "n"), [(2, 90), (3, 200), (11, 60), (2, 1), (2, 5)])
def test_manifest(spark, height, n):
    rng = random.Random(n)
    langs = [None, "", "de", "en", "en", "en", "é", "z"]
    rows = [{"doc_id": i, "lang": rng.choice(langs), "text": rng.choice([None, "", "ö" * 40, f"text {i}"]), "row_id": i % 3, "rank": None} for i in range(n)]
    rows += [{**rows[0], "doc_id": None}, rows[0], rows[0]] if n > 5 else []
    table = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id long, lang string, text string, row_id int, rank int")
    columns = ["doc_id", "lang", "row_id", "text"]
    got = merkle.manifest(table, "lang", "doc_id", columns, lambda d: F.lit("f" * 64), height).collect()
    want = plain_manifest(rows, columns, "lang", "doc_id")
    assert sorted(map(tuple, got), key=lambda r: ((r[0] is not None, r[0] if r[0] is not None else ""), r[1:])) == want
    assert all(r.verified and r.folded_root == r.root for r in merkle.manifest(table, "lang", "doc_id", columns, height=height).collect())


def test_empty_manifest(spark):
    none = spark.createDataFrame([], "doc_id long, lang string")
    assert merkle.manifest(none, "lang", "doc_id", ["doc_id", "lang"]).collect() == []


def test_van_emde_boas_order():
    def recursive(levels):
        """Depth and index of the nodes in their order, straight from the definition."""
        if levels == 1:
            return [(0, 0)]
        top, below = levels // 2, levels - levels // 2
        out = recursive(top)
        for r in range(1 << top):
            out += [(d + top, (r << d) + i) for d, i in recursive(below)]
        return out

    for height in range(9):
        layout = merkle.Layout(height)
        for at, (depth, index) in enumerate(recursive(height + 1)):
            assert layout.addresses(depth, np.array([index]))[0] == at
