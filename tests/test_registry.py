"""Registry and document store transitions on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomdex.operators import docstore
from loomdex.operators import registry as reg
from loomdex.schemas import REGISTRY

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def registry(spark):
    rows = [
        ("/d/doc0.md", "id-0", "h0", 3, "indexed", T0, None),
        ("/d/doc1.md", "id-1", "h1", 0, "pending", None, None),
        ("/d/doc2.md", "id-2", "h2", 2, "error", T0, "broken"),
    ]
    return spark.createDataFrame(rows, REGISTRY)


def scan_of(spark, **hashes):
    return spark.createDataFrame([(f"/d/{k}.md", v) for k, v in hashes.items()], "file_path string, content_hash string")


def by_path(df):
    return {r.file_path: r for r in df.collect()}


def test_diff(spark, registry):
    got = {r.file_path: r.change for r in reg.diff(registry, scan_of(spark, doc0="h0", doc1="new", doc9="h9")).collect()}
    assert got == {"/d/doc1.md": "modified", "/d/doc2.md": "deleted", "/d/doc9.md": "added"}


def test_upsert_keeps_id_and_count(spark, registry):
    rows = by_path(reg.upsert(registry, scan_of(spark, doc0="new", doc9="h9")))
    assert (rows["/d/doc0.md"].file_id, rows["/d/doc0.md"].chunk_count) == ("id-0", 3)
    assert (rows["/d/doc0.md"].content_hash, rows["/d/doc0.md"].status, rows["/d/doc0.md"].indexed_at) == ("new", "pending", None)
    assert rows["/d/doc9.md"].status == "pending" and len(rows["/d/doc9.md"].file_id) == 36
    assert rows["/d/doc2.md"].error_message == "broken"  # not scanned: untouched


def test_marks(spark, registry):
    now = F.lit("2024-05-05 10:00:00").cast("timestamp")
    done = spark.createDataFrame([("/d/doc1.md", 7), ("/d/unknown.md", 1)], "file_path string, n_chunks int")
    bad = spark.createDataFrame([("/d/doc0.md", "lost")], "file_path string, error string")
    rows = by_path(reg.mark_error(reg.mark_indexed(registry, done, now), bad, now))
    assert (rows["/d/doc1.md"].status, rows["/d/doc1.md"].chunk_count) == ("indexed", 7)
    assert (rows["/d/doc0.md"].status, rows["/d/doc0.md"].error_message) == ("error", "lost")
    assert len(rows) == 3


def test_stats_lists_and_cleanup(spark, registry):
    assert reg.stats(registry).first().asDict() == {
        "total_files": 3, "indexed_count": 1, "pending_count": 1, "error_count": 1, "total_chunks": 3,
    }
    assert reg.stats(registry.limit(0)).first().total_chunks == 0
    assert [r.file_path for r in reg.pending(registry).collect()] == ["/d/doc1.md"]
    assert [r.file_path for r in reg.errors(registry).collect()] == ["/d/doc2.md"]
    kept = scan_of(spark, doc1="h1")
    assert [r.file_path for r in reg.deleted_files(registry, kept).collect()] == ["/d/doc0.md", "/d/doc2.md"]
    assert set(by_path(reg.keep_scanned(registry, kept))) == {"/d/doc1.md"}
    assert set(by_path(reg.remove(registry, kept))) == {"/d/doc0.md", "/d/doc2.md"}


def test_docstore(spark):
    store = spark.createDataFrame([(1, "a", "/x"), (2, "b", "/y")], "doc_id long, content string, filepath string")
    new = spark.createDataFrame([(2, "B", "/y"), (3, "c", "/x")], "doc_id long, content string, filepath string")
    merged = docstore.upsert(store, new)
    assert sorted((r.doc_id, r.content) for r in merged.collect()) == [(1, "a"), (2, "B"), (3, "c")]
    assert [r.doc_id for r in docstore.by_filepath(merged, "/x").collect()] == [1, 3]
    assert [r.doc_id for r in docstore.delete(merged, new).collect()] == [1]
    assert docstore.max_chunk_id(merged.limit(0)).first().max_id == 0
    row = docstore.consistency(merged, store, new).first()
    assert (row.missing_in_bm25, row.missing_in_store, row.missing_in_vectors, row.extra_vectors, row.consistent) == (1, 0, 1, 0, False)
    assert docstore.consistency(store, store, store).first().consistent


def test_json_metadata(spark):
    df = spark.createDataFrame([('{"a":"1"}',), ("not json",), (None,)], "j string")
    assert [r[0] for r in df.select(docstore.metadata_from_json(F.col("j"))).collect()] == [{"a": "1"}, {}, {}]
    assert df.select(docstore.metadata_to_json(F.create_map().cast("map<string,string>"))).first()[0] is None
