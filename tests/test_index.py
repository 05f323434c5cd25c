"""Sync, search and three-layer behaviour of the index on small Markdown corpora."""

import os
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loomdex import SearchIndex
from loomdex.functions.embed import HashEmbedder
from loomdex.plans.catalog.docx_fixture import docx_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # a model service of the tests travels to the workers

DOCS = {
    "doc1_水务年报.md": "# 年报\n\n## 公司介绍\n\n水务集团主营地下水监测与石油管道检测业务，成立于二零一五年。\n\n"
    "## 财务\n\n石油管道检测营收二亿元，同比增长百分之十八，净利润四千万元。\n",
    "油服_20240131_周报.md": "# 周报\n\n## 技术部周会\n\n参会人员讨论了石油检测技术路线与下一步计划，决定继续推进。\n",
    "plain.md": "# Notes\n\n## Search design\n\nThe search engine ranks chunks by words and vectors, then adds context.\n",
}


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode("utf-8"))
    return path


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("docs"))
    for name, text in DOCS.items():
        write(folder, name, text)
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("idx") / "i"), HashEmbedder(32))
    config = {"watch_dirs": [folder, None], "supported_extensions": [".md"], "ignore_patterns": ["*.tmp"]}
    assert index.sync_from_config(config) == {"added": 3, "modified": 0, "deleted": 0, "errors": 0}
    return index, folder, config


def ids(df):
    return [r[0] for r in df.collect()]


def test_ids_and_layers_agree(corpus):
    index, _, _ = corpus
    rows = index.chunks().orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(1, len(rows) + 1))
    assert index.verify_consistency()
    stats = index.stats()
    assert stats["bm25_chunks"] == stats["vec_vectors"] == stats["store_docs"] == len(rows) == stats["id_counter"]
    assert stats["compression_ratio"] == "4.6x"  # 32 components: 128 bytes as they are, 16 in four planes and 12 of scale


def test_second_sync_changes_nothing(corpus):
    index, _, config = corpus
    version = index.store.head.version
    assert index.sync_from_config(config) == {"added": 0, "modified": 0, "deleted": 0, "errors": 0}
    assert index.store.refresh().version == version
    assert index.registry_stats()["indexed_count"] == 3


def test_hits_are_candidates_and_at_most_k(corpus):
    index, _, _ = corpus
    allowed = set(ids(index.bm25_candidates("石油").select("doc_id")))
    assert allowed
    for k in (1, 3, 5, 10):
        hits = ids(index.search("石油", k=k))
        assert 0 < len(hits) <= k and set(hits) <= allowed
        assert all(index.get_content(h) for h in hits[:2])


def test_every_query_term_is_needed(corpus):
    index, _, _ = corpus
    assert ids(index.search("量子芯片")) == []
    assert ids(index.search("search 石油")) == []
    assert len(ids(index.search("search 石油", mode="or"))) > 2
    assert ids(index.search("?!")) == []


def test_metadata_filters(corpus):
    index, _, _ = corpus
    by_name = {r.doc_id: os.path.basename(r.filepath) for r in index.chunks().collect()}
    every = set(ids(index.search("石油")))
    dept = set(ids(index.search("石油", {"department": "油服"})))
    assert dept and {by_name[i] for i in dept} == {"油服_20240131_周报.md"}
    assert set(ids(index.search("石油", {"department": "油服"}, filter_mode="pre"))) == dept
    assert set(ids(index.bm25_candidates("石油", {"department": "油服"}, 5000))) == dept
    assert set(ids(index.search("石油", {"date_gte": "2024-01-01"}))) == dept
    assert set(ids(index.search("石油", {"date_lte": "2024-01-01"}))) == every - dept  # no date passes
    assert set(ids(index.search("石油", {"unknown": 1}))) == every
    assert ids(index.search("石油", {"department": "财务"})) == []


def test_bm25_equals_restatement(corpus):
    import math

    from loomdex.functions.text import tokenize

    index, _, _ = corpus
    docs = {r.doc_id: r.t for r in index.chunks().select("doc_id", tokenize(F.col("content")).alias("t")).collect()}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = sum("石油" in t for t in docs.values())
    want = {}
    for i, t in docs.items():
        tf = t.count("石油")
        if tf:
            want[i] = (math.log(n / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    got = {r.doc_id: r.bm25 for r in index.bm25_candidates("石油").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-8 for i in want)


def test_context_of_children_and_sections(corpus):
    index, _, _ = corpus
    rows = index.search_with_context("石油", k=10).collect()
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
    assert {r.chunk_type for r in rows} == {"L1", "L2"}
    for r in rows:
        if r.chunk_type == "L2":
            assert r.section_title.startswith(r.parent_title) and r.matched_content in r.parent_context
        else:
            assert r.parent_context == "" and r.parent_title == ""
    collapsed = index.search_with_context("石油", k=10, collapse_parent=True).collect()
    assert len(collapsed) < len(rows) and collapsed[0].id == rows[0].id
    assert "分数" in index.render(index.search_with_context("石油", k=1)).first().text


def test_parent_lookup(corpus):
    index, _, _ = corpus
    for r in index.chunks().collect()[:4]:
        parent = index.get_parent_chunk(r.doc_id)
        assert parent["chunk_type"] == "L1"
        assert parent["doc_id"] == (r.doc_id if r.chunk_type == "L1" else r.parent_id)
    assert index.get_parent_chunk(10**9) is None


def test_vector_search_is_exact(corpus):
    index, _, _ = corpus
    vectors = {r.doc_id: r.embedding for r in index.store.layer("vectors").collect()}
    q = index.embedder.embed_batch(["石油检测"])[0]
    want = sorted(vectors, key=lambda i: (-round(sum(a * b for a, b in zip(q, vectors[i])), 5), i))[:3]
    assert ids(index.search_vectors("石油检测", k=3)) == want


def test_lifecycle(spark, tmp_path):
    docs = str(tmp_path / "docs")
    index = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(16))
    config = {"watch_dirs": [docs, str(tmp_path / "missing")], "supported_extensions": [".md", ".docx"]}
    a = write(docs, "a.md", "# 文档1\n\n这是第一个文档，内容足够长。")
    b = write(docs, "sub/b.md", "# 文档2\n\n这是第二个文档，内容更长一些。")
    c = write(docs, "c.md", "# 文档3\n")
    bad = write(docs, "bad.md", b"\xff\xfe\x00 not text")
    with pytest.warns(UserWarning, match="missing"):
        assert index.sync_from_config(config) == {"added": 2, "modified": 0, "deleted": 0, "errors": 1}
    assert [r.file_path for r in index.errors().collect()] == [bad]
    assert index.registry_stats() == {
        "total_files": 4, "indexed_count": 3, "pending_count": 0, "error_count": 1, "total_chunks": 4,
    }
    first_max = index.stats()["id_counter"]

    write(docs, "a.md", "# 文档1\n\n第一个文档已经改写，内容完全不同。")
    write(docs, "bad.md", "# 好了\n\n现在是可以读取的文本内容了。")
    os.remove(b)
    os.remove(c)
    config["watch_dirs"] = [docs]
    # the repaired file was registered before, so its new content counts as modified
    assert index.sync_from_config(config) == {"added": 0, "modified": 2, "deleted": 2, "errors": 0}
    live = index.chunks().collect()
    assert {r.filepath for r in live} == {a, bad}
    assert min(r.doc_id for r in live) > first_max  # ids are never given out twice
    assert index.verify_consistency()
    assert index.sync_from_config(config) == {"added": 0, "modified": 0, "deleted": 0, "errors": 0}

    assert ids(index.bm25_candidates("第二个文档")) == []
    before = sorted((r.doc_id, r.content) for r in live)
    index.compact()
    assert sorted((r.doc_id, r.content) for r in index.chunks().collect()) == before
    assert index.verify_consistency() and index.removed_count() == 0

    gone = live[0].doc_id
    assert index.remove_document(gone) and not index.remove_document(gone)
    assert index.get_content(gone) is None and index.verify_consistency()

    doc = write(docs, "new.docx", docx_bytes([("Heading 1", [("标题", False, False)]), ("", [("正文段落，足够长的一段文字内容。", False, False)])]))
    new_id = index.add_document(doc)
    assert index.get_content(new_id)["title"] == "## 📑 章节导航"  # the navigation page comes first
    known = index.get_content(new_id + 4)["metadata"]
    assert known["conversion_method"] and known["heading_level"] == "1" and known["file_name"] == "new.docx"
    assert index.get_content(new_id)["metadata"] == {"file_name": "new.docx"}
    titles = [r.title for r in index.get_by_filepath(doc).collect()]
    assert titles[4:] == ["# 标题", "# 标题 [段落1]"]
    with pytest.raises(FileNotFoundError):
        index.add_document(str(tmp_path / "nothing.md"))
    with pytest.raises(ValueError):
        index.add_document(write(docs, "empty.md", "no heading here at all"))

    reopened = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(16))
    assert reopened.get_content(new_id)["filepath"] == doc
    assert reopened.get_by_filepath(doc).count() == 6


def test_uncommitted_version_is_invisible(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(16))
    path = write(str(tmp_path / "d"), "a.md", "# One\n\nA first document with enough words.")
    index.add_document(path)
    before = index.chunks().count()
    leftover = index.chunks()
    index.store.write("chunks", index.store.head.version + 1, leftover)  # a sync that died before its commit
    assert SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(16)).chunks().count() == before


def test_stream_ingests_new_files_once(spark, tmp_path):
    from loomdex.streaming.watch import watch

    docs, ckpt = str(tmp_path / "docs"), str(tmp_path / "ckpt")
    index = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(16))
    write(docs, "a.md", "# One\n\nA first document with enough words.")
    write(docs, "skip.txt", "# Two\n\nNot a Markdown extension at all.")
    for _ in range(2):
        q = watch(index, docs, [".md"], ckpt)
        q.awaitTermination(120)
        assert q.exception() is None
        assert index.registry_stats()["indexed_count"] == 1
    write(docs, "b.md", "# Three\n\nAnother document with enough words.")
    watch(index, docs, [".md"], ckpt).awaitTermination(120)
    assert index.registry_stats()["indexed_count"] == 2 and index.verify_consistency()


def test_stream_of_syncs_sees_edits_and_deletions(spark, tmp_path):
    import time

    from loomdex.streaming.watch import extension_glob, follow

    assert extension_glob([".md", ".c1"]) == "*{.[mM][dD],.[cC]1}" and extension_glob([]) == "*"
    docs = str(tmp_path / "docs")
    index = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(8))
    a = write(docs, "a.md", "# One\n\nA first document with enough words.")
    b = write(docs, "b.md", "# Two\n\nA second document with enough words.")
    query = follow(index, {"watch_dirs": [docs], "supported_extensions": [".md"]}, str(tmp_path / "ckpt"), interval="1 second")

    def until(want):
        for _ in range(240):
            rows = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(8)).chunks().where("chunk_type = 'L2'").collect()
            if {r.content for r in rows} == want or query.exception():
                break
            time.sleep(0.5)
        assert query.exception() is None and {r.content for r in rows} == want

    try:
        until({"A first document with enough words.", "A second document with enough words."})
        write(docs, "a.md", "# One\n\nAn edited document with enough words.")
        os.remove(b)
        write(docs, "c.md", "# Three\n\nA third document with enough words.")
        until({"An edited document with enough words.", "A third document with enough words."})
    finally:
        query.stop()
    assert {r.file_path for r in index.list_files().collect()} == {a, os.path.join(docs, "c.md")}
    before = index.store.refresh().max_id
    index.clear()
    assert len(index) == 0 and index.list_files().count() == 0 and index.find("document").count() == 0
    assert index.add_document(a) == before + 1


class Flaky:
    """A model service that fails for some texts until it is mended; all calls are counted in a file."""

    def __init__(self, log, broken="", dim=8):
        self.log, self.broken, self.inner = log, broken, HashEmbedder(dim)

    def embed_batch(self, texts):
        with open(self.log, "a", encoding="utf-8") as f:
            f.writelines("x\n" for _ in texts)
        mended = os.path.exists(self.log + ".mended")
        return [None if self.broken and self.broken in t and not mended else v for t, v in zip(texts, self.inner.embed_batch(texts))]


def test_a_chunk_without_vector_is_an_error_until_the_service_answers(spark, tmp_path):
    docs, log = str(tmp_path / "docs"), str(tmp_path / "calls")
    index = SearchIndex(spark, str(tmp_path / "i"), Flaky(log, "stubborn"))
    write(docs, "a.md", "# One\n\nA first document with enough words.")
    b = write(docs, "b.md", "# Two\n\nA stubborn document with enough words.")
    config = {"watch_dirs": [docs], "supported_extensions": [".md"]}
    assert index.sync_from_config(config) == {"added": 1, "modified": 0, "deleted": 0, "errors": 1}
    (row,) = index.errors().collect()
    assert row.file_path == b and "no vector" in row.error_message
    with open(log, encoding="utf-8") as f:
        assert len(f.readlines()) == index.chunks().count()  # the model saw every chunk once
    open(log + ".mended", "w").close()
    assert index.sync_from_config(config) == {"added": 0, "modified": 1, "deleted": 0, "errors": 0}
    assert index.verify_consistency() and index.errors().count() == 0
    assert not os.listdir(tmp_path / "i" / "stage" / "docs")  # intermediate tables go with the commit
    other = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(4))
    with pytest.raises(ValueError, match="components"):
        other.add_document(write(docs, "c.md", "# Three\n\nA third document with enough words."))


def test_unreachable_folders_and_files_lose_nothing(spark, tmp_path):
    docs = tmp_path / "docs"
    index = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(8))
    a = write(str(docs), "_notes.md", "# One\n\nA first document with enough words.")
    config = {"watch_dirs": [str(docs)], "supported_extensions": [".md"]}
    assert index.sync_from_config(config)["added"] == 1
    docs.rename(tmp_path / "away")
    with pytest.raises(FileNotFoundError):
        index.sync_from_config(config)
    assert index.chunks().count() == 2
    (tmp_path / "away").rename(docs)
    assert index.remove_file(a) == 2 and index.remove_file(a) == 0 and index.chunks().count() == 0
    assert len(index) == 0 and 1 not in index


def test_budget_bounds_the_results(spark, corpus):
    index, _, _ = corpus
    with pytest.raises(ValueError, match="budget"):
        index.search("石油", k=500)
    assert index.search("石油", k=500, budget=500).count() == index.bm25_candidates("石油").count()


def test_many_results_with_a_budget(spark, tmp_path):
    text = "# T\n\n" + "\n\n".join(f"## S{i}\n\nthe words of section number {i} are here" for i in range(300))
    index = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(8))
    index.add_document(write(str(tmp_path / "d"), "a.md", text))
    assert index.search("the words", k=500, budget=700).count() == 500


def test_damaged_index_is_not_created_anew(spark, tmp_path):
    import shutil

    base = tmp_path / "i"
    index = SearchIndex(spark, str(base), HashEmbedder(8))
    index.add_document(write(str(tmp_path / "d"), "a.md", "# One\n\nA first document with enough words."))
    shutil.move(str(base / "commits"), str(tmp_path / "commits"))
    with pytest.raises(ValueError, match="commits"):
        SearchIndex(spark, str(base), HashEmbedder(8))
    shutil.move(str(tmp_path / "commits"), str(base / "commits"))
    again = SearchIndex(spark, str(base), HashEmbedder(8))
    for _ in range(3):
        again.compact()
    assert again.chunks().count() == 2
    assert len([d for d in os.listdir(base / "chunks") if d.startswith("v=")]) <= 3


def test_office_settings_of_sync(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), tmp_path / "tree"
    doc = write(docs, "a.docx", docx_bytes([("Heading 1", [("Head", False, False)]), ("", [("A paragraph that is long enough.", False, False)])]))
    index = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(8))
    config = {"watch_dirs": [docs], "supported_extensions": [".md", ".docx"], "auto_convert_office": False}
    assert index.sync_from_config(config)["added"] == 0
    config |= {"auto_convert_office": True, "converted_md_dir": str(out)}
    assert index.sync_from_config(config)["added"] == 1
    assert sorted(os.listdir(out / "a")) == ["Head.md", "_index.md"] and index.get_by_filepath(doc).count() > 2


def test_sync_sorts_postings_by_portions(spark, tmp_path, monkeypatch):
    """A sync stores packed tables, sorts the postings of a few chunk files at a time and keeps no stage of texts beside the chunks."""
    from loomdex import store as storing
    from loomdex.plans import sync as syncing
    from loomdex.store import Store

    rows = [(f"/docs/a_{i}.md", datetime(2024, 1, 1), 9, f"# head {i}\n\nshared words and rain{i} in a paragraph".encode()) for i in range(40)]
    files = spark.createDataFrame(rows, "file_path string, modified_at timestamp, length long, content binary")
    whole = Store(spark, str(tmp_path / "whole"))
    syncing.ingest(whole, files, HashEmbedder(8))
    seen = []
    write = Store.write_sorted

    def watched(self, table, version, df, mode):
        seen.append({p.name for p in (tmp_path / "parted" / "stage").iterdir() if list(p.glob(f"v={version}"))})
        return write(self, table, version, df, mode)

    monkeypatch.setattr(Store, "write_sorted", watched)
    monkeypatch.setattr(syncing, "FILE_BYTES", 200)
    monkeypatch.setattr(storing, "PORTION_BYTES", 1)
    monkeypatch.setattr(storing, "MAX_PORTIONS", 3)
    parted = Store(spark, str(tmp_path / "parted"))
    syncing.ingest(parted, files, HashEmbedder(8))
    assert 1 < len(seen) <= 3 and not set.union(*seen) & {"docs", "digests", "embedded"}
    for layer in ("postings", "lengths", "chunks"):
        assert sorted(map(str, whole.layer(layer).collect())) == sorted(map(str, parted.layer(layer).collect()))
    assert all(".zstd." in f.name for t in ("chunks", "postings", "vectors") for f in (tmp_path / "parted" / t / "v=1").rglob("*.parquet"))
