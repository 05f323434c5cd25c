"""Chunk rules on small hand-computed inputs."""

import pytest
from pyspark.sql import functions as F

from loomdex.functions.chunk import ChunkStrategy, document_title
from loomdex.functions.packing import pack
from loomdex.functions.text import paragraphs, query_terms, stem, strip, tokenize
from loomdex.operators.chunking import chunk_table, explode_chunks, link_parents, with_chunks

REPORT = """# 年度总览报告

## 公司介绍

本公司成立于二零一五年，是一家专注于地下水监测的技术企业。
公司总部位于南方某市，拥有员工三百余人。

## 财务

全年营收二亿元，同比增长百分之十八，净利润四千万元，继续保持增长势头。

## 短节

太短。
"""


def chunks_of(spark, content, strategy, path="/d/x.md", **sizes):
    files = spark.createDataFrame([(path, content)], "file_path string, content string")
    rows = explode_chunks(with_chunks(files, strategy, **sizes), "file_path").orderBy("pos").collect()
    return [(r.chunk_type, r.title, r.content, r.chunk_order) for r in rows]


def packed(spark, lengths, limit):
    paras = ["x" * n for n in lengths]
    row = spark.createDataFrame([(paras,)], "p array<string>").select(pack(F.col("p"), limit).alias("c")).first()
    return [len(c) for c in row.c]


def reference_pack(lengths, limit):
    """Independent restatement of the rule on lengths, separators included in the result."""
    out, open_ = [], []
    for n in lengths:
        if n > 2 * limit:
            if open_:
                out.append(sum(open_) + 2 * (len(open_) - 1))
            open_ = []
            out += [min(limit, n - i) for i in range(0, n, limit)]
        elif open_ and sum(open_) + n > limit:
            out.append(sum(open_) + 2 * (len(open_) - 1))
            open_ = [n]
        else:
            open_.append(n)
    return out + ([sum(open_) + 2 * (len(open_) - 1)] if open_ else [])


def test_pack_fixture(spark):
    assert packed(spark, [200, 150, 90, 700, 310, 20], 300) == [200, 242, 300, 300, 100, 310, 20]


@pytest.mark.parametrize("seed", range(6))
def test_pack_matches_restatement(spark, seed):
    import random

    rng = random.Random(seed)
    lengths = [rng.randint(11, 140) for _ in range(rng.choice([0, 1, 255, 256, 257, 700]))]
    assert packed(spark, lengths, 60) == reference_pack(lengths, 60)


def test_hierarchical(spark):
    got = chunks_of(spark, REPORT, ChunkStrategy.HIERARCHICAL)
    assert [(t, o) for t, _, _, o in got] == [("L1", 1), ("L2", 1), ("L1", 2), ("L2", 1), ("L1", 3)]
    assert got[0][1] == "## 公司介绍" and got[1][1] == "## 公司介绍 [段落1]"
    assert got[0][2].startswith("## 公司介绍\n\n本公司")
    assert got[4][2] == "## 短节\n\n太短。"


def test_no_heading_or_no_body_gives_nothing(spark):
    assert chunks_of(spark, "只有文字，没有标题的一段话，足够长。", ChunkStrategy.HIERARCHICAL) == []
    assert chunks_of(spark, "# 标题\n", ChunkStrategy.HIERARCHICAL) == []
    assert chunks_of(spark, "", ChunkStrategy.HIERARCHICAL) == []


def test_fenced_hash_line_splits_too(spark):
    got = chunks_of(spark, "# a\nbody one\n```\n# not a heading\nx = 1\n```", ChunkStrategy.HIERARCHICAL)
    assert [t for _, t, _, _ in got if t.startswith("#") and "[" not in t] == ["# a", "# not a heading"]


def test_flat(spark):
    got = chunks_of(spark, REPORT, ChunkStrategy.FLAT, l1_max=300)
    assert [g[0] for g in got] == ["L1"]
    assert got[0][1] == "公司介绍 [切片1]"


def test_adaptive(spark):
    short = chunks_of(spark, "# t\n\nshort", ChunkStrategy.ADAPTIVE)
    assert short == [("L1", "x", "# t\n\nshort", 1)]
    long = "# a\n\n" + "p" * 40 + "\n\n# b\n\n" + "\n\n".join("q" * 200 for _ in range(3))
    got = chunks_of(spark, long, ChunkStrategy.ADAPTIVE)
    assert [(g[0], g[3]) for g in got] == [("L1", 1), ("L2", 1), ("L2", 2), ("L2", 3)]


@pytest.mark.parametrize(
    "content,path,title",
    [
        ("# x\n## First one \ntext", "/a/b.md", "First one"),
        ("no heading", "/a/油服_20240131_x.md", "2024-01-31"),
        ("no heading", "/a/plain.name.md", "plain.name"),
        ("no heading", "/a/.md", ".md"),
    ],
)
def test_document_title(spark, content, path, title):
    df = spark.createDataFrame([(content, path)], "c string, p string")
    assert df.select(document_title(F.col("c"), F.col("p"))).first()[0] == title


def test_unicode_whitespace(spark):
    df = spark.createDataFrame([("　\xa0 a b \x1c",)], "t string")
    assert df.select(strip(F.col("t"))).first()[0] == "a b"
    df = spark.createDataFrame([("first paragraph\n　\nsecond paragraph\n \n\ntiny",)], "t string")
    assert df.select(paragraphs(F.col("t"))).first()[0] == ["first paragraph", "second paragraph"]


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, wörld 2.67亿元 hello",)], "t string")
    assert df.select(tokenize(F.col("t"))).first()[0] == ["Hello", "wörld", "2", "67", "亿", "元", "hello", "亿元"]
    assert query_terms("石油营收 and 油 and") == ["石油", "油营", "营收", "and", "油"]
    assert query_terms("?!") == []


def test_stem(spark):
    df = spark.createDataFrame([("/a/b.tar.gz",), ("/x/.hidden",), ("plain",), ("/x/..md",)], "p string")
    assert [r[0] for r in df.select(stem(F.col("p"))).collect()] == ["b.tar", ".hidden", "plain", "..md"]


def test_ids_are_dense_and_parents_resolve(spark):
    files = spark.createDataFrame([(f"/d/f{i}.md", REPORT * (1 + i % 3)) for i in range(50)], "file_path string, content string")
    rows = chunk_table(files, start=7).collect()
    assert sorted(r.doc_id for r in rows) == list(range(8, 8 + len(rows)))
    by_id = {r.doc_id: r for r in rows}
    for r in rows:
        if r.chunk_type == "L2":
            parent = by_id[r.parent_id]
            assert parent.chunk_type == "L1" and r.title.startswith(parent.title) and parent.filepath == r.filepath
        else:
            assert r.parent_id is None
    order = sorted(rows, key=lambda r: (r.file_id, r.pos))
    assert [r.doc_id for r in order] == sorted(by_id)


def test_link_parents_equals_arithmetic_parent(spark):
    files = spark.createDataFrame([(f"/d/f{i}.md", REPORT * 4) for i in range(3)], "file_path string, content string")
    rows = explode_chunks(with_chunks(files), "file_path")
    for block_rows in (1, 3, 65536):
        linked = link_parents(rows, block_rows=block_rows).collect()
        for r in linked:
            assert r.parent_pos == (r.pos - r.chunk_order if r.chunk_type == "L2" else None)
