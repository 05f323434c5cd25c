"""Shape of the physical plans that matter at scale."""

import os

import pytest
from pyspark.sql import functions as F

from loomdex import SearchIndex
from loomdex.functions.identity import name_department
from loomdex.functions.embed import HashEmbedder
from loomdex.operators import bm25
from loomdex.operators.chunking import chunk_table
from loomdex.operators.vector import rank_allowed
from loomdex.plans.hybrid import candidates


def plan(df, mode="simple"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


def final_plan(df):
    df.collect()
    return plan(df)


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rows = [(i, f"the word{i % 7} of number {i}", f"/d/dep{i % 3}_{i}.md") for i in range(200)]
    path = str(tmp_path_factory.mktemp("t") / "texts")
    spark.createDataFrame(rows, "doc_id long, text string, file_path string").repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def test_texts_are_scanned_once_and_ranking_is_a_top_k(texts):
    p = final_plan(bm25.rank_texts(texts, "the of", 10))
    assert "ReusedExchange" in p and "TakeOrderedAndProject(limit=10" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p  # file_path is pruned


def test_postings_need_no_exchange(texts):
    assert "Exchange" not in plan(bm25.postings(texts))


def test_filter_stays_above_the_candidate_limit(texts):
    df = texts.select("doc_id", "text", name_department(F.col("file_path")).alias("department"))
    p = plan(candidates(df, "the", 3, {"department": "dep2"}, text_col="text"), "extended")
    optimized = p.split("Optimized Logical Plan")[1].split("Physical Plan")[0]
    assert optimized.index("Filter") < optimized.index("Limit")


def test_allow_list_join_is_below_the_score(spark, texts):
    vectors = texts.select("doc_id", F.array(F.lit(1.0), F.col("doc_id").cast("double")).cast("array<float>").alias("embedding"))
    p = plan(rank_allowed(vectors, texts.limit(50), F.array(F.lit(1.0), F.lit(0.5)), 5))
    assert "TakeOrderedAndProject(limit=5" in p
    assert p.index("zip_with") < p.index("LeftSemi")  # the plan prints parents first


def test_ids_come_without_a_global_sort_or_a_broadcast_of_texts(spark, tmp_path):
    rows = [(f"/d/{i}.md", f"# H{i}\n\n" + "some words here " * 20) for i in range(300)]
    path = str(tmp_path / "files")
    spark.createDataFrame(rows, "file_path string, content string").repartition(4).write.parquet(path)
    p = final_plan(chunk_table(spark.read.parquet(path)))
    assert "ShuffledHashJoin" in p and "ReusedExchange" in p
    final = p.split("Initial Plan")[0]
    # the only single-task exchange sits on the bucket totals, above their aggregation
    assert final.count("Exchange SinglePartition") == 1
    assert "HashAggregate(keys=[__bucket" in final.split("Exchange SinglePartition")[1].split("Exchange")[0]


def test_stored_index_prunes_buckets_ids_and_columns(spark, tmp_path):
    os.makedirs(tmp_path / "d")
    for i in range(3):
        (tmp_path / "d" / f"{i}.md").write_text(f"# T\n\nthe words of file number {i} are here\n", "utf-8")
    index = SearchIndex(spark, str(tmp_path / "i"), HashEmbedder(8))
    index.sync_from_config({"watch_dirs": [str(tmp_path / "d")]})
    p = plan(index.bm25_candidates("the of"), "formatted")
    scan = next(s for s in p.split("\n(") if "postings" in s and "Scan parquet" in s)
    assert "bucket" in scan.split("PartitionFilters")[1].split("\n")[0]
    assert "In(term" in scan or "Or(EqualTo(term" in scan or "EqualTo(term" in scan
    p = plan(index.chunks().where(F.col("doc_id") == 2).select("title"), "formatted")
    scan = next(s for s in p.split("\n(") if "chunks" in s and "Scan parquet" in s)
    assert "EqualTo(doc_id,2)" in scan and "content" not in scan.split("ReadSchema")[1].split("\n")[0]


def test_texts_reach_the_model_once(texts):
    from loomdex.functions.embed import embed_rows
    from loomdex.operators.vector import rank_all

    for df in (
        embed_rows(texts, HashEmbedder(8), text_col="text"),
        rank_all(texts.select("doc_id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding")), [1.0, 0.5], 3),
    ):
        assert plan(df).count("MapInArrow") == 1 and "ArrowEvalPython" not in plan(df)


def test_context_does_not_move_chunks(spark, tmp_path):
    from loomdex.plans.hybrid import with_context

    rows = [(i, "/f.md", "L2" if i % 3 else "L1", f"text {i}", f"t{i}", i - i % 3 if i % 3 else None) for i in range(300)]
    path = str(tmp_path / "chunks")
    spark.createDataFrame(rows, "doc_id long, filepath string, chunk_type string, content string, title string, parent_id long").write.parquet(path)
    hits = spark.createDataFrame([(4, 0.5), (6, 0.4)], "doc_id long, score double")
    p = final_plan(with_context(hits, spark.read.parquet(path)))
    assert "SortMergeJoin" not in p and p.split("Initial Plan")[0].count("BroadcastHashJoin") == 4
    assert "hashpartitioning(doc_id" not in p


def test_vectors_without_score_take_no_place(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    for got in (rank_allowed(vectors, vectors, F.array(F.lit(1.0), F.lit(0.0)), 2),):
        assert [r.doc_id for r in got.collect()] == [1, 4]


def test_stored_chunks_are_numbered_with_one_exchange_of_texts(spark, tmp_path):
    from loomdex.operators.chunking import number_chunks, with_chunks
    from loomdex.functions import identity

    rows = [(f"/d/{i}.md", f"# H{i}\n\n" + "some words here " * 20) for i in range(300)]
    files = spark.createDataFrame(rows, "file_path string, content string").withColumn("file_id", identity.file_id(F.col("file_path")))
    path = str(tmp_path / "staged")
    staged = with_chunks(files).withColumn("metas", F.lit(None).cast("array<map<string,string>>"))
    staged.select("file_path", "file_id", "total_chunks", "chunks", "metas").write.parquet(path)
    numbered = number_chunks(spark.read.parquet(path), start=5)
    final = final_plan(numbered).split("Initial Plan")[0]
    assert final.count("rangepartitioning") == 1 and "SortMergeJoin" not in final and "ShuffledHashJoin" not in final
    got = numbered.orderBy("file_id", "pos").select("doc_id").collect()
    assert [r.doc_id for r in got] == list(range(6, 6 + len(got)))
