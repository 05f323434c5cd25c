"""Sections, chunk strategies, ids, titles and identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.functions import identity
from loomdex.functions.chunk import ChunkStrategy, document_title
from loomdex.functions.text import markdown_sections
from loomdex.operators import docstore
from loomdex.operators.chunking import chunk_table, explode_chunks, link_parents, with_chunks
from loomdex.plans.catalog.base import (
    HIERARCHICAL_SQL,
    MD_DOCS_SQL,
    NL,
    SECTIONS_SQL,
    documents,
    file_id_sql,
    md_docs,
    pack_sql,
    paragraphs_sql,
    query,
)

_COLUMNS = ["doc_id", "pos", "chunk_type", "chunk_order", "title", "content"]


def _wide(rows):
    return rows.select(
        "doc_id",
        F.col("pos").cast("bigint").alias("pos"),
        "chunk_type",
        F.col("chunk_order").cast("bigint").alias("chunk_order"),
        "title",
        "content",
    )


def _chunk_rows(spark, sf, strategy):
    return _wide(explode_chunks(with_chunks(md_docs(spark, sf), strategy), "doc_id"))


@query(f"WITH {MD_DOCS_SQL}, {SECTIONS_SQL} SELECT file_path, sec_no, heading, body FROM sections")
def split_sections(spark, sf):
    cut = md_docs(spark, sf).select("file_path", F.posexplode(markdown_sections(F.col("content"))).alias("i", "s"))
    return cut.select("file_path", (F.col("i") + 1).cast("bigint").alias("sec_no"), "s.heading", "s.body")


_TITLE_SQL = (
    "coalesce(CASE WHEN regexp_matches(content, '(?m)^## .+$') THEN trim(substr(regexp_extract(content, '(?m)^## .+$'), 4)) END, "
    "regexp_replace(nullif(regexp_extract(file_path, '\\d{8}'), ''), '(\\d{4})(\\d{2})(\\d{2})', '\\1-\\2-\\3'))"
)


@query(
    f"""WITH RECURSIVE {MD_DOCS_SQL}, whole AS (SELECT doc_id, 1 AS sec_no, content FROM md_docs),
{paragraphs_sql('paras', 'whole', 'content')}, {pack_sql('packed', 'paras', 600)},
titles AS (SELECT doc_id, {_TITLE_SQL} AS dt FROM md_docs)
SELECT doc_id, ord AS pos, 'L1' AS chunk_type, ord AS chunk_order, dt||' [切片'||ord||']' AS title, txt AS content
FROM packed JOIN titles USING (doc_id)"""
)
def chunk_flat(spark, sf):
    return _chunk_rows(spark, sf, ChunkStrategy.FLAT)


@query(
    f"WITH RECURSIVE {HIERARCHICAL_SQL} SELECT src_id AS doc_id, pos, chunk_type, chunk_order, title, content FROM chunk_table"
)
def chunk_hierarchical(spark, sf):
    return _chunk_rows(spark, sf, ChunkStrategy.HIERARCHICAL)


_ADAPTIVE_SQL = f"""{MD_DOCS_SQL}, {SECTIONS_SQL},
long_sections AS (SELECT s.* FROM sections s JOIN md_docs m USING (doc_id) WHERE length(m.content) > 300 AND length(s.body) > 300),
{paragraphs_sql('paras', 'long_sections', 'body')}, {pack_sql('packed', 'paras', 300)},
rows_ AS (
  SELECT doc_id, 1 AS sec_no, 1 AS ord, 'L1' AS chunk_type, 1 AS chunk_order, {_TITLE_SQL} AS title, content
  FROM md_docs WHERE length(content) <= 300
  UNION ALL
  SELECT s.doc_id, sec_no, 1, 'L1', sec_no, heading, heading||{NL}||{NL}||body
  FROM sections s JOIN md_docs m USING (doc_id) WHERE length(m.content) > 300 AND length(body) <= 300
  UNION ALL
  SELECT doc_id, sec_no, ord, 'L2', ord, heading||' [段落'||ord||']', txt FROM packed JOIN sections USING (doc_id, sec_no)),
adaptive AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, ord) AS pos, chunk_type, chunk_order, title, content
  FROM rows_)"""


@query(f"WITH RECURSIVE {_ADAPTIVE_SQL} SELECT * FROM adaptive")
def chunk_adaptive(spark, sf):
    return _chunk_rows(spark, sf, ChunkStrategy.ADAPTIVE)


@query(
    f"""WITH RECURSIVE {_ADAPTIVE_SQL} SELECT doc_id, pos, chunk_type, CASE WHEN chunk_type = 'L2' THEN
last_value(CASE WHEN chunk_type = 'L1' THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) END AS parent_pos FROM adaptive"""
)
def chunk_parent_link(spark, sf):
    rows = _chunk_rows(spark, sf, ChunkStrategy.ADAPTIVE).select("doc_id", "pos", "chunk_type")
    return link_parents(rows, "doc_id")


@query(
    f"""WITH RECURSIVE {HIERARCHICAL_SQL} SELECT chunk_id AS doc_id, file_id, pos, total_chunks, parent_id FROM chunk_table"""
)
def chunk_ids_totals(spark, sf):
    rows = chunk_table(md_docs(spark, sf))
    return rows.select(
        "doc_id",
        "file_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("total_chunks").cast("bigint").alias("total_chunks"),
        "parent_id",
    )


@query(f"WITH RECURSIVE {HIERARCHICAL_SQL} SELECT file_id, chunk_id FROM chunk_table")
def chunk_mapping(spark, sf):
    return docstore.chunk_mapping(chunk_table(md_docs(spark, sf))).select("file_id", F.col("doc_id").alias("chunk_id"))


@query(
    f"""WITH RECURSIVE {HIERARCHICAL_SQL} SELECT coalesce(max(chunk_id), 0) AS max_id, count(DISTINCT file_id) AS files FROM chunk_table"""
)
def max_chunk_id(spark, sf):
    rows = chunk_table(md_docs(spark, sf))
    # every file has exactly one first chunk, so counting those needs no distinct
    return rows.agg(
        F.coalesce(F.max("doc_id"), F.lit(0)).cast("bigint").alias("max_id"), F.count_if(F.col("pos") == 1).alias("files")
    )


@query(f"WITH {MD_DOCS_SQL} SELECT file_path, {_TITLE_SQL} AS title FROM md_docs")
def doc_title(spark, sf):
    return md_docs(spark, sf).select("file_path", document_title(F.col("content"), F.col("file_path")).alias("title"))


@query(
    f"""WITH {MD_DOCS_SQL}, s AS (SELECT file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.md$', '') AS stem FROM md_docs)
SELECT file_path, split_part(stem, '_', 1) AS department,
strftime(try_strptime(regexp_extract(stem, '\\d{{8}}'), '%Y%m%d'), '%Y-%m-%d') AS date FROM s"""
)
def filename_metadata(spark, sf):
    return md_docs(spark, sf).select(
        "file_path",
        identity.name_department(F.col("file_path")).alias("department"),
        identity.name_date(F.col("file_path")).cast("string").alias("date"),
    )


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def file_hash(spark, sf):
    return documents(spark, sf, "doc_id", "text").select(
        "doc_id", identity.content_hash(F.encode("text", "UTF-8")).alias("content_hash")
    )


@query(f"SELECT url, {file_id_sql('url')} AS file_id FROM pages UNION ALL SELECT text, {file_id_sql('text')} FROM benchmark")
def file_id_uuid5(spark, sf):
    urls = spark.read.parquet(f"{sf}/pages.parquet").select("url")
    texts = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("text").alias("url"))
    return urls.unionByName(texts).select("url", identity.file_id(F.col("url")).alias("file_id"))
