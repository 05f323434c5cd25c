"""Explicit schemas of the stored tables and of the intermediate records."""

from __future__ import annotations

from pyspark.sql import types as T

REGISTRY = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("chunk_count", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("error_message", T.StringType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("filepath", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("chunk_order", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("parent_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("department", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

POSTINGS = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("tf", T.LongType()),
        T.StructField("dl", T.LongType()),
        T.StructField("positions", T.ArrayType(T.IntegerType())),
        T.StructField("bucket", T.IntegerType()),
    ]
)

#: Terms that occur in a version, for range scans by their beginning.
TERMS = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

LENGTHS = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("dl", T.LongType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

CODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("low", T.FloatType()),
        T.StructField("step", T.FloatType()),
        T.StructField("err", T.FloatType()),
        T.StructField("planes", T.BinaryType()),
    ]
)

#: Largest weights by term and block of ids, of a compacted version.
BLOCKS = T.StructType(
    [
        T.StructField("field", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("docs", T.LongType()),
        T.StructField("tops", T.ArrayType(T.StructType([T.StructField("tf", T.LongType()), T.StructField("dl", T.LongType())]))),
    ]
)

#: Ids of the chunks of a file in the version that indexed it.
RANGES = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("first_id", T.LongType()),
        T.StructField("last_id", T.LongType()),
    ]
)

REMOVED = T.StructType([T.StructField("doc_id", T.LongType())])

COMMITS = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("added", T.LongType()),
        T.StructField("modified", T.LongType()),
        T.StructField("deleted", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("max_id", T.LongType()),
        T.StructField("floor", T.LongType()),
    ]
)

DOCX_PARTS = """
    paragraphs array<struct<style:string,text:string,runs:array<struct<text:string,bold:boolean,italic:boolean>>>>,
    tables array<struct<headers:array<string>,rows:array<array<string>>>>,
    images array<struct<n:int,ext:string,blob:binary>>,
    error string
"""

PDF_PARTS = """
    pages array<string>,
    outline array<struct<level:int,title:string,page:int>>,
    error string
"""

SECTION = (
    "struct<title:string,content:string,heading_level:int,parent_title:string,"
    "page_range:string,conversion_method:string,metadata:map<string,string>>"
)
