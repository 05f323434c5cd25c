"""Scan predicates, snapshot diff, file registry, document store, consistency."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomdex.functions.embed import HashEmbedder
from loomdex.functions.identity import content_hash, file_id
from loomdex.operators import docstore
from loomdex.operators import registry as reg
from loomdex.plans.catalog.base import HIERARCHICAL_SQL, MD_DOCS_SQL, PATH_SQL, documents, file_id_sql, md_docs, query
from loomdex.plans.sync import ingest
from loomdex.sources.files import has_extension, is_ignored
from loomdex.sources.tables import read_table, shared_folder
from loomdex.store import Store

# The two snapshots: the registry was filled before directory src5 appeared and
# before the German files were edited; directory src9 has been deleted since.
NEW_SOURCE, GONE_SOURCE, EDITED_LANG = "src5", "src9", "de"
EXTENSIONS = [".md", ".docx"]
IGNORE = ["src1?", "*.tmp", "draft*"]

_FILE = "'/docs/'||source||'/'||lang||'_'||doc_id||'.md'"
_CUR_SQL = f"""cur AS (SELECT {_FILE} AS file_path, sha256(text) AS content_hash FROM documents WHERE source <> '{GONE_SOURCE}')"""
_PREV_SQL = f"""prev AS (SELECT {_FILE} AS file_path, {file_id_sql(_FILE)} AS file_id,
  sha256(CASE WHEN lang = '{EDITED_LANG}' THEN text||' draft' ELSE text END) AS content_hash,
  CAST(n_chars // 300 AS INTEGER) AS chunk_count,
  CASE WHEN n_chars < 500 THEN 'pending' WHEN l.toxic = 1 THEN 'error' ELSE 'indexed' END AS status,
  CASE WHEN n_chars >= 500 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(n_chars) END AS indexed_at,
  CASE WHEN n_chars >= 500 AND l.toxic = 1 THEN 'conversion failed' END AS error_message
  FROM documents d LEFT JOIN labels l USING (doc_id) WHERE source <> '{NEW_SOURCE}')"""
_OUT_SQL = """file_path, file_id, content_hash, CAST(chunk_count AS BIGINT) AS chunk_count, status,
  strftime(indexed_at, '%Y-%m-%d %H:%M:%S') AS indexed_at, error_message"""


def _path():
    return F.concat(F.lit("/docs/"), "source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))


def current_scan(spark, sf):
    docs = documents(spark, sf, "doc_id", "source", "lang", "text").where(F.col("source") != GONE_SOURCE)
    return docs.select(_path().alias("file_path"), content_hash(F.encode("text", "UTF-8")).alias("content_hash"))


def previous_registry(spark, sf):
    docs = documents(spark, sf, "doc_id", "source", "lang", "text", "n_chars").where(F.col("source") != NEW_SOURCE)
    labels = read_table(spark, sf, "labels").select("doc_id", "toxic")
    old_text = F.when(F.col("lang") == EDITED_LANG, F.concat("text", F.lit(" draft"))).otherwise(F.col("text"))
    tried = F.col("n_chars") >= 500
    failed = tried & F.coalesce(F.col("toxic") == 1, F.lit(False))
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=F.col("n_chars").cast("decimal(18,6)"))
    return docs.join(labels, "doc_id", "left").select(
        _path().alias("file_path"),
        file_id(_path()).alias("file_id"),
        content_hash(F.encode(old_text, "UTF-8")).alias("content_hash"),
        F.floor(F.col("n_chars") / 300).cast("int").alias("chunk_count"),
        F.when(~tried, F.lit("pending")).when(failed, F.lit("error")).otherwise(F.lit("indexed")).alias("status"),
        F.when(tried, stamp).alias("indexed_at"),
        F.when(failed, F.lit("conversion failed")).alias("error_message"),
    )


def _shown(registry):
    return registry.select(
        "file_path",
        "file_id",
        "content_hash",
        F.col("chunk_count").cast("bigint").alias("chunk_count"),
        "status",
        F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"),
        "error_message",
    )


_SCANNED_SQL = """files AS (SELECT source||'/'||lang||'/'||CASE WHEN n_chars < 400 THEN 'draft' ELSE 'f' END||doc_id||
  CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.DOCX' WHEN 'de' THEN '.tmp' ELSE '' END AS rel FROM documents)"""


def _scanned(spark, sf):
    docs = read_table(spark, sf, "documents").select("source", "lang", "n_chars", "doc_id")
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".DOCX").when(F.col("lang") == "de", ".tmp").otherwise("")
    name = F.when(F.col("n_chars") < 400, F.lit("draft")).otherwise(F.lit("f"))
    return docs.select(
        F.concat("source", F.lit("/"), "lang", F.lit("/"), name, F.col("doc_id").cast("string"), ext).alias("rel")
    )


@query(f"WITH {_SCANNED_SQL} SELECT rel FROM files WHERE lower(rel) LIKE '%.md' OR lower(rel) LIKE '%.docx'")
def scan_ext_filter(spark, sf):
    return _scanned(spark, sf).where(has_extension(F.col("rel"), EXTENSIONS))


@query(
    f"""WITH {_SCANNED_SQL} SELECT rel FROM files WHERE NOT regexp_full_match(split_part(rel, '/', 1), 'src1.')
AND NOT ends_with(rel, '.tmp') AND NOT starts_with(split_part(rel, '/', 3), 'draft')"""
)
def scan_ignore_filter(spark, sf):
    return _scanned(spark, sf).where(~is_ignored(F.col("rel"), IGNORE))


_DIFF_SQL = f"""{_CUR_SQL}, {_PREV_SQL}, diff AS (SELECT coalesce(c.file_path, p.file_path) AS file_path,
  CASE WHEN p.file_path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'deleted' WHEN p.content_hash <> c.content_hash THEN 'modified' END AS change
  FROM prev p FULL JOIN cur c ON p.file_path = c.file_path)"""


@query(f"WITH {_DIFF_SQL} SELECT * FROM diff WHERE change IS NOT NULL")
def sync_diff(spark, sf):
    return reg.diff(previous_registry(spark, sf), current_scan(spark, sf))


@query(f"WITH {_DIFF_SQL} SELECT change, count(*) AS files FROM diff WHERE change IS NOT NULL GROUP BY change")
def sync_counts(spark, sf):
    return reg.change_counts(reg.diff(previous_registry(spark, sf), current_scan(spark, sf)))


@query(
    f"""WITH {_CUR_SQL}, {_PREV_SQL}, up AS (SELECT coalesce(c.file_path, p.file_path) AS file_path,
coalesce(p.file_id, {file_id_sql('c.file_path')}) AS file_id, coalesce(c.content_hash, p.content_hash) AS content_hash,
coalesce(p.chunk_count, 0) AS chunk_count, CASE WHEN c.file_path IS NULL THEN p.status ELSE 'pending' END AS status,
CASE WHEN c.file_path IS NULL THEN p.indexed_at END AS indexed_at, CASE WHEN c.file_path IS NULL THEN p.error_message END AS error_message
FROM prev p FULL JOIN cur c ON p.file_path = c.file_path) SELECT {_OUT_SQL} FROM up"""
)
def registry_upsert(spark, sf):
    return _shown(reg.upsert(previous_registry(spark, sf), current_scan(spark, sf)))


@query(
    f"""WITH {_CUR_SQL}, {_PREV_SQL}, done AS (SELECT file_path, length(content_hash) AS n FROM cur WHERE content_hash < '8'),
bad AS (SELECT file_path FROM cur WHERE content_hash >= 'f'), m AS (SELECT p.file_path, p.file_id, p.content_hash,
CASE WHEN d.n IS NOT NULL THEN d.n ELSE p.chunk_count END AS chunk_count,
CASE WHEN b.file_path IS NOT NULL THEN 'error' WHEN d.n IS NOT NULL THEN 'indexed' ELSE p.status END AS status,
CASE WHEN b.file_path IS NOT NULL OR d.n IS NOT NULL THEN TIMESTAMP '2024-06-01 12:00:00' ELSE p.indexed_at END AS indexed_at,
CASE WHEN b.file_path IS NOT NULL THEN 'broken archive' WHEN d.n IS NULL THEN p.error_message END AS error_message
FROM prev p LEFT JOIN done d USING (file_path) LEFT JOIN bad b USING (file_path)) SELECT {_OUT_SQL} FROM m"""
)
def registry_mark(spark, sf):
    scan = current_scan(spark, sf)
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    done = scan.where(F.col("content_hash") < "8").select("file_path", F.length("content_hash").alias("n_chunks"))
    bad = scan.where(F.col("content_hash") >= "f").select("file_path", F.lit("broken archive").alias("error"))
    return _shown(reg.mark_error(reg.mark_indexed(previous_registry(spark, sf), done, now), bad, now))


@query(f"WITH {_CUR_SQL}, {_PREV_SQL} SELECT {_OUT_SQL} FROM prev WHERE file_path NOT IN (SELECT file_path FROM cur)")
def registry_remove(spark, sf):
    return _shown(reg.remove(previous_registry(spark, sf), current_scan(spark, sf)))


@query(f"WITH {_CUR_SQL}, {_PREV_SQL} SELECT file_path FROM prev WHERE file_path NOT IN (SELECT file_path FROM cur)")
def registry_cleanup(spark, sf):
    return reg.deleted_files(previous_registry(spark, sf), current_scan(spark, sf))


@query(f"WITH {_CUR_SQL}, {_PREV_SQL} SELECT {_OUT_SQL} FROM prev WHERE file_path IN (SELECT file_path FROM cur)")
def registry_kept(spark, sf):
    return _shown(reg.keep_scanned(previous_registry(spark, sf), current_scan(spark, sf)))


@query(
    f"""WITH {_PREV_SQL} SELECT count(*) AS total_files, count(*) FILTER (status = 'indexed') AS indexed_count,
count(*) FILTER (status = 'pending') AS pending_count, count(*) FILTER (status = 'error') AS error_count,
CAST(coalesce(sum(chunk_count) FILTER (status = 'indexed'), 0) AS BIGINT) AS total_chunks FROM prev"""
)
def registry_stats(spark, sf):
    return reg.stats(previous_registry(spark, sf))


@query(f"WITH {_PREV_SQL} SELECT {_OUT_SQL} FROM prev WHERE status = 'pending' ORDER BY file_path")
def registry_pending(spark, sf):
    return _shown(reg.pending(previous_registry(spark, sf)))


@query(f"WITH {_PREV_SQL} SELECT {_OUT_SQL} FROM prev WHERE status = 'error' ORDER BY indexed_at DESC, file_path")
def registry_errors(spark, sf):
    return _shown(reg.errors(previous_registry(spark, sf)))


@query(f"WITH {_PREV_SQL} SELECT {_OUT_SQL} FROM prev ORDER BY file_path")
def registry_list(spark, sf):
    return _shown(reg.listing(previous_registry(spark, sf)))


# document store: the documents, with the labelled ones as a batch of new versions


def _store(spark, sf):
    return documents(spark, sf, "doc_id", "text", "source").select(
        "doc_id", F.col("text").alias("content"), F.concat(F.lit("/docs/"), "source").alias("filepath")
    )


_STORE_SQL = "store AS (SELECT doc_id, text AS content, '/docs/'||source AS filepath FROM documents)"


@query(
    f"""WITH {_STORE_SQL}, new AS (SELECT doc_id, 'quality '||quality AS content, '/labels' AS filepath FROM labels)
SELECT * FROM store WHERE doc_id NOT IN (SELECT doc_id FROM new) UNION ALL SELECT * FROM new"""
)
def docstore_upsert(spark, sf):
    new = read_table(spark, sf, "labels").select(
        "doc_id", F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("content"), F.lit("/labels").alias("filepath")
    )
    return docstore.upsert(_store(spark, sf), new)


@query(f"WITH {_STORE_SQL} SELECT doc_id, content FROM store WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def docstore_delete(spark, sf):
    gone = read_table(spark, sf, "labels").where("toxic = 1")
    return docstore.delete(_store(spark, sf), gone).select("doc_id", "content")


@query(f"WITH {_STORE_SQL} SELECT * FROM store WHERE filepath = '/docs/src2' ORDER BY doc_id")
def docstore_by_path(spark, sf):
    return docstore.by_filepath(_store(spark, sf), "/docs/src2")


@query(f"WITH {_STORE_SQL} SELECT count(*) AS n, count(DISTINCT filepath) AS paths, coalesce(max(doc_id), 0) AS max_id FROM store")
def docstore_count(spark, sf):
    return _store(spark, sf).agg(
        F.count("*").alias("n"), F.count_distinct("filepath").alias("paths"), F.coalesce(F.max("doc_id"), F.lit(0)).alias("max_id")
    )


@query(
    """WITH s AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels), v AS (SELECT vec_id AS doc_id FROM embeddings), c AS (
SELECT (SELECT count(*) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM b)) AS missing_in_bm25,
(SELECT count(*) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM s)) AS missing_in_store,
(SELECT count(*) FROM s WHERE doc_id NOT IN (SELECT doc_id FROM v)) AS missing_in_vectors,
(SELECT count(*) FROM v WHERE doc_id NOT IN (SELECT doc_id FROM s)) AS extra_vectors)
SELECT *, missing_in_bm25 + missing_in_store + missing_in_vectors + extra_vectors = 0 AS consistent FROM c"""
)
def consistency_check(spark, sf):
    store = read_table(spark, sf, "documents")
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return docstore.consistency(store, read_table(spark, sf, "labels"), vectors)


@query(
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS type,
'{"k":"'||json_extract_string(props, '$.k')||'","type":"'||event_type||'"}' AS stored FROM events"""
)
def metadata_json_roundtrip(spark, sf):
    events = read_table(spark, sf, "events").select("event_id", "event_type", "props")
    parsed = events.withColumn(
        "m", F.map_concat(docstore.metadata_from_json(F.col("props")), F.create_map(F.lit("type"), F.col("event_type")))
    )
    stored = parsed.select("event_id", docstore.metadata_to_json(F.col("m")).alias("stored"))
    back = stored.withColumn("m", docstore.metadata_from_json(F.col("stored")))
    return back.select("event_id", F.col("m")["k"].cast("bigint").alias("k"), F.col("m")["type"].alias("type"), "stored")


# A whole sync: every document is indexed, then the table is synced as a changed snapshot.
SYNC_GONE, SYNC_EDITED = "src9", "de"
_ADDED = "# Added\n\nA paragraph that the edit has added."
_EDITED_SQL = f"""md_docs AS (SELECT doc_id, file_path, CASE WHEN lang = '{SYNC_EDITED}' THEN content||chr(10)||chr(10)||'# Added'||chr(10)||chr(10)||
  'A paragraph that the edit has added.' ELSE content END AS content FROM (WITH {MD_DOCS_SQL} SELECT * FROM md_docs) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))"""


@query(
    f"""WITH first AS (WITH RECURSIVE {HIERARCHICAL_SQL} SELECT chunk_id, file_path, pos, content FROM chunk_table),
edited AS (WITH RECURSIVE {HIERARCHICAL_SQL.replace(MD_DOCS_SQL, _EDITED_SQL)} SELECT file_id, file_path, pos, content FROM chunk_table),
kind AS (SELECT {PATH_SQL} AS file_path, CASE WHEN source = '{SYNC_GONE}' THEN 'gone' WHEN lang = '{SYNC_EDITED}' THEN 'edited' ELSE 'same' END AS kind FROM documents)
SELECT chunk_id AS doc_id, file_path, CAST(pos AS BIGINT) AS pos, content FROM first JOIN kind USING (file_path) WHERE kind = 'same'
UNION ALL
SELECT (SELECT max(chunk_id) FROM first) + row_number() OVER (ORDER BY file_id, pos), file_path, pos, content FROM edited JOIN kind USING (file_path)
WHERE kind = 'edited'"""
)
def sync_apply(spark, sf):
    """Live chunks after two syncs: one source is deleted and the files of one language are edited between them."""
    files = md_docs(spark, sf, "source", "lang")
    as_files = lambda rows, content: rows.select(
        "file_path", F.lit("2024-01-01").cast("timestamp").alias("modified_at"), F.length(content).cast("bigint").alias("length"), F.encode(content, "UTF-8").alias("content")
    )
    store = Store(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    ingest(store, as_files(files, F.col("content")), HashEmbedder(8))
    edited = F.when(F.col("lang") == SYNC_EDITED, F.concat("content", F.lit("\n\n" + _ADDED))).otherwise(F.col("content"))
    ingest(store, as_files(files.where(F.col("source") != SYNC_GONE), edited), HashEmbedder(8), complete=True)
    return store.layer("chunks").select("doc_id", F.col("filepath").alias("file_path"), F.col("pos").cast("bigint").alias("pos"), "content")
