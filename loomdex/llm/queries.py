"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import bpe, chat, clusters, html, merkle, mtree, near_dup, packing, projections, quality, sharding, surrogates, warc
from loomdex.llm.common import read_table
from loomdex.plans.catalog.base import Entry

ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable:
    def add(fn):
        ENTRIES[fn.__name__] = Entry(fn, sql)
        return fn

    return add


#: For the given pages: the article's text; the operator itself knows nothing of this shape.
_ARTICLES = r"""WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(replace(x, '&quot;', '"'), '&amp;?', '&', 'g') AS x FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d"""


@query(_ARTICLES)
def op1_html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = html.extract(read_table(spark, sf, "pages"), "html", into="text")
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_BASE32 = """array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((CAST('0x' || substr(x, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '')"""


@query(
    f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS x FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
)
def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    archives = warc.write_archives(read_table(spark, sf, "pages"), "page_id", "url", "html", min_bytes=0)
    return warc.read_archives(archives).select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


_ESCAPED = "(2 * length({0}) - length(regexp_replace({0}, '[\\\\<\\[\\]]', '', 'g')))"


@query(
    f"""WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text) AS loss,
    CAST(sum(11 + {_ESCAPED.format('role')} + {_ESCAPED.format('text')}) AS BIGINT) AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars, CAST(NULL AS INTEGER) AS rewritten_at FROM g"""
)
def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf, "conversations").select(*extra.columns).union(extra)
    template = chat.TurnTemplate()
    done = chat.read_back(chat.format_conversations(rows, template), template)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "rewritten_at",
    )


@query(
    r"""WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS rep FROM w),
s AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s
  FROM k WHERE doc_id = rep),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
f AS (SELECT t, count(*) AS df FROM t GROUP BY t),
o AS (SELECT doc_id, n, t, row_number() OVER (PARTITION BY doc_id ORDER BY df, t) AS place FROM t JOIN f USING (t)),
pre AS (SELECT * FROM o WHERE place <= n - ceil(n * 0.8) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.t = b.t AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT c.a, c.b, len(x.s) + len(y.s) AS total, len(list_intersect(x.s, y.s)) AS shared FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b),
e AS (SELECT a, b FROM m WHERE 100 * shared >= 80 * (total - shared)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT e2.b, reach.root FROM reach JOIN e2 ON e2.a = reach.id),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
r AS (
  SELECT k.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(k.w) = 0 THEN k.doc_id ELSE component_id END AS component_id
  FROM k JOIN s ON s.doc_id = k.rep JOIN comp ON comp.id = k.rep)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM r"""
)
def op4_chosen_path_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return near_dup.near_duplicates(docs, "doc_id", "text", size=2, percent=80).drop("text_key", "component")


@query()
def op5_robust_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return quality.judge(docs, "text", "lang", "source", keep=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


#: The key of the registered query; a deployment passes its own secret.
SURROGATE_KEY = "query-key"


@query()
def op7_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    return surrogates.replace(docs, "text", SURROGATE_KEY, count="n_replaced").withColumn("n_chars", F.length("text").cast("long"))


_SCALED = """scaled AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


@query(
    f"""WITH {_SCALED}, scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_dot_product(q.v, r.v) AS BIGINT) AS score
  FROM scaled q JOIN scaled r ON q.vec_id % 50 = 0 AND r.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5"""
)
def op6_mtree_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = mtree.usable(read_table(spark, sf, "embeddings"), "vec_id", "embedding", scale=256)
    return mtree.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


@query()
def op8_label_propagation(spark: SparkSession, sf: str) -> DataFrame:
    placed = sharding.shard_documents(read_table(spark, sf, "documents"), "doc_id", "text", shards=24)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "linked",
    )


@query()
def op9_hierarchical_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents")
    pieces = packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"
    )


@query()
def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    decoded = bpe.decode(bpe.encode(docs, "text", ranks, pattern), "token_ids", ranks, pattern)
    return decoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(CAST({value} AS VARCHAR))) || ':' || {value} END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_field_sql, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: crc32 of short ASCII strings, bit by bit.
_CRC32 = """(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _levels_sql(name: str) -> str:
    return f"""{name}(g, up, hs) AS (
  SELECT g, 0, hs FROM {name}_leaves
  UNION ALL
  SELECT g, up + 1, list_transform(range(0, (len(hs) + 1) // 2), lambda i: sha256(hs[2 * i + 1] || coalesce(hs[2 * i + 2], '')))
  FROM {name} WHERE len(hs) > 1)"""


def _steps_sql(tree: str) -> str:
    """Of each leaf: a step per level, ``L`` or ``R`` and the sibling, or nothing."""
    return f"""(SELECT list(CASE WHEN (k >> up) % 2 = 1 THEN 'L' || hs[k >> up] WHEN len(hs) > (k >> up) + 1 THEN 'R' || hs[(k >> up) + 2]
  ELSE '' END ORDER BY up) FILTER (len(hs) > 1) FROM {tree} WHERE {tree}.g IS NOT DISTINCT FROM x.g)"""


_MANIFEST = f"""WITH RECURSIVE d AS (
  SELECT doc_id, lang AS g, {_leaf_sql('n_chars')} AS leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k,
    CASE WHEN xor({_CRC32.format('CAST(doc_id AS VARCHAR)')}, 4294967295) % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS checked
  FROM documents),
low_leaves AS (SELECT g, list(leaf ORDER BY k) AS hs FROM d GROUP BY g),
{_levels_sql('low')},
sub AS (SELECT g AS lang, hs[1] AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS k FROM low WHERE len(hs) = 1),
top_leaves AS (SELECT 0 AS g, list(subroot ORDER BY k) AS hs FROM sub),
{_levels_sql('top')},
r AS (SELECT hs[1] AS root FROM top WHERE len(hs) = 1),
high AS (SELECT lang, subroot, coalesce({_steps_sql('top')}, []) AS steps FROM (SELECT *, 0 AS g FROM sub) x),
s AS (SELECT x.*, subroot, list_concat(coalesce({_steps_sql('low')}, []), high.steps) AS steps FROM d x JOIN high ON high.lang IS NOT DISTINCT FROM x.g),
f AS (SELECT *, list_reduce(list_prepend(checked, steps), lambda a, b: sha256(
    CASE WHEN b = '' THEN a WHEN b[1] = 'L' THEN substr(b, 2) || a ELSE a || substr(b, 2) END)) AS folded_root FROM s)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda b: substr(b, 2)), '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM f, r"""


@query(_MANIFEST)
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]

    def tampered(docs: DataFrame) -> Column:
        touched = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
        values = [F.when(touched, F.try_add("n_chars", F.lit(1))).otherwise(F.col(c)) if c == "n_chars" else F.col(c) for c in fields]
        return merkle.leaf_digest(values)

    proven = merkle.manifest(read_table(spark, sf, "documents"), "lang", "doc_id", fields, tampered)
    return proven.withColumnRenamed("row_id", "doc_id")


def _rounds_sql(rounds: int) -> str:
    """Assignments ``a0`` ... and centroids ``c0`` ... of each round; ``w`` are the vectors, component by component."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT kept.vec_id, kept.n, c{r}.c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM kept, c{r}) GROUP BY ALL)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT c, i, CAST(floor(CAST(sum(kept.v[i]) AS DOUBLE) / count(*)) AS BIGINT) AS x
  FROM a{r} JOIN kept USING (n), range(1, 65) t(i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m.v, c{r}.v) AS v FROM c{r} LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM s{r} GROUP BY c) m USING (c))""")
    return ",\n".join(parts)


_CLUSTERS = f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS n, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM kept
  WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 40)),
{_rounds_sql(5)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.v, ',')) AS centroid_sha256 FROM a5 JOIN c5 USING (c)"""


@query(_CLUSTERS)
def op11_ptolemaic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    vectors = clusters.integer_vectors(read_table(spark, sf, "embeddings"), "vec_id", "embedding", width=64, scale=256)
    found = clusters.cluster(vectors, k=40, rounds=5, seed="2:", width=64)
    return found.withColumn("centroid_sha256", clusters.centroid_digest("centroid")).drop("centroid")


@query()
def op12_stable_projections(spark: SparkSession, sf: str) -> DataFrame:
    rows = projections.usable(read_table(spark, sf, "embeddings"), "vec_id", "embedding")
    return projections.top_k(rows, rows.where("vec_id % 50 = 0"), k=5)
