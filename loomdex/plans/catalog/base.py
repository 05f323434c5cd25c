"""Query registration and the fixture views both engines derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import WS_CLASS, WS_CODE_POINTS
from loomdex.sources.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL counterpart if SQL can say it."""

    def add(fn: Query) -> Query:
        ENTRIES[fn.__name__] = Entry(fn, sql)
        return fn

    return add


# Spark views


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Documents table, one partition per task slot when the file has too few splits."""
    df = read_table(spark, sf, "documents")
    return spread(df.select(*columns) if columns else df)


def doc_path(root: str = "/docs/") -> Column:
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 366).cast("int")), "yyyyMMdd")
    return F.concat(F.lit(root), "source", F.lit("_"), day, F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))


def marked_lines() -> Column:
    """Lines of a document, every fifth one turned into a heading of level 1, 2, 3, 1, ..."""
    return F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(
            i % 5 == 0, F.concat(F.repeat(F.lit("#"), 1 + F.floor(i / 5).cast("int") % 3), F.lit(" "), line)
        ).otherwise(line),
    )


def md_docs(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """``doc_id, file_path, content``: the whole texts as Markdown files."""
    docs = documents(spark, sf, "doc_id", "source", "text", *extra)
    return docs.select(
        "doc_id", *extra, doc_path().alias("file_path"), F.array_join(marked_lines(), "\n\n").alias("content")
    )


# SQL views

NL = "chr(10)"
WS_SQL = "||".join(f"chr({c})" for c in WS_CODE_POINTS)
PARAGRAPH_BREAK_SQL = r"\n" + WS_CLASS + r"*\n"
WORD_SQL = r"[\p{L}\p{M}\p{N}]+"


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


PATH_SQL = (
    "'/docs/'||source||'_'||strftime(DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER), '%Y%m%d')||'_'||doc_id||'.md'"
)

MD_DOCS_SQL = f"""md_docs AS (
  SELECT doc_id, {PATH_SQL} AS file_path,
    array_to_string(list_transform(string_split(text, {NL}), lambda l, i:
      CASE WHEN (i-1) % 5 = 0 THEN repeat('#', CAST(1 + ((i-1)//5) % 3 AS INTEGER))||' '||l ELSE l END), {NL}||{NL}) AS content
  FROM documents)"""

SECTIONS_SQL = f"""parts AS (
  SELECT doc_id, file_path, string_split(regexp_replace(content, '(?m)^(#{{1,6}} )', chr(1)||'\\1', 'g'), chr(1)) AS p FROM md_docs),
pieces AS (SELECT doc_id, file_path, i, {strip_sql('p[i]')} AS s FROM parts, unnest(range(1, len(p)+1)) AS t(i)),
sections AS (
  SELECT doc_id, file_path, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sec_no,
    {strip_sql(f"split_part(s, {NL}, 1)")} AS heading, {strip_sql(f"substr(s, instr(s, {NL})+1)")} AS body
  FROM pieces WHERE starts_with(s, '#') AND contains(s, {NL}))"""


def paragraphs_sql(name: str, source: str, text: str) -> str:
    """Numbered paragraphs of ``source(doc_id, sec_no, text)``."""
    return f"""{name} AS (
  SELECT doc_id, sec_no, row_number() OVER (PARTITION BY doc_id, sec_no ORDER BY i) AS n, t, length(t) AS len FROM (
    SELECT doc_id, sec_no, i, {strip_sql('b[i]')} AS t FROM (
      SELECT doc_id, sec_no, regexp_split_to_array({text}, '{PARAGRAPH_BREAK_SQL}') AS b FROM {source}),
      unnest(range(1, len(b)+1)) AS u(i))
  WHERE length(t) > 10)"""


def pack_sql(name: str, paras: str, limit: int) -> str:
    """Greedy packing: ``name(doc_id, sec_no, ord, txt)``. Needs WITH RECURSIVE."""
    opens = f"(s.size = 0 OR s.size + p.len > {limit})"
    return f"""{name}_state AS (
  SELECT doc_id, sec_no, n, 1 AS grp, CASE WHEN len > {2 * limit} THEN 0 ELSE len END AS size FROM {paras} WHERE n = 1
  UNION ALL
  SELECT p.doc_id, p.sec_no, p.n, s.grp + CASE WHEN {opens} THEN 1 ELSE 0 END,
    CASE WHEN p.len > {2 * limit} THEN 0 WHEN {opens} THEN p.len ELSE s.size + p.len END
  FROM {name}_state s JOIN {paras} p ON p.doc_id = s.doc_id AND p.sec_no = s.sec_no AND p.n = s.n + 1),
{name}_groups AS (
  SELECT doc_id, sec_no, grp, string_agg(t, {NL}||{NL} ORDER BY n) AS txt, count(*) AS members
  FROM {name}_state JOIN {paras} USING (doc_id, sec_no, n) GROUP BY ALL),
{name} AS (
  SELECT doc_id, sec_no, row_number() OVER (PARTITION BY doc_id, sec_no ORDER BY grp, k) AS ord,
    CASE WHEN members = 1 AND length(txt) > {2 * limit} THEN substr(txt, k*{limit}+1, {limit}) ELSE txt END AS txt
  FROM {name}_groups, unnest(range(0, CASE WHEN members = 1 AND length(txt) > {2 * limit}
    THEN (length(txt)-1)//{limit}+1 ELSE 1 END)) AS u(k))"""


def file_id_sql(path: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')||encode({path}))"
    nibble = f"substr('89ab', (instr('0123456789abcdef', substr({h},17,1))-1) % 4 + 1, 1)"
    return (
        f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||{nibble}||substr({h},18,3)||'-'||substr({h},21,12))"
    )


HIERARCHICAL_SQL = f"""{MD_DOCS_SQL}, {SECTIONS_SQL}, {paragraphs_sql('paras', 'sections', 'body')}, {pack_sql('packed', 'paras', 300)},
chunk_rows AS (
  SELECT doc_id, sec_no, 0 AS ord, 'L1' AS chunk_type, sec_no AS chunk_order, heading AS title, heading||{NL}||{NL}||body AS content
  FROM sections
  UNION ALL
  SELECT doc_id, sec_no, ord, 'L2', ord, heading||' [段落'||ord||']', txt FROM packed JOIN sections USING (doc_id, sec_no)),
chunks AS (
  SELECT file_path, doc_id AS src_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, ord) AS pos,
    chunk_type, chunk_order, title, content, sec_no, ord
  FROM chunk_rows JOIN (SELECT doc_id, file_path FROM md_docs) USING (doc_id)),
ids AS (
  SELECT *, {file_id_sql('file_path')} AS file_id, count(*) OVER (PARTITION BY src_id) AS total_chunks FROM chunks),
chunk_table AS (
  SELECT *, row_number() OVER (ORDER BY file_id, pos) AS chunk_id,
    CASE WHEN chunk_type = 'L2' THEN row_number() OVER (ORDER BY file_id, pos) - ord END AS parent_id FROM ids)"""


def bm25_sql(corpus: str, terms: list[str], limit: int | None, mode: str = "and", id_col: str = "doc_id", text: str = "text") -> str:
    """CTEs ``tok``, ``bm`` (ranked ids with score) over ``corpus``."""
    score = "0.0"
    for i, _ in enumerate(terms):
        idf = f"(ln(n / (df{i} + 1.0)) + 1.0)"
        score = f"({score} + {idf} * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avg_dl)))"
    tfs = ", ".join(
        f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(terms)
    )
    dfs = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS df{i}" for i, _ in enumerate(terms))
    cond = (" AND " if mode == "and" else " OR ").join(f"tf{i} > 0" for i, _ in enumerate(terms))
    tail = f"ORDER BY bm25 DESC, {id_col} LIMIT {limit}" if limit is not None else ""
    return f"""tok AS (SELECT {id_col}, CAST(len(w) AS DOUBLE) AS dl, {tfs} FROM (
    SELECT {id_col}, regexp_extract_all({text}, '{WORD_SQL}') AS w FROM {corpus})),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS avg_dl, {dfs} FROM tok),
bm AS (SELECT {id_col}, round({score}, 9) AS bm25 FROM tok, st WHERE {cond} {tail})"""


def cosine_sql(a: str, b: str) -> str:
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"list_dot_product({da}, {db}) / (sqrt(list_dot_product({da}, {da})) * sqrt(list_dot_product({db}, {db})))"
