"""Formats, outlines, section assembly, quality and Markdown rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomdex.functions import markdown as md
from loomdex.functions import outline as ol
from loomdex.functions import quality as q
from loomdex.functions.format import detect_format
from loomdex.functions.text import tokenize
from loomdex.operators import outline as rows_outline
from loomdex.plans import convert
from loomdex.plans.catalog.base import NL, PATH_SQL, WORD_SQL, doc_path, documents, query, strip_sql
from loomdex.plans.catalog.docx_fixture import as_docx
from loomdex.sources.tables import read_table, spread

# every fifth line is a heading of level 1..4; the second and third line of each group are bold and italic


def word_documents(spark, sf):
    """``doc_id, file_path, paragraphs``: the whole texts as styled paragraphs, one per line."""

    def paragraph(line, i):
        level = 1 + F.floor(i / 5).cast("int") % 4
        style = F.when(i % 5 == 0, F.concat(F.lit("Heading "), level.cast("string"))).otherwise(F.lit("Normal"))
        run = F.struct(line.alias("text"), (i % 5 == 1).alias("bold"), (i % 5 == 2).alias("italic"))
        return F.struct(style.alias("style"), line.alias("text"), F.array(run).alias("runs"))

    docs = documents(spark, sf, "doc_id", "source", "text")
    path = F.regexp_replace(doc_path(), r"\.md$", ".docx")
    return docs.select("doc_id", path.alias("file_path"), F.transform(F.split("text", "\n"), paragraph).alias("paragraphs"))


_LINES_SQL = f"""lines AS (SELECT doc_id, i-1 AS p, l[i] AS t, len(l) AS total,
  CASE WHEN (i-1) % 5 = 0 AND 1 + ((i-1)//5) % 4 <= 3 THEN 1 + ((i-1)//5) % 4 END AS level
  FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents), unnest(range(1, len(l)+1)) AS u(i))"""
_WORD_SECTIONS_SQL = f"""{_LINES_SQL},
heads AS (SELECT doc_id, p, {strip_sql('t')} AS title, level, total, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS sec_no
  FROM lines WHERE level IS NOT NULL),
spans AS (SELECT h.doc_id, h.sec_no, h.p, h.title, h.level, h.total,
  coalesce(min(CASE WHEN o.p > h.p AND o.level <= h.level THEN o.p END), h.total) AS stop,
  max(CASE WHEN o.p < h.p AND o.level < h.level THEN o.p END) AS parent_p
  FROM heads h JOIN heads o ON o.doc_id = h.doc_id GROUP BY h.doc_id, h.sec_no, h.p, h.title, h.level, h.total),
bodies AS (SELECT s.doc_id, s.sec_no, string_agg(CASE l.p % 5 WHEN 1 THEN '**'||t||'**' WHEN 2 THEN '_'||t||'_' ELSE t END, {NL}||{NL} ORDER BY l.p) AS content
  FROM spans s JOIN lines l ON l.doc_id = s.doc_id AND l.p > s.p AND l.p < s.stop WHERE l.level IS NULL AND {strip_sql('t')} <> '' GROUP BY ALL),
secs AS (SELECT s.doc_id, s.sec_no, s.title, coalesce(b.content, '') AS content, CAST(s.level AS BIGINT) AS heading_level,
  p.title AS parent_title, s.p + 1 AS first, s.stop AS stop, s.total
  FROM spans s LEFT JOIN bodies b USING (doc_id, sec_no) LEFT JOIN heads p ON p.doc_id = s.doc_id AND p.p = s.parent_p)"""


def word_sections(spark, sf):
    """``doc_id, file_path, total_pages, sections`` in the common section record."""
    docs = word_documents(spark, sf)
    raw = docs.select(
        "doc_id",
        "file_path",
        ol.estimated_pages(F.size("paragraphs")).alias("total_pages"),
        ol.sections_from_paragraphs(convert.docx_paragraphs(F.col("paragraphs"))).alias("raw"),
    )
    return raw.select("doc_id", "file_path", "total_pages", "raw", convert.docx_sections(F.col("raw")).alias("sections"))


def _section_rows(df, column, *keep):
    return df.select(*keep, F.posexplode_outer(column).alias("i", "s")).where("i IS NOT NULL").select(
        *keep,
        (F.col("i") + 1).cast("bigint").alias("sec_no"),
        "s.title",
        "s.content",
        F.col("s.heading_level").cast("bigint").alias("heading_level"),
        "s.parent_title",
        F.col("s.start").cast("bigint").alias("first"),
        F.col("s.end").cast("bigint").alias("stop"),
    )


@query(f"WITH {_WORD_SECTIONS_SQL} SELECT doc_id, sec_no, title, content, heading_level, parent_title, first, stop FROM secs")
def section_bodies(spark, sf):
    return _section_rows(word_sections(spark, sf), "raw", "doc_id")


@query(
    f"""WITH {_WORD_SECTIONS_SQL}, n AS (SELECT doc_id, {PATH_SQL} AS path FROM documents)
SELECT replace(path, '.md', '.docx') AS file_path, sec_no, title, content, heading_level, parent_title,
CAST(greatest(1, total // 50 + 1) AS BIGINT) AS total_pages, '1' AS page_range FROM secs JOIN n USING (doc_id)"""
)
def convert_docx(spark, sf):
    """Real Word files built from the texts, read back and sectioned."""
    files = as_docx(word_documents(spark, sf))
    converted = convert.convert_docx(files)
    rows = converted.select("file_path", "total_pages", F.posexplode_outer("sections").alias("i", "s")).where("i IS NOT NULL")
    return rows.select(
        "file_path",
        (F.col("i") + 1).cast("bigint").alias("sec_no"),
        "s.title",
        "s.content",
        F.col("s.heading_level").cast("bigint").alias("heading_level"),
        "s.parent_title",
        F.col("total_pages").cast("bigint").alias("total_pages"),
        "s.page_range",
    )


@query(
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'pdf' WHEN lang = 'fr' THEN 'docx' WHEN starts_with(source, 'src1') THEN 'docx'
WHEN starts_with(source, 'src2') THEN 'pdf' END AS format FROM documents"""
)
def format_detect(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    magic = F.when(F.col("lang") == "de", F.lit("255044462D")).when(F.col("lang") == "fr", F.lit("D0CF11E0A1B1")).otherwise("")
    content = F.concat(F.unhex(magic), F.encode("text", "UTF-8"))
    ext = (
        F.when(F.startswith("source", F.lit("src1")), ".DOCX").when(F.startswith("source", F.lit("src2")), ".pdf").otherwise(".txt")
    )
    return docs.select("doc_id", detect_format(content, F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), ext)).alias("format"))


# outlines over conversation turns: one row per turn


def _outline(spark, sf):
    level = 1 + (F.col("turn") * 7 + F.col("conv_id")) % 3
    return read_table(spark, sf, "conversations").select("conv_id", "turn", level.cast("int").alias("level"))


_OUTLINE_SQL = "o AS (SELECT conv_id, turn, CAST(1 + (turn*7 + conv_id) % 3 AS BIGINT) AS level FROM conversations)"


@query(
    f"""WITH {_OUTLINE_SQL} SELECT a.conv_id, a.turn, a.level, min(CASE WHEN b.turn > a.turn AND b.level <= a.level THEN b.turn END) AS next_pos
FROM o a JOIN o b ON a.conv_id = b.conv_id GROUP BY ALL"""
)
def outline_next(spark, sf):
    rows = rows_outline.next_same_or_higher(_outline(spark, sf), "conv_id", "turn", "level", 3)
    return rows.withColumn("level", F.col("level").cast("bigint"))


@query(
    f"""WITH {_OUTLINE_SQL} SELECT a.conv_id, a.turn, a.level, max(CASE WHEN b.turn < a.turn AND b.level < a.level THEN b.turn END) AS parent_pos
FROM o a JOIN o b ON a.conv_id = b.conv_id GROUP BY ALL"""
)
def outline_parent(spark, sf):
    rows = rows_outline.parents(_outline(spark, sf), "conv_id", "turn", "level", 3)
    return rows.withColumn("level", F.col("level").cast("bigint"))


@query(
    f"""WITH {_OUTLINE_SQL}, t AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN role = 'user' THEN level END AS level
  FROM conversations JOIN o USING (conv_id, turn)),
h AS (SELECT a.conv_id, a.turn, coalesce(min(CASE WHEN b.turn > a.turn AND b.level <= a.level THEN b.turn END), 1000000) AS stop
  FROM t a JOIN t b ON a.conv_id = b.conv_id WHERE a.level IS NOT NULL GROUP BY ALL)
SELECT h.conv_id, h.turn AS section_pos, count(*) AS members, CAST(sum(t.n) AS BIGINT) AS chars
FROM h JOIN t ON t.conv_id = h.conv_id AND t.turn > h.turn AND t.turn < h.stop GROUP BY ALL"""
)
def section_sizes(spark, sf):
    """Interval join: user turns head sections, every later turn inside the interval belongs to them."""
    turns = read_table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.length("text").alias("n"),
        F.when(F.col("role") == "user", (1 + (F.col("turn") * 7 + F.col("conv_id")) % 3).cast("int")).alias("level"),
    )
    members = rows_outline.enclosing_sections(turns, "conv_id", "turn", "level", 3)
    return members.groupBy("conv_id", "section_pos").agg(F.count("*").alias("members"), F.sum("n").alias("chars"))


def _toc_line(line, i):
    words = F.array_join(tokenize(line), " ")
    number = F.concat((i + 1).cast("string"), F.when(i % 3 == 0, F.concat(F.lit("."), (i % 7 + 1).cast("string"))).otherwise(""))
    return F.concat(number, F.lit(" "), words, F.lit(" ..... "), (i + 2).cast("string"))


@query(
    f"""WITH l AS (SELECT doc_id, i, l[i] AS t, array_to_string(regexp_extract_all(l[i], '{WORD_SQL}'), ' ') AS words
  FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents), unnest(range(1, len(l)+1)) AS u(i)),
toc AS (SELECT doc_id, i, {strip_sql("i||CASE WHEN (i-1) % 3 = 0 THEN '.'||((i-1) % 7 + 1) ELSE '' END||' '||words||' ..... '||(i+1)")} AS line FROM l),
m AS (SELECT doc_id, i, regexp_extract(line, '^(\\d+(?:\\.\\d+)*)\\s+([\\p{{L}}\\p{{M}}\\p{{N}}_\\s]+?)\\s+[•·.+]*\\s+(\\d+)$', ['num', 'title', 'page']) AS g FROM toc)
SELECT doc_id, i AS line_no, CAST(least(5, len(string_split(g.num, '.'))) AS BIGINT) AS level, {strip_sql('g.title')} AS title,
CAST(g.page AS BIGINT) - 1 AS page FROM m WHERE g.num <> ''"""
)
def toc_parse(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    # the outer form keeps Spark from adding a filter that reads every line once more
    entries = docs.select("doc_id", F.posexplode_outer(F.transform(F.split("text", "\n"), lambda t, i: ol.toc_entry(_toc_line(t, i)))).alias("i", "e"))
    return entries.where("e IS NOT NULL").select(
        "doc_id",
        (F.col("i") + 1).cast("bigint").alias("line_no"),
        F.col("e.level").cast("bigint").alias("level"),
        "e.title",
        F.col("e.page").cast("bigint").alias("page"),
    )


# paged documents: ten lines make a page

_PAGES_SQL = f"""pg AS (SELECT doc_id, p, array_to_string(l[p*10+1:p*10+10], {NL}) AS t, (len(l)-1)//10+1 AS n
  FROM (SELECT doc_id, string_split(text, {NL}) AS l FROM documents), unnest(range(0, (len(l)-1)//10+1)) AS u(p))"""


def _paged(spark, sf):
    lines = documents(spark, sf, "doc_id", "text").select("doc_id", F.split("text", "\n").alias("l"))
    numbers = F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 10).cast("int"))
    return lines.select("doc_id", F.transform(numbers, lambda p: F.array_join(F.slice("l", p * 10 + 1, 10), "\n")).alias("pages"))


@query(
    f"""WITH {_PAGES_SQL} SELECT doc_id, p + 1 AS sec_no,
coalesce(substr(list_filter(list_transform(string_split(t, {NL}), lambda x: {strip_sql('x')}), lambda x: x <> '')[1], 1, 50), '第'||(p+1)||'页') AS title,
t AS content, CAST(p+1 AS VARCHAR) AS page_range FROM pg"""
)
def pdf_page_sections(spark, sf):
    cut = _paged(spark, sf).select("doc_id", F.posexplode(ol.sections_from_pages(F.col("pages"))).alias("i", "s"))
    return cut.select(
        "doc_id",
        (F.col("i") + 1).cast("bigint").alias("sec_no"),
        "s.title",
        "s.content",
        ol.page_range(F.col("s.start"), F.col("s.end")).alias("page_range"),
    )


@query(
    f"""WITH {_PAGES_SQL}, b AS (SELECT doc_id, p, n, 1 + (p*7 + doc_id) % 3 AS level, 'Part '||p AS title FROM pg),
s AS (SELECT x.doc_id, x.p, x.n, x.level, x.title, coalesce(min(CASE WHEN y.p > x.p AND y.level <= x.level THEN y.p END), x.n) AS stop,
  max(CASE WHEN y.p < x.p AND y.level < x.level THEN y.p END) AS pp FROM b x JOIN b y ON x.doc_id = y.doc_id
  GROUP BY x.doc_id, x.p, x.n, x.level, x.title)
SELECT s.doc_id, s.p + 1 AS sec_no, s.title, coalesce(string_agg(pg.t, {NL}||{NL} ORDER BY pg.p) FILTER ({strip_sql('pg.t')} <> ''), '') AS content,
CAST(s.level AS BIGINT) AS heading_level, CASE WHEN pp IS NOT NULL THEN 'Part '||pp END AS parent_title,
CASE WHEN stop > s.p + 1 THEN (s.p+1)||'-'||stop ELSE CAST(s.p+1 AS VARCHAR) END AS page_range
FROM s LEFT JOIN pg ON pg.doc_id = s.doc_id AND pg.p >= s.p AND pg.p < s.stop
GROUP BY s.doc_id, s.p, s.title, s.level, s.pp, s.stop"""
)
def pdf_bookmark_sections(spark, sf):
    paged = _paged(spark, sf)
    marks = F.transform(
        F.sequence(F.lit(0), F.size("pages") - 1),
        lambda p: F.struct(
            (1 + (p * 7 + F.col("doc_id")) % 3).cast("int").alias("level"),
            F.concat(F.lit("Part "), p.cast("string")).alias("title"),
            (p + 1).alias("page"),
        ),
    )
    sections = convert.pdf_sections(ol.sections_from_pdf(F.col("marks"), F.col("pages")))
    rows = paged.withColumn("marks", marks).select("doc_id", F.posexplode(sections).alias("i", "s"))
    return rows.select(
        "doc_id",
        (F.col("i") + 1).cast("bigint").alias("sec_no"),
        "s.title",
        "s.content",
        F.col("s.heading_level").cast("bigint").alias("heading_level"),
        "s.parent_title",
        "s.page_range",
    )


# quality

@query(
    f"""WITH l AS (SELECT doc_id, i, {strip_sql('l[i]')} = '' AS blank FROM (
  SELECT doc_id, string_split(replace(text, ' the ', repeat({NL}, 3)), {NL}) AS l FROM documents), unnest(range(1, len(l)+1)) AS u(i)),
g AS (SELECT doc_id, blank, i - row_number() OVER (PARTITION BY doc_id, blank ORDER BY i) AS island FROM l),
r AS (SELECT doc_id, island, count(*) AS n FROM g WHERE blank GROUP BY ALL)
SELECT d.doc_id, coalesce(max(n), 0) AS blank_run FROM documents d LEFT JOIN r USING (doc_id) GROUP BY ALL"""
)
def blank_run_max(spark, sf):
    spaced = F.split(F.replace("text", F.lit(" the "), F.lit("\n\n\n")), "\n")
    return documents(spark, sf, "doc_id", "text").select("doc_id", q.longest_blank_run(spaced).cast("bigint").alias("blank_run"))


_GARBLED = "length(regexp_replace({}, '[\\x00-\\x7F\\x{{4E00}}-\\x{{9FFF}}\\x{{3000}}-\\x{{303F}}]', '', 'g'))"


@query(f"SELECT doc_id, {_GARBLED.format('text')} AS garbled, round({_GARBLED.format('text')} / length(text), 6) AS rate FROM documents")
def garbled_rate(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return docs.select("doc_id", q.garbled_chars(F.col("text")).cast("bigint").alias("garbled"), F.length("text").alias("n")).select(
        "doc_id", "garbled", F.round(F.col("garbled") / F.col("n"), 6).alias("rate")
    )


_QUALITY_SQL = f"""{_WORD_SECTIONS_SQL},
ls AS (SELECT doc_id, sec_no, i, {strip_sql('l[i]')} = '' AS blank FROM (SELECT doc_id, sec_no, string_split(content, {NL}) AS l FROM secs),
  unnest(range(1, len(l)+1)) AS u(i)),
num AS (SELECT doc_id, blank, row_number() OVER (PARTITION BY doc_id ORDER BY sec_no, i) AS r FROM ls),
isl AS (SELECT doc_id, blank, r - row_number() OVER (PARTITION BY doc_id, blank ORDER BY r) AS island FROM num),
runs AS (SELECT doc_id, max(n) AS blank_run FROM (SELECT doc_id, island, count(*) AS n FROM isl WHERE blank GROUP BY ALL) GROUP BY ALL),
m AS (SELECT s.doc_id, CAST(sum(length(content)) AS BIGINT) AS total_chars, coalesce(max(r.blank_run), 0) AS blank_run,
  CAST(sum({_GARBLED.format('content')}) AS BIGINT) AS garbled, count(*) AS n, bool_or(heading_level = 1) AS has_top,
  count(DISTINCT heading_level) AS levels, any_value(total) AS total FROM secs s LEFT JOIN runs r USING (doc_id) GROUP BY s.doc_id),
s0 AS (SELECT *, CASE WHEN total_chars > 0 THEN garbled / total_chars ELSE 0.0 END AS rate,
  CASE WHEN total_chars = 0 THEN 0.0 WHEN blank_run > 5 THEN 0.8 ELSE 1.0 END AS score0 FROM m),
s1 AS (SELECT *, CAST((total_chars = 0) AS BIGINT) + CAST((blank_run > 5) AS BIGINT) + CAST((rate > 0.05) AS BIGINT) AS n_issues,
  round((0.5 + CASE WHEN has_top THEN 0.2 ELSE 0 END + CASE WHEN levels > 1 THEN 0.3 ELSE 0 END) * 0.3
  + CASE WHEN total_chars / n BETWEEN 100 AND 5000 THEN 1.0 WHEN total_chars / n < 10 THEN 0.3 ELSE 0.7 END * 0.3 + 0.2 + 0.2, 6) AS score1 FROM s0)"""


@query(
    f"""WITH {_QUALITY_SQL} SELECT doc_id, total_chars, blank_run, garbled, round(rate, 6) AS rate, CAST(score0 AS DOUBLE) AS score,
n_issues, n_issues = 0 AS passed FROM s1"""
)
def quality_stage0(spark, sf):
    checked = word_sections(spark, sf).select("doc_id", q.stage_0(F.col("sections")).alias("c"))
    return checked.select(
        "doc_id",
        "c.total_chars",
        F.col("c.blank_run").cast("bigint").alias("blank_run"),
        "c.garbled",
        F.round("c.garbled_rate", 6).alias("rate"),
        "c.score",
        F.size("c.issues").cast("bigint").alias("n_issues"),
        "c.passed",
    )


@query(f"WITH {_QUALITY_SQL} SELECT doc_id, CAST(score1 AS DOUBLE) AS score FROM s1")
def quality_stage1(spark, sf):
    return word_sections(spark, sf).select("doc_id", F.round(q.stage_1(F.col("sections")), 6).alias("score"))


@query(
    f"""WITH {_QUALITY_SQL} SELECT doc_id, CAST(CASE WHEN n_issues > 0 THEN score0 ELSE score1 END AS DOUBLE) AS score,
CAST(CASE WHEN n_issues > 0 THEN 0 WHEN score1 >= 0.8 THEN 1 WHEN score1 >= 0.5 THEN 2 ELSE 3 END AS BIGINT) AS stage,
n_issues > 0 OR score1 < 0.8 AS needs_fix FROM s1"""
)
def quality_route(spark, sf):
    routed = convert.with_quality(word_sections(spark, sf))
    return routed.select(
        "doc_id", F.col("quality_score").alias("score"), F.col("quality_stage").cast("bigint").alias("stage"), "needs_fix"
    )


# rendering


def sanitize_sql(expr: str) -> str:
    clean = f"regexp_replace({expr}, '[\\\\/:*?\"<>|]', '_', 'g')"
    return strip_sql(f"CASE WHEN length({clean}) > 50 THEN substr({clean}, 1, 47)||'...' ELSE {clean} END")


@query(f"SELECT page_id, {sanitize_sql('url')} AS name, {sanitize_sql('html')} AS long_name FROM pages")
def sanitize_filename(spark, sf):
    pages = spread(read_table(spark, sf, "pages"))
    return pages.select(
        "page_id", md.sanitize_filename(F.col("url")).alias("name"), md.sanitize_filename(F.col("html")).alias("long_name")
    )


@query(
    f"""WITH r AS (SELECT doc_id, list_transform(string_split(text, {NL}), lambda l, i:
  list_transform(range(1, 4), lambda c: CASE WHEN c > (i-1) % 5 THEN '' WHEN c = 2 THEN CAST(len(regexp_extract_all(l, '{WORD_SQL}')) AS VARCHAR) ELSE l END)) AS rows_ FROM documents)
SELECT doc_id, '| first | second | third |'||{NL}||'| --- | --- | --- |'||{NL}||
array_to_string(list_transform(rows_, lambda x: '| '||array_to_string(x, ' | ')||' |'), {NL}) AS body FROM r"""
)
def table_to_markdown(spark, sf):
    """Whole lines as cells, beside their number of words; rows of no to four cells."""
    cells = lambda t: F.array(t, F.size(tokenize(t)).cast("string"), t, t)
    rows = F.transform(F.split("text", "\n"), lambda t, i: F.slice(cells(t), F.lit(1), i % 5))
    headers = F.array(F.lit("first"), F.lit("second"), F.lit("third"))
    return documents(spark, sf, "doc_id", "text").select("doc_id", md.table_markdown(headers, rows).alias("body"))


_NAMED_SQL = f"named AS (SELECT doc_id, regexp_replace(regexp_extract({PATH_SQL}, '[^/]*$'), '\\.md$', '') AS name FROM documents)"
_SECTION_MD_SQL = (
    f"""'---'||{NL}||'source: "'||name||'"'||{NL}||'chapter: "'||title||'"'||{NL}||'level: L'||heading_level||{NL}"""
    f"""||CASE WHEN coalesce(parent_title, '') <> '' THEN 'parent: "'||parent_title||'"'||{NL} ELSE '' END"""
    f"""||'page_range: "1"'||{NL}||'tags: [docx, '||{sanitize_sql('title')}||']'||{NL}||'---'||{NL}||{NL}"""
    f"""||repeat('#', CAST(least(heading_level, 5) AS INTEGER))||' '||title||{NL}||{NL}||content"""
)


@query(f"WITH {_WORD_SECTIONS_SQL}, {_NAMED_SQL} SELECT doc_id, sec_no, {_SECTION_MD_SQL} AS body FROM secs JOIN named USING (doc_id)")
def section_markdown(spark, sf):
    name = convert.stem(F.col("file_path"))
    bodies = F.transform("sections", lambda s: md.section_markdown(s, name))
    return word_sections(spark, sf).select("doc_id", F.posexplode(bodies).alias("i", "body")).select(
        "doc_id", (F.col("i") + 1).cast("bigint").alias("sec_no"), "body"
    )


_INDEX_MD_SQL = (
    f"""'# '||name||{NL}||{NL}||'## 📑 章节导航'||{NL}||{NL}||"""
    f"""string_agg(repeat('  ', CAST(heading_level-1 AS INTEGER))||'- ['||title||']('||repeat('../', CAST(heading_level-1 AS INTEGER))||{sanitize_sql('title')}||'.md)', {NL} ORDER BY sec_no)"""
    f"""||{NL}||{NL}||'## 📊 文档统计'||{NL}||'- **总页数**: '||greatest(1, any_value(total) // 50 + 1)||{NL}||'- **转换方式**: DOCX'||{NL}||'- **章节数**: '||count(*)"""
)


@query(f"WITH {_WORD_SECTIONS_SQL}, {_NAMED_SQL} SELECT doc_id, {_INDEX_MD_SQL} AS body FROM secs JOIN named USING (doc_id) GROUP BY doc_id, name")
def index_markdown(spark, sf):
    page = md.index_markdown(F.col("sections"), convert.stem(F.col("file_path")), F.col("total_pages"), F.lit("docx"))
    return word_sections(spark, sf).select("doc_id", page.alias("body"))


@query(
    f"""WITH {_WORD_SECTIONS_SQL}, {_NAMED_SQL}, f AS (SELECT name, sec_no,
  name||'/'||CASE WHEN heading_level > 1 AND coalesce(parent_title, '') <> '' THEN {sanitize_sql('parent_title')}||'/' ELSE '' END||{sanitize_sql('title')}||'.md' AS rel_path,
  {_SECTION_MD_SQL} AS body FROM secs JOIN named USING (doc_id)
  UNION ALL SELECT name, 0, name||'/_index.md', {_INDEX_MD_SQL} FROM secs JOIN named USING (doc_id) GROUP BY doc_id, name)
SELECT rel_path, body FROM (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY sec_no DESC) AS r FROM f) WHERE r = 1"""
)
def markdown_tree(spark, sf):
    sections = word_sections(spark, sf).withColumn("conversion_method", F.lit("docx"))
    return convert.tree(sections).select("rel_path", "body")
