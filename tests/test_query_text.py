"""Query texts, and clauses answered from the stored postings."""

import contextlib
import io
import random

import pytest
from pyspark.sql import functions as F

from loomdex import SearchIndex
from loomdex.functions import clauses as cl
from loomdex.functions.embed import HashEmbedder
from loomdex.functions.querytext import QuerySyntaxError, parse_query, plain_terms
from loomdex.functions.text import term_positions
from loomdex.operators.bm25 import rank_clause

FIELDS = ("title", "content", "department", "date")


def shown(c):
    if c is None:
        return None
    if c.kind in ("all", "any", "none"):
        return {"all": "&", "any": "|", "none": "!"}[c.kind] + "(" + " ".join(map(shown, c.parts)) + ")"
    ends = ("{" if c.open_low else "[") + f"{c.low} {c.high}" + ("}" if c.open_high else "]")
    return (f"{c.field}:" if c.field else "") + (ends if c.kind == "range" else c.kind[0] + "/" + " ".join(c.words))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a b", "&(t/a t/b)"),
        ("a OR b", "|(t/a t/b)"),
        ("a b OR c", "&(t/a |(t/b t/c))"),
        ("a OR b AND c", "|(t/a &(t/b t/c))"),
        ("a AND b OR c AND d", "|(&(t/a t/b) &(t/c t/d))"),
        ("NOT a b", "&(!(t/a) t/b)"),
        ("a OR NOT b", "|(t/a !(t/b))"),
        ("NOT NOT a", "!(!(t/a))"),
        ("a ANDNOT (b OR c)", "&(t/a !(|(t/b t/c)))"),
        ('"dry season" rain', "&(p/dry season t/rain)"),
        ('"one"', "t/one"),
        ("title:flood* x", "&(title:p/flood t/x)"),
        ("title:(a OR b) c", "&(|(title:t/a title:t/b) t/c)"),
        ("title:OR", "title:t/OR"),
        ("th?n* a*b", "&(w/th?n* w/a*b)"),
        ("foo-bar*", "&(t/foo p/bar)"),
        ("date:[2024-01-01 TO 2024-06-30]", "date:[2024-01-01 2024-06-30]"),
        ("date:{TO 2024-01-01]", "date:{None 2024-01-01]"),
        ("date:[2024-01-01 TO}", "date:[2024-01-01 None}"),
        ("note: this http://x.y", "&(t/note t/this t/http &(t/x t/y))"),
        ("don't", "&(t/don t/t)"),
        ("石油管道", "&(t/石油 t/油管 t/管道)"),
        ('"石油 x"', "p/石 油 x"),
        ("and or", "&(t/and t/or)"),
        ("?! * ()", None),
        ("", None),
        ("!! AND a", "t/a"),
    ],
)
def test_parser(text, want):
    assert shown(parse_query(text, FIELDS)) == want


@pytest.mark.parametrize("text", ["a OR", "AND b", "(a", "a)", '"a', "date:[x]", "date:[ TO ]", "[1 TO 2]", "a AND OR b", "{a", "NOT", "()a)", "a ("])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError, match="position"):
        parse_query(text, FIELDS)


def test_plain_terms():
    assert plain_terms(parse_query("a b-c a")) == ["a", "b", "c"]
    assert plain_terms(parse_query("a b", default="or"), "or") == ["a", "b"]
    assert plain_terms(parse_query("?!")) == []
    assert [plain_terms(parse_query(t)) for t in ("a OR b", "NOT a", "a*", '"a b"')] == [None] * 4
    assert shown(parse_query("a b OR c", default="or")) == "|(t/a |(t/b t/c))"


def test_positions(spark):
    rows = [(["b", "a", "b", "c", "a", "b"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "t array<string>").select(term_positions(F.col("t")).alias("p"))
    got = [[(x.term, x.tf, x.positions) for x in r.p] for r in df.collect()]
    assert got == [[("a", 2, [1, 4]), ("b", 3, [0, 2, 5]), ("c", 1, [3])], [], []]


WORDS = "rain dry season river flood floods flooded bridge road 石油 管道".split()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(7)
    folder = tmp_path_factory.mktemp("docs")
    for i in range(12):
        sections = [f"## {' '.join(rng.choices(WORDS, k=3))}\n\n{' '.join(rng.choices(WORDS, k=rng.randint(3, 30)))} closing words" for _ in range(4)]
        (folder / f"dep{i % 3}_2024{i + 1:02d}15_{i}.md").write_text("# T\n\n" + "\n\n".join(sections), encoding="utf-8")
    made = SearchIndex(spark, str(tmp_path_factory.mktemp("idx") / "i"), HashEmbedder(16))
    made.sync_from_config({"watch_dirs": [str(folder)], "supported_extensions": [".md"]})
    made.remove_file(str(folder / "dep0_20240115_0.md"))
    return made


QUERIES = [
    "rain river",
    "rain OR river",
    '"dry season"',
    '"dry season" NOT flood',
    '"石油 管道" OR "rain rain"',
    "floo* rain",
    "f*d? OR b?idge",
    "NOT rain",
    "NOT (rain OR river) OR title:bridge",
    "title:flood* river",
    'title:"dry season" OR content:"dry season"',
    "department:dep1 river",
    "date:[2024-03-01 TO 2024-07-31] rain",
    "date:{2024-03-15 TO] (rain OR flood)",
    "NOT date:[2024-03-01 TO]",
    "date:[TO 2024-04-15} OR flooded",
    "nothing*",
    "*",
]


@pytest.mark.parametrize("text", QUERIES)
def test_postings_find_what_the_texts_say(index, text):
    clause = parse_query(text, FIELDS)
    got = [tuple(r) for r in index.find(text, 1000).collect()]
    if clause is None:
        assert got == []
        return
    want = [tuple(r) for r in rank_clause(index.chunks(), clause, 1000, text_col="content").collect()]
    assert got == want
    assert got or text in ("nothing*", '"dry season" NOT flood', '"石油 管道" OR "rain rain"')
    assert [tuple(r) for r in index.bm25_candidates(text, limit=1000).collect()] == got


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_plans_read_postings_only(index):
    for text in ('"dry season" NOT flood', "floo* rain", "title:rain"):
        plan = plan_of(index.find(text))
        assert "/chunks" not in plan and "/postings" in plan
        assert "PartitionFilters" in plan and "bucket" in plan
    plan = plan_of(index.find("floo*"))
    assert "/terms" in plan and "GreaterThanOrEqual(term,floo)" in plan and "LessThan(term,flop)" in plan
    assert "dynamicpruning" in plan  # only the buckets of the terms found are read
    ranged = plan_of(index.find("date:[2024-03-01 TO] rain"))
    scan = next(part for part in ranged.split("\n\n") if "/chunks" in part)
    assert "content" not in scan.split("ReadSchema")[1]


def test_searches_take_query_texts(index):
    both = {r.doc_id for r in index.search("rain OR river", k=100, budget=1000).collect()}
    assert both == {r.doc_id for r in index.find("rain OR river", 1000).collect()}
    by_filter = index.bm25_candidates("rain OR river", {"department": "dep1"}, 1000, filter_mode="pre").collect()
    assert by_filter and {r.doc_id for r in by_filter} == {r.doc_id for r in index.find("(rain OR river) department:dep1", 1000).collect()}
    assert {r.doc_id for r in index.bm25_candidates("rain OR river", {"department": "dep1"}, 1000).collect()} == {r.doc_id for r in by_filter}
    with pytest.raises(QuerySyntaxError):
        index.search("rain OR")
    titles = {r.doc_id for r in index.bm25_candidates("flood", field="title", limit=1000).collect()}
    assert titles == {r.doc_id for r in index.find("title:flood", 1000).collect()} != set()


def test_dictionary_survives_compaction(index):
    before = [tuple(r) for r in index.find("floo* OR title:rain", 1000).collect()]
    index.compact()
    assert [tuple(r) for r in index.find("floo* OR title:rain", 1000).collect()] == before
    counts = index.store.terms().groupBy("field", "term").count()
    assert counts.where("count > 1").isEmpty() and not counts.isEmpty()


def test_clause_values():
    clause = cl.all_of(cl.term("a"), cl.in_field("title", cl.any_of(cl.term("b"), cl.phrase("c d"))), cl.none_of(cl.term("e")))
    assert clause.terms == ("a",)
    assert [x.field for x in clause.leaves()] == [None, "title", "title", None]
