"""Prefixes and wildcards on stored postings: one scan for all of a clause, and nothing stored that no clause asks for."""

import random

import pytest
from pyspark.sql import functions as F

from loomdex.functions import clauses as cl
from loomdex.operators import bm25
from loomdex.operators.lookup import rank_clause_postings
from loomdex.plans import index
from loomdex.plans.catalog import search
from loomdex.sources.tables import materialize

CLAUSES = [
    cl.prefix("ab"),
    cl.wildcard("a*a"),  # begins and ends with the letter, but is not the letter alone
    cl.wildcard("?b*"),
    cl.wildcard("*"),
    cl.any_of(cl.term("abb"), cl.prefix("a"), cl.wildcard("a?b")),  # a word that is asked for by itself and by both patterns
    cl.all_of(cl.term("ab"), cl.prefix("b")),
    cl.all_of(cl.phrase("ab ba"), cl.any_of(cl.wildcard("b*b"), cl.in_field("title", cl.prefix("a")))),
    cl.all_of(cl.term("a"), cl.none_of(cl.wildcard("b*a"), cl.prefix("aa"))),
    cl.none_of(cl.prefix("a")),
    cl.all_of(cl.phrase("a b"), cl.term("b")),
    cl.term("zzz"),
    cl.prefix("zzz"),
]


@pytest.fixture(scope="module")
def stored(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 4)))
    text = lambda most: " ".join(word() for _ in range(rng.randint(0, most)))
    rows = spark.createDataFrame([(i, text(2), text(9)) for i in range(300)] + [(900, "a", None)], "doc_id long, title string, content string")
    post = materialize(index.postings_table(rows), "postings")
    return rows, post, index.terms_table(post), index.lengths_table(rows)


def found(stored, clause):
    rows, post, dictionary, lengths = stored
    stats = lengths.where("field = 'content'").agg(F.count("*"), F.avg(F.coalesce("dl", F.lit(0)))).first()
    return rank_clause_postings(post, dictionary, lengths, clause, None, float(stats[0]), stats[1])


@pytest.mark.parametrize("at", range(len(CLAUSES)))
def test_patterns_find_what_the_texts_say(stored, at):
    want = bm25.rank_clause(stored[0], CLAUSES[at], None, text_col="content").collect()
    assert sorted(map(tuple, found(stored, CLAUSES[at]).collect())) == sorted(map(tuple, want))


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["), df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_all_patterns_of_a_clause_share_their_scans(stored):
    """The dictionary (here the postings themselves) and the postings are read once each, however many patterns there are."""
    one, three = cl.prefix("ab"), cl.any_of(cl.prefix("ab"), cl.wildcard("b*a"), cl.wildcard("b*a?"))
    assert scans(found(stored, one)) == scans(found(stored, three))


def test_frequencies_read_the_scored_terms_only(stored):
    """Patterns are not scored: neither they nor the dictionary take part in the frequencies of the words."""
    clause = cl.all_of(cl.term("ab"), cl.prefix("b"))
    plan = found(stored, clause)._jdf.queryExecution().optimizedPlan().toString()
    joins = plan.count("Join Inner")
    assert joins == 1, plan


def test_rows_of_a_part_ascend_by_term(spark):
    rows = spark.createDataFrame([(1, "b a c"), (2, "é c 石油 a a")], "doc_id long, text string").coalesce(1)
    for made in (bm25.postings(rows), bm25.positional_postings(rows)):
        got = [(r["term"], r["doc_id"], r["tf"]) for r in made.collect()]
        assert got == sorted(got, key=lambda r: (r[0].encode(), r[1])) and ("a", 2, 2) in got and ("石油", 2, 1) in got


def test_nothing_is_stored_that_no_clause_looks_at(spark, monkeypatch):
    stored_tables = {}

    def keep(df, name):
        stored_tables[name] = materialize(df, name)
        return stored_tables[name]

    monkeypatch.setattr(search, "materialize", keep)
    rows = spark.createDataFrame([(1, "t", "a b"), (2, "t", None), (3, "u", "a thin")], "doc_id long, title string, content string")
    search._stored_index(spark, None, rows, [cl.all_of(cl.term("a"), cl.prefix("thin"))])
    assert {(r["field"], r["term"], r["doc_id"], r["positions"]) for r in stored_tables["postings"].collect()} == {
        ("content", "a", 1, None), ("content", "b", 1, None), ("content", "a", 3, None), ("content", "thin", 3, None)
    }
    assert {(r["doc_id"], r["dl"]) for r in stored_tables["lengths"].collect()} == {(1, 2), (2, None), (3, 2)}
    search._stored_index(spark, None, rows, [cl.all_of(cl.phrase("a b"), cl.in_field("title", cl.term("t")))])
    placed = {(r["field"], r["term"], r["doc_id"]): r["positions"] for r in stored_tables["postings"].collect()}
    assert placed["content", "b", 1] == [1] and placed["title", "u", 3] == [0] and len(placed) == 7
