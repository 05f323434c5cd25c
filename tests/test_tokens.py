"""Terms cut from batches of texts: the same as by the column expression."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomdex.functions import tokens
from loomdex.functions.text import tokenize
from loomdex.operators import bm25

TEXTS = ["", None, "a", " ", "one two,three", "石油检测 und Öl 石", "々〇 x́y", "𠀀𠀁b𠀂", "a\n石\n石油", "石油", "油abc", "9９٣ \U0001f600​", "z", "é", "the end石"]


def terms_of(texts, **kind):
    found = tokens.cut(pa.array(texts, pa.string()), tokens.classes().table(), **kind)
    words, pairs = iter(found.words.to_pylist()), iter(found.pairs.to_pylist())
    return [[next(words) for _ in range(n)] + [next(pairs) for _ in range(m)] for n, m in zip(found.n_words, found.n_pairs)]


def want_of(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", tokenize(F.col("t")).alias("w")).orderBy("i").collect()
    return [list(r.w or []) for r in rows]


def test_terms_of_texts(spark):
    rng = random.Random(3)
    pool = "ab é9 ,\n石油检𠀀々́"
    texts = TEXTS + ["".join(rng.choices(pool, k=rng.randint(0, 12))) for _ in range(400)]
    assert terms_of(texts) == want_of(spark, texts)
    assert terms_of(["ab c", "", "d", "e"]) == [["ab", "c"], [], ["d"], ["e"]]  # letters at the borders of texts stay apart
    assert terms_of(["石油 a"], pairs=False) == [["石", "油", "a"]] and terms_of([]) == []


def test_classes_of_all_characters(spark):
    """Every character that both sides know is a term of its own, a part of a word, or neither on both sides."""
    table = tokens.classes().table()
    every = [chr(c) for c in range(tokens.CODE_POINTS) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs")]
    texts = [c + c for c in every]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.size(tokenize(F.col("t"))).alias("n")).collect()
    assert [r.t for r in rows if r.n != (0, 1, 3)[table[ord(r.t[0])]]] == []
    assert len(rows) == len(every) > 90000


def test_slices_large_texts_and_bytes_that_are_no_text():
    table = tokens.classes().table()
    for kind in (pa.string(), pa.large_string()):
        part = pa.array(["x y", "a b", None, "石油"], kind).slice(1)
        found = tokens.cut(part, table)
        assert found.words.to_pylist() == ["a", "b", "石", "油"] and list(found.n_words) == [2, 0, 2] and list(found.n_pairs) == [0, 0, 1]
    raw = pa.Array.from_buffers(pa.string(), 3, [None, pa.py_buffer(np.array([0, 3, 6, 9], np.int32)), pa.py_buffer(b"a\xffbc\xe7\x9f\xe7\x9f\xb3")])
    assert tokens.cut(raw, table).words.to_pylist() == ["a", "b", "c", "石"]


def test_runs_of_texts_are_bounded():
    texts = pa.array(["a" * n for n in (3, 0, 9, 1, 1)])
    assert list(tokens.parts(texts, 4)) == [(0, 3), (3, 5)]
    assert list(tokens.parts(texts.slice(2), 1)) == [(0, 1), (1, 2), (2, 3)] and list(tokens.parts(pa.array([], pa.string()))) == []


def test_texts_reach_the_counting_uncut(spark, tmp_path):
    """Terms are no rows of the JVM's: the pattern engine has no part in the plan of the postings."""
    spark.createDataFrame([(1, "a b a 石油 石")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for made in (bm25.postings(df), bm25.positional_postings(df)):
        assert "regexp_extract_all" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r["term"]: (r["tf"], r["dl"], r["positions"]) for r in bm25.positional_postings(df).collect()}
    assert got == {"a": (2, 7, [0, 2]), "b": (1, 7, [1]), "石": (2, 7, [3, 5]), "油": (1, 7, [4]), "石油": (1, 7, [6])}


def test_order_of_numbers():
    for top in (3, 1 << 40, 1 << 62):
        key = np.random.default_rng(1).integers(0, top, 500) // 7 * 7
        assert list(tokens.order_of(key)) == list(np.argsort(key, kind="stable"))
    assert list(tokens.order_of(np.empty(0, np.int64))) == []


def test_lengths_without_terms(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    made = bm25.doc_lengths(df)
    assert "regexp_extract_all" not in made._jdf.queryExecution().executedPlan().toString()
    want = {r.doc_id: r.n for r in df.select("doc_id", F.size(tokenize(F.col("text"))).alias("n")).collect()}
    assert {r.doc_id: r.dl for r in made.collect()} == want and want[1] is None
