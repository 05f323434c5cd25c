"""Han words by the most probable path, against a plain dynamic program."""

import collections
import math
import random
import re

from loomdex.operators import words


def plain_path(run, cost, longest):
    best = [(0, ())]
    for j in range(1, len(run) + 1):
        options = []
        for k in range(1, min(j, longest) + 1):
            w = run[j - k : j]
            if w in cost or k == 1:
                options.append((best[j - k][0] + cost.get(w, words.UNKNOWN), -k))
        total, less = min(options)
        best.append((total, (*best[j + less][1], run[j + less : j])))
    return list(best[-1][1])


def test_words_of_runs(spark):
    rng = random.Random(5)
    letters = "的一是不了人我在有他"
    counts = {"".join(rng.choices(letters[:8], k=rng.randint(1, 4))): rng.randint(1, 500) for _ in range(60)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    cost = {r.word: r.cost for r in words.word_costs(table).collect()}
    total = sum(counts.values())
    assert all(cost[w] == round(-math.log(n / total) * words.UNIT) for w, n in counts.items())
    runs = ["".join(rng.choices(letters, k=rng.choice([1, 2, 3, 7, 30]))) for _ in range(80)] + ["".join(rng.choices(letters, k=3000)), "石油", "的"]
    runs = list(dict.fromkeys(runs))
    dictionary = spark.createDataFrame(list(cost.items()), "word string, cost long")
    got = {r.run: r.words for r in words.segment_runs(spark.createDataFrame([(r,) for r in runs], "run string"), dictionary, 4).collect()}
    assert got == {r: plain_path(r, cost, 4) for r in runs}

    texts = [(1, "的一 abc 是不，" + runs[0]), (2, None), (3, "no such characters"), (4, ""), (1, runs[0])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = collections.Counter()
    for i, text in texts:
        for run in re.findall(r"[一-鿿]+", text or ""):
            want.update((i, w) for w in plain_path(run, cost, 4))
    assert {(r.doc_id, r.word): r.tf for r in words.han_words(df, dictionary, longest=4).collect()} == want


def test_cheaper_paths_and_ties(spark):
    dictionary = spark.createDataFrame([("研究", 5), ("研究生", 6), ("生命", 5), ("命", 9), ("起源", 4), ("的", 2), ("的的", 4)], "word string, cost long")
    runs = spark.createDataFrame([("研究生命起源",), ("的的",)], "run string")
    got = {r.run: r.words for r in words.segment_runs(runs, dictionary).collect()}
    assert got == {"研究生命起源": ["研究", "生命", "起源"], "的的": ["的的"]}  # of equal sums the longer last word
    none = spark.createDataFrame([], "word string, cost long")
    assert words.segment_runs(runs, none).where("run = '的的'").first().words == ["的", "的"]


def test_a_small_stored_dictionary_moves_no_pieces(spark, tmp_path):
    """Runs are grouped by one exchange; places and pieces of them are not dealt again."""
    spark.createDataFrame([("的", 5), ("一", 5), ("的一", 7)], "word string, cost long").write.parquet(str(tmp_path / "words"))
    spark.createDataFrame([("的一的",), ("一一",)], "run string").write.parquet(str(tmp_path / "runs"))
    cut = words.segment_runs(spark.read.parquet(str(tmp_path / "runs")), spark.read.parquet(str(tmp_path / "words")), 3)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert {r["run"]: list(r["words"]) for r in cut.collect()} == {"的一的": ["的一", "的"], "一一": ["一", "一"]}
