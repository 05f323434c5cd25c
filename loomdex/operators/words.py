"""Words of Han texts by a dictionary: the most probable path through the lattice of all dictionary words.

The dictionary is a table ``word, cost`` (any whole numbers; small for frequent words, see :func:`word_costs`). Every run of Han
characters is cut so that the sum of its words' costs is least; characters that no word covers cost ``UNKNOWN``. Ties go to the longer
last word.

Distinct runs are segmented once. Their substrings meet the dictionary in one equi-join, so the dictionary may be of any size; the path is a
running fold over the places of a run that keeps the best sums of the last few places, and a second one from the end that follows the
choices back. Both are near-linear in the length of a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.arrays import let, scan_left
from loomdex.functions.text import term_counts
from loomdex.sources.tables import materialize

HAN_RUN = r"\p{IsHan}+"
#: Cost of a character that is no word; more than any word should cost.
UNKNOWN = 30_000_000
#: Costs are millionths of the natural logarithm of the share.
UNIT = 1_000_000
LONGEST = 8


def word_costs(counts: DataFrame) -> DataFrame:
    """``word, n`` -> ``word, cost``: minus the logarithm of each word's share, as a whole number."""
    total = counts.agg(F.sum("n").cast("double").alias("t")).scalar()
    return counts.select("word", F.round(-F.log(F.col("n") / total) * UNIT).cast("bigint").alias("cost"))


def _best_lengths(ends: Column, longest: int) -> Column:
    """For every place the length of the last word of the best path to it. ``ends``: by place, ``array<struct<size,cost>>``."""

    def step(last: Column, words: Column, _: Column) -> tuple[Column, Column]:
        # last: best sums of the places before, the nearest one first; a word of n characters builds on the n-th
        paths = F.transform(
            words, lambda w: F.struct((F.get(last, w["size"] - F.lit(1)) + w["cost"]).alias("sum"), (-w["size"]).alias("less"))
        )
        best = F.array_min(paths)
        return F.slice(F.concat(F.array(best["sum"]), last), 1, longest), -best["less"]

    start = F.array(F.lit(0).cast("bigint"))
    return scan_left(ends, start, step, "int")


def _cuts(lengths: Column) -> Column:
    """The places where words end, from the lengths of the last words: followed from the end back."""
    def step(skip: Column, size: Column, _: Column) -> tuple[Column, Column]:
        # skip: places that the word cut last still covers
        return F.when(skip > 0, skip - 1).otherwise(size - 1), F.when(skip > 0, F.lit(0)).otherwise(size)

    return F.reverse(scan_left(F.reverse(lengths), F.lit(0), step, "int"))


def segment_runs(runs: DataFrame, dictionary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``run`` (distinct) -> ``run, words``: its words in order."""
    pairs = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("place"))
    pieces = pairs.select("run", "place", F.explode(F.sequence(F.lit(1), F.least("place", F.lit(longest)))).alias("size"))
    pieces = pieces.withColumn("word", F.expr("substring(run, place - size + 1, size)"))
    known = dictionary.select("word", F.col("cost").cast("bigint").alias("cost"))
    found = pieces.join(known, "word", "left").where(F.col("cost").isNotNull() | (F.col("size") == 1))
    cost = F.coalesce("cost", F.lit(UNKNOWN).cast("bigint"))
    # one grouping by run, which a small dictionary leaves where its rows are; at most ``longest`` words end at a place
    grouped = found.groupBy("run").agg(F.collect_list(F.struct("place", "size", cost.alias("cost"))).alias("__all"))

    def by_place(rows: Column) -> Column:
        # sorted by place: the words of a place stand in a row from its word of one character on, which every place has
        starts = F.filter(F.transform(rows, lambda r, i: F.when(r["size"] == 1, i)), lambda i: i.isNotNull())

        def cut(starts: Column) -> Column:
            end = lambda k: F.coalesce(F.get(starts, k + F.lit(1)), F.size(rows))
            own = lambda at, k: F.slice(rows, at + F.lit(1), end(k) - at)
            return F.transform(starts, lambda at, k: F.transform(own(at, k), lambda r: F.struct(r["size"], r["cost"])))

        return let(starts, cut)

    paths = grouped.select("run", let(F.sort_array("__all"), by_place).alias("ends"))

    def words(sizes: Column) -> Column:
        cut = F.transform(sizes, lambda size, i: F.when(size > 0, F.substring("run", i + F.lit(2) - size, size)))
        return F.filter(cut, lambda w: w.isNotNull())

    lengths = _best_lengths(F.col("ends"), longest)
    return paths.select("run", let(_cuts(lengths), words).alias("words"))


def han_words(df: DataFrame, dictionary: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """``id_col, word, tf``: words of the Han runs of every text, counted."""
    # equal runs of a text are counted inside its row
    counted = term_counts(F.regexp_extract_all(text_col, F.lit(HAN_RUN), F.lit(0)))
    runs = df.select(id_col, F.inline_outer(counted)).where("term IS NOT NULL").withColumnsRenamed({"term": "run", "tf": "times"})
    # stored: its size is known then, and small tables are sent to the texts
    cut = materialize(segment_runs(runs.select("run").distinct(), dictionary, longest), "runs")
    words = runs.join(cut, "run").select(id_col, "times", F.explode("words").alias("word"))
    return words.groupBy(id_col, "word").agg(F.sum("times").alias("tf"))
