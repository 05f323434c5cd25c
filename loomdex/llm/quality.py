"""Quality rules: fixed limits on text statistics, then robust multivariate outliers per language and source.

The statistics of a document make a vector of transformed values. For every stratum (language and source) the
minimum-covariance-determinant estimate gives a centre and a scatter that up to a quarter of bad documents cannot move;
documents far from the centre by Mahalanobis distance are rejected.

The estimate runs over all rows. It starts from coordinatewise medians and deviations and repeats concentration steps:
distances under the present estimate, moments of the ``COVERED`` share of rows that lie nearest, new estimate. A step
is one aggregation: moments are summed per stratum and distance bin, so the nearest share is a choice among a few
hundred summed rows, a stratum with a third of all rows is pre-aggregated like any other, and no quantile is sampled.
Values are rounded to multiples of 1/256; their sums are exact, so results do not depend on the order of rows.

Strata of any size are judged by one rule. Beside every stratum's estimate there is one for its language, over the rows of all its
sources less their centres. A stratum of n rows has its own centre with the weight n / (n + ``CENTRE_ROWS``), its own scatter with
n / (n + ``SCATTER_ROWS``), and its language's with the rest. A language's own estimate is less sure the fewer rows it has: the cutoff
is stretched by 1 + ``WIDEN_ROWS`` / m for a language of m rows, at least by ``SLACK``. Languages are never judged together.

Cases: a null text has no words and fails the base rules; null languages and sources are strata of their own; a language of one
row keeps it; rows of strata without a row that passes the base rules have no distance; repeated rows are judged alike; an empty
table gives no rows. The input's columns come back in a
struct of their own, so their names clash with nothing.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomdex.llm.common import ASCII_SPACE, batch_rows, materialize

SYMBOLS = "#*$%&|<>"
#: Words of the windows in which repetition is counted.
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Share of the rows that a concentration step keeps, steps at most, and the change of the log determinant that ends them.
COVERED = 0.75
STEPS = 12
SETTLED = 1e-6
#: Rows at which a stratum's own centre and its own scatter (three times as many numbers) weigh as much as its language's.
CENTRE_ROWS = 40
SCATTER_ROWS = 200
#: By this the factor is near that of the F distribution's limit to the chi-square one, for as many values as ``VECTOR`` has.
WIDEN_ROWS = 25
#: Name of the stratum of all sources of a language; names of sources begin otherwise.
WHOLE = "*"
#: Bins of the logarithm of the squared distance, per unit.
BINS = 16
#: Probability that a clean document of normal statistics lies within the cutoff; the cutoff is stretched by ``SLACK`` at least.
INSIDE = 0.9999
SLACK = 1.25
#: Transformed statistics and the least spread that counts: many strata have no symbols or repetition at all.
FLOORS = {"v_word": 0.08, "v_symbol": 0.05, "v_upper": 0.06, "v_line": 0.20, "v_repeat": 0.20}
VECTOR = list(FLOORS)

STATISTICS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")]
)


# Statistics of one text


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of ``WINDOW`` words that the text has twice or more, the first one included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)).astype(np.uint64)
    if len(number) == len(words):
        return 0
    # a window's number is exact as long as it fits; else equal hashes are compared word by word
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    base = len(number)
    exact = base**WINDOW < 2**64
    factor = np.uint64(base) if exact else np.uint64(0x9E3779B97F4A7C15)
    key = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        key = key * factor + (ids[i : i + n] if exact else (ids[i : i + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        if not exact:
            key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not exact and same.any():
        left, right = order[:-1][same], order[1:][same]
        same[same] = (windows[left] == windows[right]).all(axis=1)
    twice = np.zeros(n + WINDOW, np.int64)
    hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(twice, hit, 1)
    np.add.at(twice, hit + WINDOW, -1)
    return int((np.cumsum(twice)[: len(words)] > 0).sum())


def text_statistics(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()  # of bytes: the six ASCII blanks only
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, ASCII_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


@F.arrow_udf(STATISTICS)
def statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [text_statistics(t.as_py() or "") for t in batch]
        columns = zip(*rows) if rows else [[] for _ in STATISTICS]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], STATISTICS.fieldNames())


# Vectors


def _rounded(value: Column) -> Column:
    return F.round(value * 256) / 256


def _share(part: str, whole: Column) -> Column:
    """A share on the scale on which its spread does not depend on its size."""
    return _rounded(F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(whole, F.lit(1))))))


def with_vector(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "v_word": _rounded(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))),
            "v_symbol": _share("n_symbols", F.col("word_chars")),
            "v_upper": _share("n_upper", F.col("word_chars")),
            "v_line": _share("n_dup_lines", F.col("n_lines")),
            "v_repeat": _share("n_repeat_words", F.col("n_words")),
        }
    )


def _weight(rows: Column, equal: int) -> Column:
    return rows / (rows + equal)


def with_stratum(df: DataFrame, lang: str, source: str) -> DataFrame:
    """``s_lang, s_source``: the names of a row's stratum (``=`` marks a value)."""
    name = {n: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for n, c in (("s_lang", lang), ("s_source", source))}
    return df.withColumns(name)


def strata(good: DataFrame) -> DataFrame:
    """A row per stratum: ``s_lang, s_source, rows, lang_rows, middle`` (its medians mixed with those of its language)."""

    def medians(names: list[str], rows: str, mark: str) -> DataFrame:  # rounded values have few distinct ones
        found = [F.percentile(v, F.lit(0.5)).alias(f"{mark}{i}") for i, v in enumerate(VECTOR)]
        return good.groupBy(*names).agg(F.count("*").alias(rows), *found)

    both = medians(["s_lang", "s_source"], "rows", "own").join(medians(["s_lang"], "lang_rows", "all"), "s_lang")
    weight = _weight(F.col("rows"), CENTRE_ROWS)
    middle = [_rounded(weight * F.col(f"own{i}") + (1 - weight) * F.col(f"all{i}")) for i in range(len(VECTOR))]
    # stored: the planner sees its size before it moves any rows
    return materialize(both.select("s_lang", "s_source", "rows", "lang_rows", F.array(*middle).alias("middle")), "strata")


# Estimates


def chi2_cdf(x: float, d: int) -> float:
    """By the power series of the incomplete gamma function."""
    a, x = d / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, d) < p else (low, middle)
    return high


#: Scatter of the nearest ``COVERED`` share of normal rows, made good for the share left out.
CONSISTENT = COVERED / chi2_cdf(chi2_quantile(COVERED, len(VECTOR)), len(VECTOR) + 2)
CUTOFF = chi2_quantile(INSIDE, len(VECTOR))

ESTIMATE = "s_lang string, s_source string, rows long, logdet double, centre array<double>, inverse array<double>"


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """Centre and inverse scatter from summed moments; one row per stratum."""
    d = len(VECTOR)
    floor = np.diag([f * f for f in FLOORS.values()])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                n = row.used
                centre = np.array([getattr(row, f"m{i}") for i in range(d)]) / n
                second = np.zeros((d, d))
                for i in range(d):
                    for j in range(i, d):
                        second[i, j] = second[j, i] = getattr(row, f"c{i}_{j}") / n
                scatter = factor * (second - np.outer(centre, centre)) + floor
                out.append(
                    (row.s_lang, row.s_source, row.rows, np.linalg.slogdet(scatter)[1], list(centre), list(np.linalg.inv(scatter).ravel()))
                )
            yield pd.DataFrame(out, columns=["s_lang", "s_source", "rows", "logdet", "centre", "inverse"])

    return sums.mapInPandas(solve, ESTIMATE)


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and absolute deviations; rounded values have few distinct ones, so exact medians need little memory."""
    medians = vectors.groupBy("s_lang", "s_source").agg(
        F.count("*").alias("rows"), *(F.percentile(v, F.lit(0.5)).alias(f"m{i}") for i, v in enumerate(VECTOR))
    )
    # stored tables with a row per stratum: their size is known, so rows of a large stratum stay where they are
    medians = materialize(medians, "medians")
    deviation = (
        vectors.join(medians, ["s_lang", "s_source"])
        .groupBy("s_lang", "s_source")
        .agg(
            F.first("rows").alias("rows"),
            F.array(*(F.first(f"m{i}") for i in range(len(VECTOR)))).alias("centre"),
            *(F.percentile(F.abs(F.col(v) - F.col(f"m{i}")), F.lit(0.5)).alias(f"d{i}") for i, v in enumerate(VECTOR)),
        )
    )
    spread = [F.pow(1.4826 * F.col(f"d{i}"), 2) + f * f for i, f in enumerate(FLOORS.values())]
    inverse = F.array(*(1 / spread[i] if i == j else F.lit(0.0) for i in range(len(VECTOR)) for j in range(len(VECTOR))))
    return deviation.select(
        "s_lang", "s_source", "rows", F.lit(float("inf")).alias("logdet"), "centre", inverse.alias("inverse")
    )


def _distance() -> Column:
    """Squared Mahalanobis distance to the joined estimate."""
    d = len(VECTOR)
    off = [F.col(v) - F.col("centre")[i] for i, v in enumerate(VECTOR)]
    total = F.lit(0.0)
    for i in range(d):
        for j in range(i, d):
            total = total + F.col("inverse")[i * d + j] * off[i] * off[j] * (1 if i == j else 2)
    return F.when(total > 0, total).otherwise(total * 0)  # null without an estimate


def _concentrate(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: the estimate over the nearest ``COVERED`` share of each stratum."""
    d = len(VECTOR)
    products = {f"c{i}_{j}": F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])) for i in range(d) for j in range(i, d)}
    sums = {"used": F.count("*"), **{f"m{i}": F.sum(v) for i, v in enumerate(VECTOR)}, **products}
    binned = (
        vectors.join(estimate.drop("logdet"), ["s_lang", "s_source"])
        .withColumn("bin", F.floor(F.log(_distance() + 1e-6) * BINS))
        .groupBy("s_lang", "s_source", "bin")
        .agg(F.first("rows").alias("rows"), *(c.alias(k) for k, c in sums.items()))
    )
    before = Window.partitionBy("s_lang", "s_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    nearest = binned.withColumn("_before", F.coalesce(F.sum("used").over(before), F.lit(0))).where(
        F.col("_before") < F.ceil(COVERED * F.col("rows"))
    )
    chosen = nearest.groupBy("s_lang", "s_source").agg(F.first("rows").alias("rows"), *(F.sum(k).alias(k) for k in sums))
    return _estimates(chosen, CONSISTENT)


def fit(vectors: DataFrame) -> DataFrame:
    """Estimates of all strata, as a written table; a warning tells the last change of those that have not settled."""
    estimate = materialize(_start(vectors), "mcd-start")
    for _ in range(STEPS):
        following = materialize(_concentrate(vectors, estimate), "mcd-step")
        change = (
            following.join(estimate.select("s_lang", "s_source", F.col("logdet").alias("_old")), ["s_lang", "s_source"])
            .agg(F.max(F.abs(F.col("logdet") - F.col("_old"))))
            .first()[0]
        )
        estimate = following
        if change is None or change < SETTLED:
            break
    else:
        warnings.warn(f"robust estimates changed by {change:.2g} in the last of {STEPS} steps", stacklevel=2)
    return estimate


def mixed(estimate: DataFrame, places: DataFrame) -> DataFrame:
    """``s_lang, s_source, centre, inverse, cutoff`` of every stratum, its own estimate mixed with that of its language."""
    d = len(VECTOR)
    whole = estimate.where(F.col("s_source") == WHOLE)
    whole = whole.select("s_lang", F.col("centre").alias("off"), F.col("inverse").alias("whole"))
    own = estimate.select("s_lang", "s_source", "centre", "inverse")
    joined = places.join(own, ["s_lang", "s_source"]).join(whole, "s_lang")
    joined = joined.withColumns(
        {
            "near": _weight(F.col("rows"), CENTRE_ROWS),
            "wide": _weight(F.col("rows"), SCATTER_ROWS),
            "cutoff": CUTOFF * F.greatest(F.lit(SLACK), 1 + WIDEN_ROWS / F.col("lang_rows")),
        }
    )

    def mix(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                centre = row.near * row.centre + (1 - row.near) * (row.middle + row.off)
                own, whole = (np.linalg.inv(x.reshape(d, d)) for x in (row.inverse, row.whole))
                inverse = np.linalg.inv(row.wide * own + (1 - row.wide) * whole)
                out.append((row.s_lang, row.s_source, list(centre), list(inverse.ravel()), row.cutoff))
            yield pd.DataFrame(out, columns=["s_lang", "s_source", "centre", "inverse", "cutoff"])

    made = "s_lang string, s_source string, centre array<double>, inverse array<double>, cutoff double"
    return materialize(joined.mapInPandas(mix, made), "mixed")


def judge(docs: DataFrame, text: str, lang: str, source: str, keep: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the columns ``keep``, all by default), the statistics, ``base_failed``, ``distance``, ``kept``."""
    row = F.struct(*(F.col(f"`{c}`") for c in (keep or docs.columns)))
    found = docs.select(row.alias("row"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), statistics(text).alias("_s"))
    found = found.select("row", "_lang", "_source", "_s.*")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # written once: the steps read the few columns they need, a lost executor costs a read
    with batch_rows(docs.sparkSession, 1_000):
        stored = materialize(with_vector(found.withColumn("base_failed", base)), "statistics")
    placed = with_stratum(stored, "_lang", "_source")
    good = placed.where("NOT base_failed").select("s_lang", "s_source", *VECTOR)
    places = strata(good)
    off = [(F.col(v) - F.col("middle")[i]).alias(v) for i, v in enumerate(VECTOR)]
    whole = good.join(places, ["s_lang", "s_source"]).select("s_lang", F.lit(WHOLE).alias("s_source"), *off)
    estimate = mixed(fit(materialize(good.unionByName(whole), "vectors")), places)
    judged = placed.join(estimate, ["s_lang", "s_source"], "left").withColumn("distance", _distance())
    outlier = F.coalesce(F.col("distance") > F.col("cutoff"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~outlier).select(
        "row", *STATISTICS.fieldNames(), "base_failed", "distance", "kept"
    )
