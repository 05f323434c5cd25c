"""BM25 over text columns or over a stored postings table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.clauses import Clause
from loomdex.functions.text import query_terms, term_counts, tokenize
from loomdex.functions.tokens import classes, count, cut, order_of, parts

# BM25 parameters.
K1 = 1.2
B = 0.75
MAX_CANDIDATES = 100
SCORE_DIGITS = 9
#: Terms that are sorted together.
PART_TERMS = 1 << 18
#: Bytes of text that a term takes at least, its gap included, in most texts.
TERM_BYTES = 4


def candidate_budget(k: int, budget: int | None = None) -> int:
    """Candidates a search re-ranks: ``budget``, by default ten per result and 100 at most."""
    limit = min(10 * k, MAX_CANDIDATES) if budget is None else budget
    if limit < k:
        raise ValueError(f"{limit} candidates cannot give {k} results: pass a budget of {k} or more")
    return limit


def doc_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, dl``: the number of terms of every text, null where the text is null; counted batch by batch, no term is made."""
    kinds, size = classes(), PART_TERMS * TERM_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kinds.table()
        for batch in batches:
            ids, texts = batch.columns
            for at, end in parts(texts, size):
                some = texts.slice(at, end - at)
                dl = pa.array(count(some, table), pa.int64(), mask=some.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), dl], [id_col, "dl"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("__t")).mapInArrow(run, f"`{id_col}` {kind}, dl bigint")


class Part(NamedTuple):
    """Counted terms of a run of texts, ascending by term and text: a posting has a number of a term, a text, a frequency and places."""

    terms: pa.Array
    dl: np.ndarray
    codes: np.ndarray
    row: np.ndarray
    tf: np.ndarray
    first: np.ndarray
    places: np.ndarray


def count_part(texts: pa.Array, table: np.ndarray, *, positions: bool) -> Part:
    """Terms of a run of texts, by one sort of term numbers; with ``positions`` a posting's places are the ``tf`` ones from ``first`` on."""
    found = cut(texts, table)
    dl = found.n_words + found.n_pairs
    coded = pa.concat_arrays([found.words, found.pairs]).dictionary_encode()
    ascending = pc.array_sort_indices(coded.dictionary)
    rank = np.empty(len(ascending), np.int64)
    rank[ascending.to_numpy()] = np.arange(len(ascending))
    row = np.concatenate([np.repeat(np.arange(len(dl)), n) for n in (found.n_words, found.n_pairs)])
    key = rank[coded.indices.to_numpy(zero_copy_only=False)] * len(dl) + row
    n_keys = len(ascending) * len(dl)
    first = places = np.empty(0, np.int64)
    if not positions and n_keys <= 4 * len(key):  # few terms, each of them often: counted without a sort
        tf = np.bincount(key, minlength=n_keys)
        keys = np.flatnonzero(tf)
        tf = tf[keys]
    else:
        order = order_of(key)  # equal keys keep their order: positions ascend
        in_order = key[order]
        first = np.flatnonzero(np.diff(in_order, prepend=-1))
        keys, tf = in_order[first], np.diff(np.append(first, len(key)))
        if positions:  # pairs are counted behind all words of their text
            opens = (np.cumsum(n) - n for n in (found.n_words, found.n_pairs))
            place = [np.arange(n.sum()) - np.repeat(o - d, n) for n, o, d in zip((found.n_words, found.n_pairs), opens, (0, found.n_words))]
            places = np.concatenate(place)[order]
    codes, row = np.divmod(keys, len(dl))
    return Part(coded.dictionary.take(ascending), dl, codes, row, tf, first, places)


def _counted(df: DataFrame, id_col: str, text_col: str, positions: bool) -> DataFrame:
    """``id_col, dl, term, tf`` and with ``positions`` the places of every term of every text.

    An Arrow node cuts whole texts into terms and sorts the numbers of some texts' terms at once. A batch is worked on in parts of
    about ``PART_TERMS`` terms. The rows of a part ascend by term, so that a stored table is skipped page by page when few terms are sought.
    """
    kinds, size = classes(), PART_TERMS * TERM_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kinds.table()
        for batch in batches:
            ids, texts = batch.columns
            for at, end in parts(texts, size):
                some = count_part(texts.slice(at, end - at), table, positions=positions)
                columns = [ids.slice(at, end - at).take(pa.array(some.row)), pa.array(some.dl[some.row])]
                columns += [some.terms.take(pa.array(some.codes)), pa.array(some.tf.astype(np.int64))]
                if positions:
                    ends = np.append(some.first, len(some.places))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(some.places, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "dl", "term", "tf", "positions"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    made = f"`{id_col}` {kind}, dl bigint, term string, tf bigint" + (", positions array<int>" if positions else "")
    return df.select(id_col, F.col(text_col).alias("__t")).mapInArrow(run, made)


def postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: Sequence[str] | None = None) -> DataFrame:
    """``doc_id, dl, term, tf``, of all terms or of the given ones; ``dl`` is the length of the whole text. Needs no shuffle."""
    if terms is None:
        return _counted(df, id_col, text_col, positions=False)
    tokens = df.select(F.col(id_col), tokenize(F.col(text_col)).alias("__t"))
    # the length is taken before the explode: next to it, every row would drag the array along
    wanted = term_counts(F.filter("__t", lambda t: t.isin(list(terms))))
    sized = tokens.select(id_col, F.size("__t").cast("bigint").alias("dl"), wanted.alias("__c"))
    # the outer form keeps Spark from adding a filter that tokenises each text once more
    return sized.select(id_col, "dl", F.inline_outer("__c")).where("term IS NOT NULL")


def positional_postings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, dl, term, tf, positions``: where each term stands in the text. Needs no shuffle."""
    return _counted(df, id_col, text_col, positions=True)


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs / (df + F.lit(1.0))) + F.lit(1.0)


def term_weight(tf: Column, dl: Column, avg_dl: Column, idf_value: Column) -> Column:
    length = F.lit(1.0 - B) + F.lit(B) * dl / avg_dl
    return idf_value * (tf * F.lit(K1 + 1.0)) / (tf + F.lit(K1) * length)


def _empty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns, F.lit(None).cast("double").alias("bm25")).where(F.lit(False))


def rank_texts(
    df: DataFrame,
    query: str,
    limit: int | None,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
    mode: str = "and",
    match: str | None = None,
) -> DataFrame:
    """Top ``limit`` rows of ``df`` for ``query`` (all matches without a limit), straight from the text column.

    Every text shrinks to one row of counts before the only exchange, and the
    corpus statistics read that same exchange, so the texts are scanned once.
    ``mode='and'`` asks for every query term; a boolean column ``match`` among ``keep`` takes its place. Result:
    ``id_col, keep..., bm25`` (score rounded, ties broken by id).
    """
    terms = query_terms(query)
    out = [id_col, *keep]
    if not terms and match is None:
        return _empty(df, out)

    tokens = df.select(*out, F.explode_outer(tokenize(F.col(text_col))).alias("__term"))
    hits = [F.count_if(F.col("__term") == F.lit(t)).alias(f"__tf{i}") for i, t in enumerate(terms)]
    counted = tokens.groupBy(*out).agg(F.count("__term").alias("__dl"), *hits)
    stats = counted.agg(
        F.struct(
            F.count("*").cast("double").alias("n"),
            F.avg("__dl").alias("avg_dl"),
            *[F.count_if(F.col(f"__tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(terms))],
        ).alias("s")
    ).scalar()

    found = [F.col(f"__tf{i}") > 0 for i in range(len(terms))]
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + term_weight(F.col(f"__tf{i}"), F.col("__dl"), stats["avg_dl"], idf(stats["n"], stats[f"df{i}"]))
    matches = counted.where(F.col(match) if match else reduce(and_ if mode == "and" else or_, found))
    ranked = matches.select(*out, F.round(score, SCORE_DIGITS).alias("bm25"))
    return ranked if limit is None else ranked.orderBy(F.desc("bm25"), F.asc(id_col)).limit(limit)


def rank_clause(df: DataFrame, clause: Clause, limit: int | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Top ``limit`` rows that satisfy a clause, by the BM25 of its positive terms; without such terms all score 0."""
    tested = df.withColumn("__match", F.coalesce(clause.test(text_col), F.lit(False)))
    ranked = rank_texts(tested, " ".join(clause.terms), limit, id_col=id_col, text_col=text_col, keep=["__match"], match="__match")
    return ranked.drop("__match")


def rank_postings(
    post: DataFrame,
    n_docs: int | Column,
    avg_dl: float | Column,
    terms: Sequence[str],
    limit: int,
    *,
    mode: str = "and",
    allowed: DataFrame | None = None,
) -> DataFrame:
    """Top ``limit`` ids from ``term, doc_id, tf, dl`` rows; only the query's terms are read.

    ``allowed`` restricts the ranked ids, not the corpus statistics.
    """
    if not terms:
        return post.select("doc_id", F.lit(None).cast("double").alias("bm25")).where(F.lit(False))
    wanted = post.where(F.col("term").isin(list(terms)))
    n = F.lit(n_docs).cast("double") if not isinstance(n_docs, Column) else n_docs
    avg = F.lit(float(avg_dl)) if not isinstance(avg_dl, Column) else avg_dl
    # one column per term, so that the sum runs in query order and is reproducible
    tf = [F.coalesce(F.max(F.when(F.col("term") == F.lit(t), F.col("tf"))), F.lit(0)).alias(f"__tf{i}") for i, t in enumerate(terms)]
    every = wanted.groupBy("doc_id").agg(F.max("dl").alias("__dl"), *tf)
    # document frequencies come from the same grouped rows: the exchange is computed once for both
    freq = every.agg(
        F.struct(*[F.count_if(F.col(f"__tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(terms))], F.max("__dl")).alias("s")
    ).scalar()
    rows = every if allowed is None else every.join(allowed.select("doc_id"), "doc_id", "left_semi")
    if mode == "and":
        for i in range(len(terms)):
            rows = rows.where(F.col(f"__tf{i}") > 0)
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + term_weight(F.col(f"__tf{i}"), F.col("__dl"), avg, idf(n, freq[f"df{i}"]))
    return (
        rows.select("doc_id", F.round(score, SCORE_DIGITS).alias("bm25"))
        .orderBy(F.desc("bm25"), F.asc("doc_id"))
        .limit(limit)
    )
