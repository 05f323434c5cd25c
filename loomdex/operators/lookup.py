"""Clauses answered from stored postings: terms, phrases by their positions, prefixes and wildcards through the dictionary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.clauses import Clause
from loomdex.operators.bm25 import SCORE_DIGITS, idf, term_weight
from loomdex.store import term_bucket

FIELDS = ("title", "content")


def expand(dictionary: DataFrame, leaves: Sequence[tuple[Clause, str]]) -> DataFrame:
    """``field, term, bucket, leaves`` of the terms that prefixes or wildcards of a field stand for; ``leaves`` has the places of theirs.

    One range scan of the sorted dictionary for all of them.
    """
    ranges = [(F.col("field") == field) & _between(leaf.start()) for leaf, field in leaves]
    tests = [near & _test(leaf) for (leaf, _), near in zip(leaves, ranges)]
    # the ranges stand alone too: beside a regular expression no scan could use them
    found = dictionary.where(reduce(or_, ranges)).where(reduce(or_, tests)).select("field", "bucket", "term").distinct()
    places = F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(tests)])
    return found.withColumn("leaves", F.array_compact(places))


def _between(start: str) -> Column:
    """Whether a term begins with ``start``, as a range."""
    if not start:
        return F.col("term").isNotNull()
    inside = F.col("term") >= start
    if ord(start[-1]) < 0x10FFFF:  # the first text behind all that begin so
        inside = inside & (F.col("term") < start[:-1] + chr(_next_code_point(ord(start[-1]))))
    return inside


def _test(leaf: Clause) -> Column:
    """The whole condition on a term; most terms are ruled out by their beginning and end, before the regular expression."""
    test = F.startswith("term", F.lit(leaf.start()))
    if leaf.kind == "wildcard":
        test = test & F.endswith("term", F.lit(leaf.end())) & F.rlike("term", F.lit(leaf.regex()))
    return test


def _next_code_point(code: int) -> int:
    return 0xE000 if code == 0xD7FF else code + 1  # surrogates are no characters


def adjacent(positions: list[Column]) -> Column:
    """Whether some place holds all words in a row: positions moved back by the word's place have a common value."""
    def back(places: Column, steps: int) -> Column:
        return F.transform(places, lambda x: x - F.lit(steps))

    moved = [back(p, i) for i, p in enumerate(positions)]
    return F.size(reduce(F.array_intersect, moved)) > 0


def rank_clause_postings(
    post: DataFrame,
    dictionary: DataFrame,
    lengths: DataFrame,
    clause: Clause,
    limit: int | None,
    n_docs: int | Column,
    avg_dl: float | Column,
    *,
    field: str = "content",
    meta: DataFrame | None = None,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, bm25`` of the top ``limit`` ids that satisfy ``clause``, by the BM25 of its positive terms.

    ``post`` has positions, ``dictionary`` the terms, ``lengths`` one row per id and field; ``meta`` the columns that ranges and words of fields
    without postings look at. Only postings of the clause's terms are read; texts are not. Ids without any of the terms
    count only where the clause can hold without them (a negation or a range alone): then all of ``lengths`` take part.
    """
    leaves = list(dict.fromkeys(clause.leaves()))
    own = lambda leaf: leaf.field or field
    posted = [x for x in leaves if x.kind != "range" and own(x) in FIELDS]
    exact = list(dict.fromkeys((own(x), w) for x in posted if x.kind in ("term", "phrase") for w in x.words))
    placed = {(own(x), w) for x in posted if x.kind == "phrase" for w in x.words}
    patterns = [x for x in posted if x.kind in ("prefix", "wildcard")]

    is_slot = [(F.col("field") == f) & (F.col("term") == w) for f, w in exact]
    slot = reduce(lambda c, i: c.when(is_slot[i], i), range(1, len(exact)), F.when(is_slot[0], 0)) if exact else None
    at = lambda i, value: F.max(F.when(F.col("slot") == i, value))
    of_field = [i for i, (f, _) in enumerate(exact) if f == field]
    tf_names = [f"__tf{i}" for i in range(len(exact) + len(patterns))]
    at_names = [f"__at{exact.index(p)}" for p in sorted(placed)]
    if exact:
        wanted = post.where(F.col("bucket").isin([term_bucket(F.lit(w)) for _, w in exact]) & reduce(or_, is_slot))
        positions = F.when(reduce(or_, [is_slot[exact.index(p)] for p in sorted(placed)]), F.col("positions")) if placed else F.lit(None).cast("array<int>")
        rows = wanted.select("doc_id", slot.alias("slot"), "tf", "dl", positions.alias("positions"))
        dl = F.max(F.when(F.col("slot").isin(of_field), F.col("dl"))) if of_field else F.lit(None).cast("bigint")
        columns = [F.coalesce(at(i, F.col("tf")), F.lit(0)).alias(f"__tf{i}") for i in range(len(exact))]
        counted = rows.groupBy("doc_id").agg(dl.alias("__dl"), *columns, *[at(exact.index(p), F.col("positions")).alias(c) for p, c in zip(sorted(placed), at_names)])
    else:
        counted = post.select("doc_id", F.lit(None).cast("bigint").alias("__dl")).where(F.lit(False))
    every = counted
    if patterns:
        # the few buckets of the terms are read only: the dictionary's side prunes the partitions of the postings
        hits = post.select("field", "bucket", "term", "doc_id").join(expand(dictionary, [(x, own(x)) for x in patterns]), ["field", "bucket", "term"])
        hits = hits.select("doc_id", F.explode("leaves").alias("slot"))
        matched = hits.groupBy("doc_id").agg(*[F.coalesce(at(j, F.lit(1)), F.lit(0)).cast("bigint").alias(c) for j, c in enumerate(tf_names[len(exact) :])])
        both = counted.unionByName(matched, allowMissingColumns=True).groupBy("doc_id")
        every = both.agg(F.max("__dl").alias("__dl"), *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in tf_names], *[F.max(c).alias(c) for c in at_names])

    scored = [exact.index((field, t)) for t in clause.terms]
    freq = None
    if scored:
        counts = [F.count_if(F.col(f"__tf{i}") > 0).cast("double").alias(f"df{i}") for i in scored]
        # every column is named, so that the grouped rows are made once for the frequencies and the ranking; patterns count no document
        whole = [F.max(c) for c in counted.columns if c.startswith(("__dl", "__tf"))] + [F.count(c) for c in at_names]
        freq = counted.agg(F.struct(*counts, *whole).alias("s")).scalar()

    def leaf_test(leaf: Clause) -> Column:
        if leaf.kind == "range" or own(leaf) not in FIELDS:
            return F.coalesce(leaf.test_leaf(own(leaf)), F.lit(False))
        if leaf in patterns:
            return F.col(f"__tf{len(exact) + patterns.index(leaf)}") > 0
        names = [exact.index((own(leaf), w)) for w in leaf.words]
        present = reduce(lambda a, b: a & b, [F.col(f"__tf{i}") > 0 for i in names])
        return present if leaf.kind == "term" else present & adjacent([F.col(f"__at{i}") for i in names])

    found = every
    if holds_without_terms(clause, set(posted)):
        ids = lengths.where(F.col("field") == field).select("doc_id")
        found = ids.join(every, "doc_id", "left").fillna(0, tf_names)
    named = sorted({own(x) for x in leaves if x not in posted})
    if named:
        if meta is None:
            raise ValueError(f"the clause asks for {', '.join(named)}, which have no postings: pass meta")
        found = found.join(meta.select("doc_id", *named), "doc_id")
    if allowed is not None:
        found = found.join(allowed.select("doc_id"), "doc_id", "left_semi")
    found = found.where(F.coalesce(clause.fold(leaf_test), F.lit(False)))
    n = n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))
    avg = avg_dl if isinstance(avg_dl, Column) else F.lit(float(avg_dl))
    score = F.lit(0.0)
    for i in scored:
        weight = term_weight(F.col(f"__tf{i}"), F.coalesce("__dl", F.lit(0)), avg, idf(n, freq[f"df{i}"]))
        score = score + weight
    ranked = found.select("doc_id", F.round(score, SCORE_DIGITS).alias("bm25"))
    return ranked if limit is None else ranked.orderBy(F.desc("bm25"), F.asc("doc_id")).limit(limit)


def holds_without_terms(clause: Clause, posted: set[Clause]) -> bool:
    """Whether an id with no posting of the clause can satisfy it: leaves with postings fail, what the others say is unknown."""
    no, yes, unknown = {False}, {True}, {False, True}
    both = lambda a, b: {x and y for x in a for y in b}
    either = lambda a, b: {x or y for x in a for y in b}
    outcome = clause.fold(lambda x: no if x in posted else unknown, both, either, lambda a: {not x for x in a})
    return bool(outcome & yes)
