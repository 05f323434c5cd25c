"""Search conditions as values: boolean, phrase, prefix, field and range clauses.

``all_of(term("rain"), none_of(phrase("dry season")), between("date", "2024-01-01", None))`` says what to find; query texts become
such values in :mod:`loomdex.functions.querytext`. A clause is one boolean column over the text columns (:meth:`Clause.test`), or is
answered from stored postings (:mod:`loomdex.operators.lookup`). Its positive terms are what BM25 scores.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.text import text_tokens, tokenize


@dataclass(frozen=True)
class Clause:
    """``kind``: term, phrase, prefix, wildcard, range, or all, any, none over ``parts``.

    A null ``field`` is the field that is searched; words of other fields are not scored.
    """

    kind: str
    words: tuple[str, ...] = ()
    field: str | None = None
    low: object = None
    high: object = None
    open_low: bool = False
    open_high: bool = False
    parts: tuple[Clause, ...] = ()

    @property
    def terms(self) -> tuple[str, ...]:
        """Terms that are scored, in the order of the clause."""
        if self.kind in ("term", "phrase"):
            return () if self.field else tuple(dict.fromkeys(self.words))
        if self.kind in ("all", "any"):
            return tuple(dict.fromkeys(t for p in self.parts for t in p.terms))
        return ()

    def leaves(self) -> Iterator[Clause]:
        if self.kind in ("all", "any", "none"):
            for part in self.parts:
                yield from part.leaves()
        else:
            yield self

    def fold(self, leaf: Callable[[Clause], object], both: Callable = and_, either: Callable = or_, negate: Callable | None = None):
        """The boolean tree over what ``leaf`` gives for every leaf."""
        if self.kind not in ("all", "any", "none"):
            return leaf(self)
        parts = [p.fold(leaf, both, either, negate) for p in self.parts]
        joined = reduce(both if self.kind == "all" else either, parts)
        if self.kind != "none":
            return joined
        return negate(joined) if negate else ~joined

    def test(self, column: str) -> Column:
        """The condition on the text column ``column`` and the named fields."""
        return self.fold(lambda x: F.coalesce(x.test_leaf(x.field or column), F.lit(False)))

    def test_leaf(self, column: str) -> Column:
        if self.kind == "range":
            value = F.col(column)
            tests = [value.isNotNull()]
            if self.low is not None:
                tests.append(value > F.lit(self.low) if self.open_low else value >= F.lit(self.low))
            if self.high is not None:
                tests.append(value < F.lit(self.high) if self.open_high else value <= F.lit(self.high))
            return reduce(and_, tests)
        tokens = F.coalesce(tokenize(F.col(column).cast("string")), F.array().cast("array<string>"))
        if self.kind == "term":
            return F.array_contains(tokens, self.words[0])
        if self.kind == "phrase":
            sought = F.lit(" " + " ".join(self.words) + " ")
            return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), sought)
        if self.kind == "prefix":
            return F.exists(tokens, lambda t: F.startswith(t, F.lit(self.words[0])))
        return F.exists(tokens, lambda t: F.rlike(t, F.lit(self.regex())))

    def regex(self) -> str:
        """A wildcard as an anchored regular expression."""
        return "^" + "".join(".*" if p == "*" else "." if p == "?" else re.escape(p) for p in self.words[0]) + "$"

    def start(self) -> str:
        """What every term of a prefix or wildcard begins with."""
        return self.words[0] if self.kind == "prefix" else re.split(r"[*?]", self.words[0], maxsplit=1)[0]

    def end(self) -> str:
        """What every term of a wildcard ends with."""
        return re.split(r"[*?]", self.words[0])[-1]


def term(word: str) -> Clause:
    return Clause("term", (word,))


def phrase(words: str) -> Clause:
    """The words next to each other, in their order."""
    return Clause("phrase", tuple(text_tokens(words)))


def prefix(start: str) -> Clause:
    """Any term that starts so; a wildcard adds no score."""
    return Clause("prefix", (start,))


def wildcard(pattern: str) -> Clause:
    """``*`` for any letters, ``?`` for one; the whole term must match."""
    return Clause("wildcard", (pattern,))


def in_field(field: str, clause: Clause) -> Clause:
    """The clause on another column; that column's words are not scored."""
    parts = tuple(in_field(field, p) for p in clause.parts)
    return replace(clause, parts=parts, field=clause.field or (None if parts else field))


def between(field: str, low=None, high=None, *, open_low: bool = False, open_high: bool = False) -> Clause:
    """Both ends included unless open; a null end has no bound, a row without the value does not match."""
    return Clause("range", field=field, low=low, high=high, open_low=open_low, open_high=open_high)


def all_of(*clauses: Clause) -> Clause:
    return Clause("all", parts=clauses)


def any_of(*clauses: Clause) -> Clause:
    return Clause("any", parts=clauses)


def none_of(*clauses: Clause) -> Clause:
    return Clause("none", parts=clauses)
