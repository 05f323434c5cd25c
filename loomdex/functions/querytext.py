"""Query texts to clauses, by precedence climbing.

``rain "dry season" OR title:flood* NOT (snow OR date:[2024-01-01 TO 2024-06-30])``

Operators are written in capitals. From the loosest to the tightest: words side by side (all of them, or any with
``default="or"``), ``OR``, ``AND`` and ``ANDNOT``, ``NOT``. A word of several terms asks for all of them. ``*`` stands for any letters and ``?`` for
one, ``field:`` names the field of a word, phrase, range or group that follows at once; names that are no field are ordinary text.
Ranges include their ends in brackets and leave them out in braces; an end may be missing.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from loomdex.functions.clauses import Clause, all_of, any_of, between, in_field, none_of, phrase, prefix, term, wildcard
from loomdex.functions.text import query_terms

#: How tight the operators bind; words side by side bind loosest.
BINDING = {"OR": 1, "AND": 2, "ANDNOT": 2}
PREFIX_BINDING = 3

_TOKEN = re.compile(
    r"""(?P<space>\s+)
      | (?P<field>\w+):(?=\S)
      | (?P<range>[\[{][^\]}]*[\]}])
      | (?P<phrase>"[^"]*")
      | (?P<paren>[()])
      | (?P<word>[^\s()"\[\]{}:]+:*)
      | (?P<odd>.)""",
    re.VERBOSE | re.DOTALL,
)
_RANGE = re.compile(r"([\[{])\s*(.*?)\s*\bTO\b\s*(.*?)\s*([\]}])", re.DOTALL)


class QuerySyntaxError(ValueError):
    """The text is no query; tells where."""

    def __init__(self, text: str, at: int, what: str):
        super().__init__(f"{what} at position {at + 1} of the query: {text}")
        self.at = at


class _Parser:
    def __init__(self, text: str, fields: Collection[str], default: str):
        self.text, self.default = text, default
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            kind, value = m.lastgroup, m[m.lastgroup]
            if kind == "field" and value not in fields:  # ordinary text, up to the colon
                kind = "word"
            if kind == "odd" and value != ":":
                raise QuerySyntaxError(text, at, {'"': "a phrase is not closed"}.get(value, f"unpaired {value}"))
            if kind == "word" and value in (*BINDING, "NOT"):
                kind = "operator"
            if kind not in ("space", "odd"):
                self.tokens.append((kind, value, at))
            at = m.end()
        self.at = 0

    def fail(self, what: str):
        place = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
        raise QuerySyntaxError(self.text, place, what)

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at][:2] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def side_by_side(self) -> Clause | None:
        """Expressions up to the end or a closing parenthesis; None if there is nothing to ask for."""
        parts = []
        while self.peek()[0] != "end" and self.peek() != ("paren", ")"):
            part = self.expression(1)
            if part is not None:
                parts.append(part)
        if len(parts) < 2:
            return parts[0] if parts else None
        return all_of(*parts) if self.default == "and" else any_of(*parts)

    def expression(self, tightness: int) -> Clause | None:
        """An operand and the operators after it that bind at least so tight."""
        left = self.operand()
        while self.peek()[0] == "operator" and BINDING.get(self.peek()[1], 0) >= tightness:
            name = self.take()[1]
            right = self.expression(BINDING[name] + 1)
            left = self.join(name, left, right)
        return left

    def join(self, name: str, left: Clause | None, right: Clause | None) -> Clause | None:
        if left is None or right is None:  # one side has no terms, such as a lone sign
            return left if right is None else none_of(right) if name == "ANDNOT" else right
        if name == "OR":
            return any_of(left, right)
        return all_of(left, none_of(right) if name == "ANDNOT" else right)

    def operand(self) -> Clause | None:
        kind, value = self.peek()
        if kind == "end" or (kind, value) == ("paren", ")"):
            self.fail("a condition is missing")
        if kind == "operator" and value != "NOT":
            self.fail(f"{value} has nothing before it")
        self.at += 1
        if kind == "operator":
            inner = self.expression(PREFIX_BINDING)
            return none_of(inner) if inner is not None else None
        if kind == "paren":
            inner = self.side_by_side()
            if self.take() != ("paren", ")"):
                self.at -= 1
                self.fail("a group is not closed")
            return inner
        if kind == "field":
            return self.of_field(value)
        if kind == "phrase":
            found = phrase(value[1:-1])
            return None if not found.words else found if len(found.words) > 1 else term(found.words[0])
        if kind == "range":
            self.at -= 1
            self.fail("a range needs a field before it")
        return self.word(value)

    def of_field(self, field: str) -> Clause | None:
        if self.peek()[0] != "range":
            if self.peek()[0] == "operator":  # a word after a colon is a word
                return in_field(field, term(self.take()[1]))
            inner = self.operand()
            return in_field(field, inner) if inner is not None else None
        m = _RANGE.fullmatch(self.peek()[1])
        if not m or not (m[2] or m[3]):
            self.fail("a range is written [low TO high]")
        self.at += 1
        return between(field, m[2] or None, m[3] or None, open_low=m[1] == "{", open_high=m[4] == "}")

    def word(self, text: str) -> Clause | None:
        parts = []
        for piece in re.findall(r"[\w*?]+", text) if re.search(r"[*?]", text) else [text]:
            pattern = re.sub(r"\*+", "*", piece)
            if not re.search(r"[*?]", pattern):
                parts += map(term, query_terms(pattern))
            elif re.search(r"\w", pattern):
                parts.append(prefix(pattern[:-1]) if re.fullmatch(r"\w+\*", pattern) else wildcard(pattern))
        return None if not parts else parts[0] if len(parts) == 1 else all_of(*parts)


def parse_query(text: str, fields: Collection[str] = (), default: str = "and") -> Clause | None:
    """The clause a query text stands for; None if it asks for nothing (no letters or digits)."""
    if default not in ("and", "or"):
        raise ValueError(f"words side by side are joined by and or or, not {default}")
    parser = _Parser(text, fields, default)
    clause = parser.side_by_side()
    if parser.at < len(parser.tokens):
        parser.fail("unpaired )")
    return clause


def plain_terms(clause: Clause | None, default: str = "and") -> list[str] | None:
    """The terms of a clause that is nothing but terms joined by the default; else None."""
    if clause is None:
        return []
    if clause.kind == "term" and not clause.field:
        return list(clause.words)
    if clause.kind != ("all" if default == "and" else "any"):
        return None
    inner = [plain_terms(p, default) for p in clause.parts]
    return None if any(p is None for p in inner) else list(dict.fromkeys(t for p in inner for t in p))
