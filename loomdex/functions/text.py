"""Text primitives as Column expressions: trimming, lines, paragraphs, Markdown sections, tokens."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.arrays import let

# The code points that count as white space (Unicode White_Space
# plus the four ASCII separators 1C-1F), as characters and as a regex class.
WS_CODE_POINTS = (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
    *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
WS_CHARS = "".join(map(chr, WS_CODE_POINTS))
WS_CLASS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

MIN_PARAGRAPH = 10
WORD = r"[\p{L}\p{M}\p{N}]+"
WORD_OR_HAN = r"\p{IsHan}|[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]+"
HAN_PAIR = r"(?=(\p{IsHan}{2}))."
_PY_WORD_OR_HAN_RUN = regex.compile(r"(?V1)\p{Han}+|[\p{L}\p{M}\p{N}--\p{Han}]+")
_PY_HAN = regex.compile(r"\p{Han}")


def strip(text: Column) -> Column:
    """Trim Unicode white space (``trim`` alone only drops U+0020)."""
    return F.btrim(text, F.lit(WS_CHARS))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def paragraphs(text: Column) -> Column:
    """Blank-line separated paragraphs, trimmed, those of at most ten characters dropped."""
    parts = F.transform(F.split(text, r"\n" + WS_CLASS + r"*\n"), strip)
    return F.filter(parts, lambda p: F.length(p) > F.lit(MIN_PARAGRAPH))


def markdown_sections(markdown: Column) -> Column:
    """``array<struct<heading,body>>`` cut before every ``#``-``######`` heading line.

    Text before the first heading and headings without a body yield no section.
    ``(?d)`` keeps ``^`` tied to line feeds only.
    """
    pieces = F.transform(F.split(markdown, r"(?md)(?=^#{1,6} )"), strip)
    kept = F.filter(pieces, lambda p: F.startswith(p, F.lit("#")) & F.contains(p, F.lit("\n")))
    return F.transform(
        kept,
        lambda p: let(
            F.split(p, "\n", 2),
            lambda hb: F.struct(
                strip(F.get(hb, F.lit(0))).alias("heading"),
                strip(F.get(hb, F.lit(1))).alias("body"),
            ),
        ),
    )


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """File name without its last extension; leading dots are part of the name."""
    return F.regexp_replace(basename(path), r"^(\.*[^.].*)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, ``''`` when there is none (``.md`` has none)."""
    return F.lower(F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1))


def tokenize(text: Column) -> Column:
    """Search terms of a text: case kept, no stop words, no stemming.

    Runs of letters, marks and digits are words. Han characters are terms of
    their own, and every pair of neighbours is one more term (listed last), so
    that one- and many-character queries find them without a dictionary. Only
    regular expressions are used, which keeps scans inside generated code.
    """
    words = F.regexp_extract_all(text, F.lit(WORD_OR_HAN), F.lit(0))
    pairs = F.regexp_extract_all(text, F.lit(HAN_PAIR), F.lit(1))
    # texts without Han characters take the cheaper pattern
    plain = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.when(F.rlike(text, F.lit(r"\p{IsHan}")), F.concat(words, pairs)).otherwise(plain)


def term_counts(tokens: Column) -> Column:
    """``array<struct<term,tf>>`` of a token array: sort, then measure the runs of equal terms.

    Counting inside the row replaces an aggregation over exploded tokens, so
    building postings needs no shuffle.
    """

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), n - F.lit(1)), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - F.lit(1)))
        )

        def count(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(s, at).alias("term"), (F.coalesce(F.get(starts, k + F.lit(1)), n) - at).cast("bigint").alias("tf")
                ),
            )

        return F.when(n > 0, let(starts, count)).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))

    return let(F.sort_array(tokens), runs)


def query_terms(query: str) -> list[str]:
    """Distinct terms of one query, on the driver.

    A Han run of several characters asks for its bigrams only (they imply the
    characters); everything else matches :func:`tokenize`.
    """
    terms: dict[str, None] = {}
    for token in _PY_WORD_OR_HAN_RUN.findall(query):
        if _PY_HAN.match(token) and len(token) > 1:
            for i in range(len(token) - 1):
                terms[token[i : i + 2]] = None
        else:
            terms[token] = None
    return list(terms)


def text_tokens(text: str) -> list[str]:
    """Words and single Han characters of a text in their order, on the driver: what :func:`tokenize` gives before its pairs."""
    tokens = []
    for run in _PY_WORD_OR_HAN_RUN.findall(text):
        tokens += run if _PY_HAN.match(run) else [run]
    return tokens


def term_positions(tokens: Column) -> Column:
    """``array<struct<term,tf,positions>>`` of a token array: positions ascend from 0.

    Terms and their places are sorted together and cut where the term changes, inside the row.
    """
    kind = "array<struct<term:string,tf:bigint,positions:array<int>>>"

    def runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(
            F.sequence(F.lit(0), n - F.lit(1)), lambda i: (i == 0) | (F.get(s, i)["term"] != F.get(s, i - F.lit(1))["term"])
        )

        def cut(starts: Column) -> Column:
            def one(at: Column, k: Column) -> Column:
                size = F.coalesce(F.get(starts, k + F.lit(1)), n) - at
                return F.struct(
                    F.get(s, at)["term"].alias("term"),
                    size.cast("bigint").alias("tf"),
                    F.slice(s, at + F.lit(1), size)["at"].alias("positions"),
                )

            return F.transform(starts, one)

        return F.when(n > 0, let(starts, cut)).otherwise(F.array().cast(kind))

    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
    return let(F.sort_array(placed), runs)
