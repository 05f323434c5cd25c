"""Terms of many texts at once, for Arrow nodes: what ``text.tokenize`` gives, cut from the bytes of whole batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex

#: Classes of code points.
OTHER, LETTER, HAN = 0, 1, 2
CODE_POINTS = 0x110000
#: Bytes of text that are worked on together.
PART_BYTES = 1 << 18


class Classes(NamedTuple):
    """Code points with equal class side by side: where each run begins, and its class. Small, so it travels with a task."""

    starts: np.ndarray
    kinds: np.ndarray

    def table(self) -> np.ndarray:
        return np.repeat(self.kinds, np.diff(self.starts, append=CODE_POINTS))


#: Made once a process. A list, because functions with a cache of their own do not travel by value.
_made: list[Classes] = []


def classes() -> Classes:
    """Letters, marks and digits are one class, Han characters another: those of query texts (``text.query_terms``)."""
    if _made:
        return _made[0]
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(CODE_POINTS))
    table = np.zeros(CODE_POINTS, np.uint8)
    for kind, pattern in ((LETTER, r"[\p{L}\p{M}\p{N}]+"), (HAN, r"\p{Han}+")):  # Han comes last: such letters are Han
        for run in regex.finditer(pattern, every):
            table[run.start() : run.end()] = kind
    starts = np.flatnonzero(np.diff(table, prepend=255))
    _made.append(Classes(starts, table[starts]))
    return _made[0]


class Cut(NamedTuple):
    """Words and single Han characters in their order, and pairs of neighbouring Han characters; how many each text has of both."""

    words: pa.Array
    n_words: np.ndarray
    pairs: pa.Array
    n_pairs: np.ndarray


def parts(texts: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """``start, end`` of runs of texts or binaries of about ``size`` bytes, so that what is made of a run stays small."""
    offsets = byte_offsets(texts)
    at = 0
    while at < len(texts):
        end = min(len(texts), int(np.searchsorted(offsets, offsets[at] + size)))
        yield at, end
        at = end


def byte_offsets(texts: pa.Array) -> np.ndarray:
    """Where each text begins in the buffer of all bytes, and where the last one ends."""
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def text_bytes(texts: pa.Array) -> np.ndarray:
    buffer = texts.buffers()[2]
    return np.frombuffer(buffer, np.uint8) if buffer else np.empty(0, np.uint8)


def each_bytes(texts: pa.Array) -> Iterator[bytes]:
    """The bytes of every text; a list of Python texts takes several times as long."""
    offsets, buffer = byte_offsets(texts).tolist(), texts.buffers()[2]
    whole = buffer.to_pybytes() if buffer else b""
    return (whole[a:b] for a, b in zip(offsets, offsets[1:]))


def strings(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Texts of the given lengths, cut from bytes that lie side by side."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def count(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """How many terms each of a run of texts has, its pairs included."""
    found = cut(texts, table)
    return found.n_words + found.n_pairs


def cut(texts: pa.Array, table: np.ndarray, *, pairs: bool = True) -> Cut:
    """The terms of a run of texts; null texts have none. ``table`` has the class of every code point.

    No object is made per term: classes are looked up for all characters, terms begin and end where the class changes.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = byte_offsets(texts)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer else np.empty(0, np.uint8)
    rows = offsets - offsets[0]
    if not len(data) or data.max() < 0x80:
        at, first, kinds = np.arange(len(data) + 1), rows, table[data]
    else:
        try:
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        except UnicodeDecodeError:  # bytes that are no UTF-8: the sign for unknown characters parts words
            whole = data.tobytes()
            mended = [whole[a:b].decode(errors="replace") for a, b in zip(rows[:-1], rows[1:])]
            return cut(pa.array(mended, pa.large_string()), table, pairs=pairs)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first, kinds = np.searchsorted(at, rows), table[points]

    opens = np.zeros(len(kinds) + 1, bool)  # where a text begins
    opens[first] = True
    letter, han = kinds == LETTER, kinds == HAN
    after = np.empty(len(kinds), bool)  # behind a letter of the same text
    after[:1] = False
    after[1:] = letter[:-1]
    after &= ~opens[:-1]
    starts = np.flatnonzero(han | (letter & ~after))
    before = np.empty(len(kinds), bool)  # ahead of a letter of the same text
    before[-1:] = False
    before[:-1] = letter[1:] & ~opens[1:-1]
    ends = np.flatnonzero(han | (letter & ~before)) + 1
    kept = data[np.repeat(kinds != OTHER, np.diff(at))] if len(at) != len(data) + 1 else data[kinds != OTHER]
    words = strings(at[ends] - at[starts], kept)
    n_words = np.diff(np.searchsorted(starts, first))

    two = np.empty(0, np.int64)
    if pairs and han.any():
        two = np.flatnonzero(han[:-1] & han[1:] & ~opens[1:-1])
    lengths = at[two + 2] - at[two] if len(two) else two
    moved = np.repeat(at[two] - (np.cumsum(lengths) - lengths), lengths)
    both = strings(lengths, data[moved + np.arange(len(moved))])
    return Cut(words, n_words, both, np.diff(np.searchsorted(two, first)))


def order_of(key: np.ndarray) -> np.ndarray:
    """Places of numbers in ascending order, equal ones in theirs: number and place are sorted as one number where both fit into it."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)
