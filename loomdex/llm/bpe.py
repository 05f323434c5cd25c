"""Byte-level BPE with the tiktoken library and a local rank file.

``encode`` adds a column of token ids, ``decode`` a column of raw bytes; both keep every other column.
A text is cut before it reaches the library, only where no match of the split pattern can cross:

* between a non-blank and a blank (no alternative of the pattern continues from a non-blank into a blank);
* inside a run of blanks that a non-blank follows, before its last blank: the pattern takes all but the last
  blank as one match. Such a run may be too long for the pattern engine, so its match is encoded by itself.

Cases: a null text counts as empty and has no ids; null ids decode to no bytes; a text without any blank stays
in one piece; repeated rows are encoded each; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import parts

#: Characters per piece handed to the library.
PIECE_CHARS = 65_536
#: Runs of blanks from this length on are encoded by themselves.
BLANK_RUN = 4_096
#: Bytes of the texts or ids that a task turns over at once.
PART_BYTES = 2 << 20


def load_encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS, run: int = BLANK_RUN) -> Iterator[tuple[bool, str]]:
    """``(is one match, piece)`` whose concatenation is ``text``; matches of the pattern never cross pieces."""
    if len(text) <= min(size, run):
        yield False, text
        return
    at = 0
    for blanks in regex.finditer(r"\p{White_Space}{%d,}" % run, text):
        end = blanks.end() if blanks.end() == len(text) else blanks.end() - 1
        yield from _cut(text, at, blanks.start(), size)
        yield True, text[blanks.start() : end]
        at = end
    yield from _cut(text, at, len(text), size)


def _cut(text: str, at: int, end: int, size: int) -> Iterator[tuple[bool, str]]:
    while end - at > size:
        cut = _boundary(text, at + size, at)
        if cut is None:
            cut = next((i for i in range(at + size, end) if text[i] in " \n" and not text[i - 1].isspace()), end)
        yield False, text[at:cut]
        at = cut
    if at < end:
        yield False, text[at:end]


def _boundary(text: str, before: int, after: int) -> int | None:
    """The last blank in ``text[after+1:before]`` that follows a non-blank."""
    while (i := max(text.rfind(" ", after + 1, before), text.rfind("\n", after + 1, before))) > 0:
        if not text[i - 1].isspace():
            return i
        before = i
    return None


def encode_text(encoding, text: str) -> list[int]:
    if len(text) <= BLANK_RUN:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    for one_match, piece in safe_pieces(text):
        ids += encoding._encode_single_piece(piece) if one_match else encoding.encode_ordinary(piece)
    return ids


def encode(docs: DataFrame, text: str, rank_path: str, pattern: str, into: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of every whole text in ``into``."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def token_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load_encoding(rank_path, pattern)
        for part in (p for batch in batches for p in parts(batch, PART_BYTES)):
            # compact numbers at once: lists of Python integers would take ten times the memory
            ids = [np.array(encode_text(encoding, t.as_py() or ""), np.int32) for t in part]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))

    return docs.withColumn(into, token_ids(F.col(text)))


def decode(docs: DataFrame, ids: str, rank_path: str, pattern: str, into: str = "decoded") -> DataFrame:
    """``docs`` with the raw bytes of the ids in ``into``; ids may cut characters, so nothing is read as UTF-8."""

    @F.arrow_udf(T.BinaryType())
    def raw_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding = load_encoding(rank_path, pattern)
        for part in (p for batch in batches for p in parts(batch, PART_BYTES)):
            yield pa.array([encoding.decode_bytes(i.values.to_pylist() if i.is_valid else []) for i in part], pa.binary())

    return docs.withColumn(into, raw_bytes(F.col(ids)))
