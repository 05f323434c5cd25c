"""Hierarchical packing of token sequences into windows of several lengths.

Method, in every block of documents (a bounded number of tokens, filled by one task in scan order):

1. whole windows: a document gives as many full windows of the longest tier as it fills;
2. routing: the rest of each document goes to the shortest tier whose window holds it;
3. packing: from the longest tier down, a window opens with the tier's largest rest; its gap takes the largest
   rests that still fit, first of its own tier, then of the shorter ones;
4. filling: what stays open takes a cut of a shorter tier's rest; the cut's remainder is routed again;
5. balance: the windows are dealt to steps of ``step_windows`` in the order of their attention cost, forwards
   and backwards by turns, so that every step gets like costs.

Windows are full, but for the last of a block. A document lies in one block, blocks lie in one task: nothing is
shuffled or gathered, and a lost task packs its own documents again.

Cases: a null text is empty and has the closing id alone; a document longer than a block makes a block of its
own; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import parts

#: Window lengths of the tiers, shortest first.
TIERS = (256, 512, 1024, 2048)
#: Tokens after which a block is packed.
BLOCK_TOKENS = 2_000_000
#: Windows of a step.
STEP_WINDOWS = 32
#: Words whose ids a task keeps at most; then it starts anew.
KEPT_WORDS = 400_000
#: Bytes of the texts whose words are looked up together.
PART_BYTES = 4 << 20
#: Signs at which Arrow splits words though the file does not take them for white space.
ODD = "[\x1c-\x1f]"
#: Letters, then ASCII signs that the file's split pattern never joins with letters (the apostrophe it may).
PARTS = r"^(?P<core>\pL+)(?P<signs>[!-&(-/:-@\[-^`{-~]*)$"

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("step", T.LongType()),
    ]
)


# Ids


class WordEncoder:
    """Ids by a ``tokenizers`` file whose pre-tokens never hold white space.

    Ids of a word do not depend on its neighbours, so words that came before are looked up. Letters followed by signs
    are looked up in parts, as the file's split pattern takes them apart; the normaliser ignores the case of ASCII letters.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        """``plain_specials``: strings of special tokens in a text are ordinary text; else they get the ids of their tokens."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        # texts with signs that are split otherwise, or with a string that the file takes out whole, go through the library as they are
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = "|".join([ODD, *(re.escape(t) for t in added)])
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a pre-token
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, found: list[str]) -> list[bytes]:
        """Words of letters in one call: each is one pre-token, and its last id says so; else word by word."""
        if not found:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(found)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.nonzero(self.ends[ids])[0] + 1
        if len(stops) != len(found):
            return self._encode(found)
        data, at = ids.tobytes(), 0
        out = []
        for stop in (4 * stops).tolist():
            out.append(data[at:stop])
            at = stop
        return out

    def _ids(self, words: list[str], encode) -> pa.Array:
        """Ids of each word, from what is known or by ``encode``."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        self.known.update(zip(fresh, encode(fresh)))
        return pa.array([self.known[w] for w in words], pa.binary())

    def encode(self, texts: pa.Array, end_id: int) -> pa.Array:
        """Ids of every text and ``end_id``; the words of all texts are split, numbered and looked up together."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole, ignore_case=True)
        if not pc.any(whole).as_py():
            return self._encode_words(texts, end_id)
        end = np.array([end_id], "<u4").tobytes()
        by_call = iter(self._encode(texts.filter(whole).to_pylist()))
        by_word = iter(self._encode_words(texts.filter(pc.invert(whole)), end_id).to_pylist())
        return pa.array([next(by_call) + end if w else next(by_word) for w in whole.to_pylist()], pa.binary())

    def _encode_words(self, texts: pa.Array, end_id: int) -> pa.Array:
        split = pc.utf8_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        parts = pc.extract_regex(words, PARTS)
        core = pc.ascii_lower(pc.struct_field(parts, "core")).dictionary_encode()
        signs = pc.struct_field(parts, "signs").dictionary_encode()
        ids = pc.binary_join_element_wise(
            self._ids(core.dictionary.to_pylist(), self._encode_letters).take(core.indices),
            self._ids(signs.dictionary.to_pylist(), self._encode).take(signs.indices),
            b"",
        )
        other = pc.is_null(parts)
        ids = pc.replace_with_mask(ids, other, self._ids(words.filter(other).to_pylist(), self._encode)).take(coded.indices)
        at = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset) // 4
        numbers = np.frombuffer(ids.buffers()[2] or b"", "<u4")
        stops = at[split.offsets.to_numpy() - split.offsets[0].as_py()]
        closed = np.insert(numbers[: stops[-1]], stops[1:], end_id).astype("<u4")
        offsets = (4 * (stops + np.arange(len(stops)))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(closed)])


# Windows


class _Tier:
    """Rests of one tier, by length."""

    def __init__(self):
        self.items: list[tuple[int, int, int]] = []  # length, document, start

    def take(self, room: int) -> tuple[int, int, int] | None:
        """The largest rest of at most ``room`` ids."""
        i = bisect.bisect_right(self.items, (room, float("inf"), 0))
        return self.items.pop(i - 1) if i else None


def pack_block(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Windows of ``(document, start, length)`` for documents of the given lengths."""
    longest = tiers[-1]
    windows = [[(d, s, longest)] for d, n in enumerate(lengths) for s in range(0, n - longest + 1, longest)]
    levels = [_Tier() for _ in tiers]

    def route(item: tuple[int, int, int]) -> None:
        bisect.insort(levels[bisect.bisect_left(tiers, item[0])].items, item)

    for d, n in enumerate(lengths):
        if n % longest:
            levels[bisect.bisect_left(tiers, n % longest)].items.append((n % longest, d, n - n % longest))
    for level in levels:
        level.items.sort()
    top = len(levels) - 1
    while top >= 0:
        if not levels[top].items:
            top -= 1
            continue
        n, d, s = levels[top].items.pop()
        window, room = [(d, s, n)], longest - n
        while room:
            item = next((x for level in reversed(levels[: top + 1]) if (x := level.take(room))), None)
            if item is None:  # nothing fits whole: cut the shortest tier that has any
                source = next((level for level in levels if level.items), None)
                if source is None:
                    break
                n, d, s = source.items.pop()
                route((n - room, d, s + room))
                item = (room, d, s)
            window.append((item[1], item[2], item[0]))
            room -= item[0]
        windows.append(window)
    return windows


def steps_of(windows: list[list[tuple[int, int, int]]], step_windows: int) -> list[int]:
    """The step of each window: costs (squares of the pieces' lengths) dealt out forwards and backwards by turns."""
    steps = -(-len(windows) // step_windows)
    order = sorted(range(len(windows)), key=lambda w: -sum(n * n for _, _, n in windows[w]))
    out = [0] * len(windows)
    for rank, w in enumerate(order):
        turn, place = divmod(rank, steps)
        out[w] = steps - 1 - place if turn % 2 else place
    return out


def _blocks(rows: Iterator[tuple[int, bytes]], block_tokens: int) -> Iterator[tuple[list, list[bytes]]]:
    names, texts, held = [], [], 0
    for name, ids in rows:
        names.append(name)
        texts.append(ids)
        held += len(ids) // 4
        if held >= block_tokens:
            yield names, texts
            names, texts, held = [], [], 0
    if names:
        yield names, texts


def pack(
    docs: DataFrame,
    doc_id: str,
    text: str,
    tokenizer_path: str,
    end_id: int,
    tiers: tuple[int, ...] = TIERS,
    block_tokens: int = BLOCK_TOKENS,
    step_windows: int = STEP_WINDOWS,
    plain_specials: bool = False,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its window, with its ids, tier and step.

    Ids go from the tokenizer to the windows inside one task. With ``plain_specials`` a text cannot hold the ids of special tokens.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        encoder = WordEncoder(tokenizer_path, plain_specials)
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for part in parts(batch.column(1), PART_BYTES):
                ids = encoder.encode(part, end_id)
                for one in ids:
                    yield names[at], one.as_py()
                    at += 1
            pa.default_memory_pool().release_unused()

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        step_number = number
        schema = pa.schema(
            [(f.name, pa.binary() if f.name == "ids" else pa.int32() if f.name == "tier" else pa.int64()) for f in PIECES]
        )
        for names, texts in _blocks(encoded(batches), block_tokens):
            windows = pack_block([len(t) // 4 for t in texts], tiers)
            steps = steps_of(windows, step_windows)
            rows = []
            for window, step in zip(windows, steps):
                offset = 0
                tier = tiers[bisect.bisect_left(tiers, max(n for _, _, n in window))]
                for d, s, n in window:
                    rows.append(
                        (names[d], s, n, texts[d][4 * s : 4 * (s + n)], len(texts[d]) // 4, number, offset, tier, step_number + step)
                    )
                    offset += n
                number += 1
            step_number += max(steps, default=-1) + 1
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 10_000]), schema)], schema=schema
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(windows_of, PIECES)
