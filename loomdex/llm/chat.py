"""Chat formatting with an incremental black-box view of the template.

A template is any function from turns (``role, text``) to a string. ``trace`` learns from its outputs alone where
each turn went: it renders successive prefixes of the conversation and compares neighbours. As long as an output
begins with the one before, the new characters are the new turn's span; rendering the turn once more with a
changed text shows which part of the span is the text. An output that does not begin with the one before tells that the
template rewrites history at this turn; the spans are then taken from the whole conversation's output, where each
text is changed in turn.

``TurnTemplate`` marks turns with control strings and escapes the signs they are made of inside roles and texts, so
nothing in a text can be read as a control string, and reading back is exact.

Cases: null roles and texts are empty; turns are ordered by turn (null first), then role and text, so ties and
repeated rows have one order; rows without a conversation id make one conversation; an empty table gives no rows. A
conversation is formatted in one task, which holds this conversation alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import grouped

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

SPAN = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
)
FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("rewritten_at", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class TurnTemplate:
    """``<s>[role]`` line, text, ``</s>`` line; backslash codes stand for the signs of the control strings."""

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(f"<s>[{self.escape(role)}]\n{self.escape(text)}</s>\n" for role, text in turns)

    @staticmethod
    def escape(text: str) -> str:
        return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\o").replace("]", "\\c")

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(.)", lambda m: {"l": "<", "o": "[", "c": "]"}.get(m[1], m[1]), text, flags=re.DOTALL)

    def read(self, formatted: str) -> list[Turn]:
        """The turns of a formatted conversation."""
        turns, at = [], 0
        for m in re.finditer(r"<s>\[([^\]<]*)\]\n([^<]*)</s>\n", formatted):
            if m.start() != at:
                raise ValueError(f"no turn begins at {at}")
            turns.append((self.unescape(m[1]), self.unescape(m[2])))
            at = m.end()
        if at != len(formatted):
            raise ValueError(f"no turn begins at {at}")
        return turns


def _common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:  # the longest equal prefix, by halves
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _text_span(render: Callable[[str], str], text: str, out: str) -> tuple[int, int]:
    """Where ``text`` lies in ``out = render(text)``: outputs for two other texts agree before and after it only."""
    a, b = render("0"), render("1")
    start = _common_prefix(a, b)
    tail = _common_prefix(a[start:][::-1], b[start:][::-1])
    if a[start:] == b[start:] or len(out) - tail < start:  # this text does not reach the output
        return start, start
    return start, len(out) - tail


def trace(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[str, int, int]], int | None]:
    """Output, spans of the turns' texts, and the first turn at which the template rewrites history (or None)."""
    before, spans, rewritten = template([]), [], None
    for i, (role, text) in enumerate(turns):
        out = template(turns[: i + 1])
        if not out.startswith(before):
            rewritten = i
            break
        start, end = _text_span(lambda t: template([*turns[:i], (role, t)]), text, out)  # noqa: B023
        spans.append((role, start, end))
        before = out
    if rewritten is None:
        return before, spans, None
    out, spans = template(turns), []
    for i, (role, text) in enumerate(turns):
        start, end = _text_span(lambda t: template([*turns[:i], (role, t), *turns[i + 1 :]]), text, out)  # noqa: B023
        spans.append((role, start, end))
    return out, spans, rewritten


def format_conversations(
    turns: DataFrame, template: Template, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: its formatted text, the span of each turn's text, and where history was rewritten."""
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema(
            [("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(span)), ("rewritten_at", pa.int32())]
        )
        held, size = [], 0
        for table in grouped(batches, ["conv_id"]):
            own = list(zip(table.column("role").to_pylist(), table.column("text").to_pylist()))
            out, spans, rewritten = trace(template, own)
            held.append(
                {
                    "conv_id": table.column("conv_id")[0].as_py(),
                    "formatted": out,
                    "spans": [{"role": r, "start": s, "end": e} for r, s, e in spans],
                    "rewritten_at": rewritten,
                }
            )
            size += len(out)
            if size >= 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .mapInArrow(conversations, FORMATTED)
    )


def read_back(formatted: DataFrame, template: TurnTemplate, learn_role: str = "assistant") -> DataFrame:
    """``formatted`` with ``turns`` (parsed from the text) and ``loss_text`` (the unescaped texts under the loss mask)."""
    turn = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    @F.arrow_udf(T.StructType([T.StructField("turns", T.ArrayType(turn)), T.StructField("loss_text", T.StringType())]))
    def parsed(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, own in zip(text, spans):
            t = t.as_py()
            masked = (t[s["start"] : s["end"]] for s in own.as_py() if s["role"] == learn_role)
            out.append(
                {
                    "turns": [{"role": r, "text": x} for r, x in template.read(t)],
                    "loss_text": "".join(map(template.unescape, masked)),
                }
            )
        return pa.array(
            out, pa.struct([("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("loss_text", pa.string())])
        )

    return formatted.withColumn("_read", parsed("formatted", "spans")).select(
        *formatted.columns, "_read.turns", "_read.loss_text"
    )
