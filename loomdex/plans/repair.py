"""Optional model repair of converted documents whose quality score asks for it (off by default)."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.arrays import let
from loomdex.functions.quality import stage_1
from loomdex.functions.text import strip
from loomdex.schemas import SECTION

# Service defaults.
MODEL = "qwen2.5:7b"
URL = "http://localhost:11434/api/generate"
TIMEOUT = 60
RETRIES = 2

LOCAL_PROMPT = "Repair the structure of this Markdown document: complete the heading levels, remove garbled text, answer with Markdown only.\n\n"
REWRITE_PROMPT = "Rewrite this text as structured Markdown with #, ## and ### headings and sensible paragraphs, answer with Markdown only.\n\n"
ISSUE_FAILED = "repair failed, please check by hand"

Rewriter = Callable[[str], str | None]


class HttpRewriter:
    """Text generation over HTTP with retries and a growing pause; None when every attempt fails."""

    def __init__(self, model: str = MODEL, url: str = URL, timeout: int = TIMEOUT, retries: int = RETRIES):
        self.model, self.url, self.timeout, self.retries = model, url, timeout, retries

    def __call__(self, prompt: str) -> str | None:
        payload = json.dumps({"model": self.model, "prompt": prompt, "stream": False}).encode()
        for attempt in range(1, self.retries + 1):
            request = urllib.request.Request(self.url, data=payload, headers={"Content-Type": "application/json"}, method="POST")
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as response:
                    return json.loads(response.read().decode()).get("response", "").strip() or None
            except (OSError, ValueError):
                if attempt < self.retries:
                    time.sleep(attempt)
        return None


def _rewrite_udf(rewriter: Rewriter):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([None if p is None else rewriter(p) for p in arr.to_pylist()], type=pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType="string")


def sections_of_reply(reply: Column, first: Column, mark: str) -> Column:
    """Sections of a Markdown reply: headings of one to three ``#``; page and method come from ``first``."""
    parts = F.filter(
        F.transform(F.split(reply, r"(?md)(?=^#{1,3} )"), strip), lambda p: F.rlike(p, F.lit(r"(?d)^#{1,3} .+\n"))
    )

    def section(p: Column) -> Column:
        return let(
            F.split(p, "\n", 2),
            lambda hb: F.struct(
                strip(F.regexp_replace(F.get(hb, F.lit(0)), "^#+ ", "")).alias("title"),
                strip(F.get(hb, F.lit(1))).alias("content"),
                F.length(F.regexp_extract(p, "^(#+)", 1)).alias("heading_level"),
                F.lit(None).cast("string").alias("parent_title"),
                first["page_range"].alias("page_range"),
                first["conversion_method"].alias("conversion_method"),
                F.map_concat(
                    F.map_filter(first["metadata"], lambda k, _: k != F.lit(mark)), F.create_map(F.lit(mark), F.lit("true"))
                ).alias("metadata"),
            ),
        )

    return F.transform(parts, section).cast(f"array<{SECTION}>")


def repair(scored: DataFrame, rewriter: Rewriter) -> DataFrame:
    """Second opinion for documents in stage 2 (local fix) and stage 3 (rewrite).

    ``scored`` is the output of ``with_quality``. As a repair is a suggestion,
    the sections stay as converted; ``quality_score``, ``needs_fix`` and
    ``issues`` describe the repaired text, which is kept in ``repaired``. Only
    rows in those stages reach the model, with their whole text.
    """
    stage = F.col("quality_stage")
    text = F.array_join(
        F.transform("sections", lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), F.coalesce(s["content"], F.lit("")))), "\n\n"
    )
    local = stage == 2
    rewrite = (stage == 3) & (F.size("sections") > 0)
    prompt = F.when(local, F.concat(F.lit(LOCAL_PROMPT), text)).when(rewrite, F.concat(F.lit(REWRITE_PROMPT), text))

    untouched = scored.where(~F.coalesce(local | rewrite, F.lit(False)))
    asked = scored.where(local | rewrite).withColumn("__reply", _rewrite_udf(rewriter)(prompt))
    first = F.get("sections", F.lit(0))
    fixed = asked.withColumn("repaired", sections_of_reply(F.col("__reply"), first, "repaired"))
    ok = F.coalesce(F.size("repaired"), F.lit(0)) > 0
    done = fixed.select(
        *[c for c in scored.columns if c not in ("quality_score", "needs_fix", "issues")],
        F.when(ok, F.round(stage_1(F.col("repaired")), 6)).otherwise(F.col("quality_score")).alias("quality_score"),
        (~ok).alias("needs_fix"),
        F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.lit(ISSUE_FAILED))).alias("issues"),
        "repaired",
    )
    return untouched.withColumn("repaired", F.lit(None).cast(f"array<{SECTION}>")).unionByName(done)
