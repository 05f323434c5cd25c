"""Conversion quality of one document, from its section array (no shuffle: a document is one row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.arrays import let
from loomdex.functions.text import lines, strip

# Thresholds, weights and issue texts of the quality rules.
PASS_SCORE = 0.8
LOCAL_FIX_SCORE = 0.5
MAX_BLANK_RUN = 5
MAX_GARBLED_RATE = 0.05
NOT_GARBLED = r"[\x{0}-\x{7F}\x{4E00}-\x{9FFF}\x{3000}-\x{303F}]"
ISSUE_NO_SECTIONS = "无章节内容"
ISSUE_EMPTY = "总字符数为 0（可能提取失败）"
ISSUE_NO_HEADING = "无标题标记（#），结构可能不完整"
ISSUE_BLANK_RUN = ("连续空行过多（", " 行）")
ISSUE_GARBLED = ("乱码率过高（", "）")
ISSUE_INCOMPLETE = "结构不完整（启用 --llm-fix 可尝试 LLM 自动修复）"
ISSUE_LOW = "质量较低（启用 --llm-fix 可尝试 LLM 自动修复）"


def garbled_chars(text: Column) -> Column:
    """Characters above U+007F outside the CJK ideograph and CJK punctuation ranges."""
    return F.length(F.regexp_replace(text, NOT_GARBLED, ""))


def longest_blank_run(all_lines: Column) -> Column:
    """Longest run of consecutive blank lines."""

    def step(acc: Column, line: Column) -> Column:
        run = F.when(strip(line) == "", acc["run"] + F.lit(1)).otherwise(F.lit(0))
        return let(run, lambda r: F.struct(r.alias("run"), F.greatest(acc["best"], r).alias("best")))

    return F.aggregate(
        all_lines, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda acc: acc["best"]
    )


def stage_0(sections: Column) -> Column:
    """Hard checks: ``struct<total_chars,blank_run,garbled,garbled_rate,score,issues,passed>``."""
    contents = F.transform(sections, lambda s: F.coalesce(s["content"], F.lit("")))
    measured = F.struct(
        F.aggregate(contents, F.lit(0).cast("bigint"), lambda n, c: n + F.length(c)).alias("chars"),
        F.aggregate(contents, F.lit(0).cast("bigint"), lambda n, c: n + garbled_chars(c)).alias("garbled"),
        longest_blank_run(F.flatten(F.transform(contents, lines))).alias("blank_run"),
        (
            ~F.exists(sections, lambda s: F.coalesce(s["heading_level"], F.lit(1)) >= 1) & (F.size(sections) > 1)
        ).alias("no_heading"),
    )

    def judge(m: Column) -> Column:
        rate = F.when(m["chars"] > 0, m["garbled"] / m["chars"]).otherwise(F.lit(0.0))
        score = (
            F.when(m["chars"] == 0, F.lit(0.0))
            .when(m["no_heading"] & (m["blank_run"] > MAX_BLANK_RUN), F.lit(0.5))
            .when(m["no_heading"], F.lit(0.7))
            .when(m["blank_run"] > MAX_BLANK_RUN, F.lit(0.8))
            .otherwise(F.lit(1.0))
        )
        issues = F.array_compact(
            F.array(
                F.when(m["chars"] == 0, F.lit(ISSUE_EMPTY)),
                F.when(m["no_heading"], F.lit(ISSUE_NO_HEADING)),
                F.when(
                    m["blank_run"] > MAX_BLANK_RUN,
                    F.concat(F.lit(ISSUE_BLANK_RUN[0]), m["blank_run"].cast("string"), F.lit(ISSUE_BLANK_RUN[1])),
                ),
                F.when(
                    rate > MAX_GARBLED_RATE,
                    F.concat(F.lit(ISSUE_GARBLED[0]), F.format_string("%.1f%%", rate * 100), F.lit(ISSUE_GARBLED[1])),
                ),
            )
        )
        return F.struct(
            m["chars"].alias("total_chars"),
            m["blank_run"].alias("blank_run"),
            m["garbled"].alias("garbled"),
            rate.alias("garbled_rate"),
            score.alias("score"),
            issues.alias("issues"),
            (F.size(issues) == 0).alias("passed"),
        )

    return let(measured, judge)


def heading_score(sections: Column) -> Column:
    levels = F.array_distinct(F.transform(sections, lambda s: F.coalesce(s["heading_level"], F.lit(1))))
    has_top = F.exists(sections, lambda s: F.coalesce(s["heading_level"] == 1, F.lit(False)))
    return (
        F.lit(0.5)
        + F.when(has_top, F.lit(0.2)).otherwise(F.lit(0.0))
        + F.when(F.size(levels) > 1, F.lit(0.3)).otherwise(F.lit(0.0))
    )


def length_score(sections: Column) -> Column:
    total = F.aggregate(
        sections, F.lit(0).cast("bigint"), lambda n, s: n + F.length(F.coalesce(s["content"], F.lit("")))
    )
    return let(
        total / F.size(sections),
        lambda avg: F.when((avg >= 100) & (avg <= 5000), F.lit(1.0)).when(avg < 10, F.lit(0.3)).otherwise(F.lit(0.7)),
    )


def media_score(sections: Column) -> Column:
    has_media = F.exists(
        sections,
        lambda s: F.coalesce(
            F.map_contains_key(s["metadata"], "tables") | F.map_contains_key(s["metadata"], "images"), F.lit(False)
        ),
    )
    return F.when(has_media, F.lit(0.8)).otherwise(F.lit(1.0))


def metadata_score(sections: Column) -> Column:
    complete = F.filter(
        sections,
        lambda s: F.coalesce(
            F.map_contains_key(s["metadata"], "source") & F.map_contains_key(s["metadata"], "page_range"), F.lit(False)
        ),
    )
    return F.size(complete) / F.size(sections)


def stage_1(sections: Column) -> Column:
    """Weighted heuristic score of a document with at least one section."""
    return (
        heading_score(sections) * 0.3
        + length_score(sections) * 0.3
        + media_score(sections) * 0.2
        + metadata_score(sections) * 0.2
    )


def quality(sections: Column) -> Column:
    """``struct<score,stage,needs_fix,issues>``: stage 0 fails hard, then the score picks pass, local fix or rewrite."""

    def result(score: Column, stage: int, fix: bool, issues: Column) -> Column:
        return F.struct(
            score.alias("score"), F.lit(stage).alias("stage"), F.lit(fix).alias("needs_fix"), issues.alias("issues")
        )

    none = F.array().cast("array<string>")

    def route(pair: Column) -> Column:
        hard, soft = pair["hard"], F.round(pair["soft"], 6)
        return (
            F.when(~hard["passed"], result(hard["score"], 0, True, hard["issues"]))
            .when(soft >= PASS_SCORE, result(soft, 1, False, none))
            .when(soft >= LOCAL_FIX_SCORE, result(soft, 2, True, F.array(F.lit(ISSUE_INCOMPLETE))))
            .otherwise(result(soft, 3, True, F.array(F.lit(ISSUE_LOW))))
        )

    empty = F.coalesce(F.size(sections), F.lit(0)) == 0
    return F.when(empty, result(F.lit(0.0), 3, True, F.array(F.lit(ISSUE_NO_SECTIONS)))).otherwise(
        let(F.struct(stage_0(sections).alias("hard"), stage_1(sections).alias("soft")), route)
    )
