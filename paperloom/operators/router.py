"""Page diagnostics, risk scores and routes of recognised pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, stripped, text

RED, YELLOW = 0.66, 0.33
#: Points of each sign, by diagnosis.
SEGMENTATION = {"sparse": 0.48, "unreliable_markers": 0.52, "large_blocks": 0.4, "document_split": 0.12, "few_candidates": 0.18, "fallback": 0.5}
RECOGNITION = {"disabled": 0.34, "textless": 0.4, "low_confidence": 0.45, "low_average": 0.3}
GROUPING = {"no_markers": 0.45, "conflicts": 0.48, "fallback": 0.52, "one_per_block": 0.42, "merged": 0.7, "full_page_image": 0.6}


def page_diagnostics(blocks: DataFrame, by: list[str], order: str | None = None) -> DataFrame:
    """Per page: counts and ratios of blocks (area_ratio, confidence, text, backend); ratios divide by at least 1.

    With ``order``, a column that numbers a page's blocks, confidences are added in that order: sums of other orders differ in
    their last digit, and with it a mean at a threshold would fall to either side by how the rows are partitioned.
    """
    n = F.count(F.lit(1))
    mean = F.avg("confidence")
    if order:
        told = F.sort_array(F.collect_list(F.when(F.col("confidence").isNotNull(), F.struct(order, "confidence"))))
        mean = F.when(F.size(told) > 0, F.aggregate(told, F.lit(0.0), lambda s, x: s + x["confidence"]) / F.size(told))
    ratio = lambda c: F.count_if(c) / F.greatest(n, F.lit(1))
    return blocks.groupBy(*by).agg(
        n.alias("blocks"), ratio(F.col("area_ratio") >= 0.5).alias("large_ratio"), F.max("area_ratio").alias("largest"),
        ratio(F.coalesce(F.col("confidence") < 0.5, F.lit(False))).alias("low_confidence_ratio"), ratio(text("text") == "").alias("empty_ratio"),
        mean.alias("avg_confidence"),
    )


def backend_histogram(blocks: DataFrame, by: list[str]) -> DataFrame:
    return blocks.groupBy(*by, "backend").agg(F.count(F.lit(1)).alias("n"))


def points(signs: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of the points of the signs that hold, within 0 and 1, to four digits."""
    total = None
    for name, c in signs.items():
        p = F.when(F.coalesce(c, F.lit(False)), F.lit(weights[name])).otherwise(F.lit(0.0))
        total = p if total is None else total + p
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)), 4)


def segmentation_risk(d: Column | None = None, trusted: Column | None = None, markers_reliable: Column | None = None, split: Column | None = None, candidates: Column | None = None, fallbacks: Column | None = None) -> Column:
    no = F.lit(False)
    trusted = no if trusted is None else trusted
    return points(
        {
            "sparse": (F.col("blocks") <= 1) & ~trusted,
            "unreliable_markers": no if markers_reliable is None else ~markers_reliable,
            "large_blocks": ~trusted & ((F.col("large_ratio") >= 0.5) | (F.col("largest") >= 0.72)),
            "document_split": no if split is None else split,
            "few_candidates": no if candidates is None else candidates == 1,
            "fallback": no if fallbacks is None else fallbacks > 0,
        },
        SEGMENTATION,
    )


def recognition_risk(disabled: Column | None = None) -> Column:
    return points(
        {
            "disabled": F.lit(False) if disabled is None else disabled,
            "textless": F.col("empty_ratio") >= 0.5,
            "low_confidence": F.col("low_confidence_ratio") >= 0.5,
            "low_average": F.col("avg_confidence") < 0.55,
        },
        RECOGNITION,
    )


def grouping_risk(markers: Column, problems: Column, conflicts: Column, fallback: Column, merged: Column, image: Column, trusted: Column) -> Column:
    many = F.col("blocks") > 1
    return points(
        {
            "no_markers": many & (markers == 0) & ~trusted,
            "conflicts": conflicts > 0,
            "fallback": (fallback > 0) & ~trusted,
            "one_per_block": many & (problems == F.col("blocks")) & ~trusted,
            "merged": merged > 0,
            "full_page_image": image,
        },
        GROUPING,
    )


def tier(risk: Column) -> Column:
    return F.when(risk >= RED, "red").when(risk >= YELLOW, "yellow").otherwise("green")


def route(tier: Column, ai: Column, forced: Column) -> Column:
    """route and next_best_action of a page."""
    use = ai & (forced | tier.isin("red", "yellow"))
    path = F.when(use, "ai_patch").otherwise("local_only")
    best = F.when(use & (forced | (tier == "red")), F.lit(None)).when(tier == "red", "ai_repair").when(tier == "yellow", "local_retry")
    return F.struct(path.alias("route"), best.alias("next_best_action"), F.when(tier == "red", "failed").when(tier == "yellow", "suspicious").otherwise("ok").alias("quality_status"))


#: What shows a formula, a choice and a section.
FORMULA_SIGNS = ("=", "lim", "sin", "cos", "tan", "log", "∫", "∑", "√", "≤", "≥", "확률", "함수", "미분", "적분")
CHOICE_SIGNS = ("①", "②", "③", "④", "⑤", "❶", "❷", "❸", "❹", "❺", "➀", "➁", "➂", "➃", "➄", "1)", "2)", "3)", "4)", "5)", "A.", "B.", "C.", "D.")
SECTION_ENDS = ("장", "단원", "주제")


def block_kind(value: Column) -> Column:
    """Kind of a text block; the order of the tests matters."""
    v = stripped(text(value))
    some = lambda test, words: F.array_max(F.array(*[test(v, F.lit(w)) for w in words]))
    return (
        F.when(v == "", "unknown")
        .when(some(F.contains, FORMULA_SIGNS), "formula")
        .when(some(F.startswith, CHOICE_SIGNS), "choice")
        .when((F.length(v) <= 24) & some(F.endswith, SECTION_ENDS), "section")
        .otherwise("stem")
    )


def pdf_failure(size: Column, encrypted: Column, readable: Column, pages: Column, chars: Column) -> Column:
    """Why a PDF can't be recognised: empty, encrypted, damaged, or a scan (fewer than 20 characters a page)."""
    return F.when(size == 0, "empty").when(encrypted, "encrypted").when(~readable | (pages == 0), "damaged").when(chars / F.greatest(pages, F.lit(1)) < 20, "scan_only").otherwise("ok")


def unreadable_share(value: Column, recoverable: str = "") -> Column:
    """Private-use characters that no map recovers, per character that isn't white space."""
    dense = F.regexp_replace(text(value), WS + "+", "")
    lost = F.length(F.regexp_replace(dense, r"[^\x{E000}-\x{F8FF}]" + (f"|[{recoverable}]" if recoverable else ""), ""))
    return F.when(F.length(dense) > 0, lost / F.length(dense)).otherwise(F.lit(0.0))
