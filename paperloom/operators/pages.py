"""From the lines of recognised pages to items: the page operators in one plan, all pages at once.

Furniture goes, markers are found, those in small print of figures and those that number choices go, columns and regions
follow, each region ends where its content does, and its lines become an item's stem and choices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.choices import let, split_lines
from ..functions.exam_text import MARKS
from ..functions.text import WS
from ..session import staged
from . import segment as S

#: Fixed value: a marker that can number a choice.
NUMERIC_CHOICE = rf"^{WS}*([1-5])[.)]({WS}|$)"
_PAGE = ["doc_id", "page"]
_LANE = "struct<x:double,number:int,bottom:double,next:int,choice_bottom:double>"


def page_lines(pages: DataFrame) -> DataFrame:
    """doc_id, page, page_width, page_height, line_no, text and box of each line of a page table."""
    line = F.explode("lines").alias("line")
    return pages.select(*_PAGE, "page_width", "page_height", line).select(*_PAGE, "page_width", "page_height", "line.line_no", "line.text", "line.box")


def page_figures(pages: DataFrame) -> DataFrame:
    """doc_id, page, page_width, page_height, ord and figure of each figure of a page table."""
    return pages.select(*_PAGE, "page_width", "page_height", F.posexplode("figures").alias("ord", "figure")).withColumn("ord", F.col("ord").cast("long"))


def in_figures(marks: DataFrame, figures: DataFrame, margin: float = 2.0, share: float = 0.20) -> DataFrame:
    """Markers with in_figure: whether a figure of at most this share of the page holds the whole marker."""
    small = figures.where(S.area(F.col("figure")) <= F.greatest(F.lit(1.0), F.col("page_width") * F.col("page_height")) * share).select(*_PAGE, "figure")
    b, f = F.col("box"), F.col("figure")
    holds = (b["left"] >= f["left"] - margin) & (S.right(b) <= S.right(f) + margin) & (b["top"] >= f["top"] - margin) & (S.bottom(b) <= S.bottom(f) + margin)
    inside = marks.join(small, _PAGE).where(holds).select(*_PAGE, "line_no").distinct().withColumn("in_figure", F.lit(True))
    return marks.join(inside, [*_PAGE, "line_no"], "left").withColumn("in_figure", F.coalesce("in_figure", F.lit(False)))


def _run_ahead(marks: Column, at: Column, run_gap: Column, lane: Column) -> Column:
    """Whether the marks after this one go on counting in its lane: to two numbers more, without a wide gap."""
    first = F.get(marks, at)
    state = F.struct(first["number"].alias("number"), first["bottom"].alias("bottom"), F.lit(1).alias("found"), F.lit(False).alias("over"))

    def seen(s: Column, m: Column) -> Column:
        near, wide = F.abs(m["left"] - first["left"]) <= lane, m["top"] - s["bottom"] > run_gap
        goes = ~wide & near & m["choice"] & (m["number"] == s["number"] + 1)
        stops = near & ~goes
        return F.when(s["over"] | (s["found"] >= 3) | ~near, s).otherwise(
            F.struct(F.when(goes, m["number"]).otherwise(s["number"]).alias("number"), F.when(goes, m["bottom"]).otherwise(s["bottom"]).alias("bottom"), F.when(goes, s["found"] + 1).otherwise(s["found"]).alias("found"), stops.alias("over"))
        )

    return F.aggregate(F.slice(marks, at + 2, F.greatest(F.size(marks), F.lit(1))), state, seen)["found"] >= 3


def without_choice_numbers(marks: DataFrame) -> DataFrame:
    """Markers that begin questions: those that count on as choices under a question in its lane go.

    Lanes follow their markers by a fifth of the way. A marker of 1 to 5 under a question is a choice if it is close and is
    the number that is due, or close and no larger than the question's, or 1 with a run of 1, 2, 3 ahead. A fold over the
    markers of one page, in reading order.
    """
    one = F.struct("box.top", "box.left", "line_no", S.bottom(F.col("box")).alias("bottom"), F.col("number").cast("int").alias("number"), F.col("text").rlike(NUMERIC_CHOICE).alias("choice"))
    pages = marks.groupBy(*_PAGE).agg(F.sort_array(F.collect_list(one)).alias("marks"), F.first("page_width").alias("w"), F.first("page_height").alias("h"))
    lane, gap, run_gap = F.greatest(F.lit(42.0), F.col("w") * 0.035), F.greatest(F.lit(80.0), F.col("h") * 0.075), F.greatest(F.lit(70.0), F.col("h") * 0.045)
    lists = pages.select(*_PAGE, F.struct(lane.alias("lane"), gap.alias("gap")).alias("most"), F.transform("marks", lambda m, i: F.struct(
        m["top"].alias("top"), m["left"].alias("left"), m["line_no"].alias("line_no"), m["bottom"].alias("bottom"), m["number"].alias("number"), m["choice"].alias("choice"),
        F.when(m["choice"] & (m["number"] == 1), _run_ahead(F.col("marks"), i, run_gap, lane)).otherwise(F.lit(False)).alias("ahead"),
    )).alias("marks"))
    none = F.lit(None)

    def decided(state: Column, m: Column, place: Column) -> Column:
        """place: of the marker's lane, from 1 (null: a new lane); the nearest one, of equals the last."""
        old = F.get(state["lanes"], place - 1)
        x = F.when(place.isNull(), m["left"]).otherwise(old["x"] * 0.8 + m["left"] * 0.2)
        close = F.coalesce(m["top"] - F.coalesce(old["choice_bottom"], old["bottom"]) <= state["most"]["gap"], F.lit(False))
        small = F.coalesce(m["number"] <= old["number"], F.lit(False))
        choice = m["choice"] & old["number"].isNotNull() & ((close & F.coalesce(m["number"] == old["next"], F.lit(False))) | (close & small) | (small & m["ahead"]))

        def told(c: Column) -> Column:
            as_choice = F.struct(x.alias("x"), old["number"].alias("number"), old["bottom"].alias("bottom"), F.when(m["number"] < 5, m["number"] + 1).alias("next"), m["bottom"].alias("choice_bottom"))
            as_question = F.struct(x.alias("x"), m["number"].alias("number"), m["bottom"].alias("bottom"), none.cast("int").alias("next"), none.cast("double").alias("choice_bottom"))
            new = F.when(c, as_choice.cast(_LANE)).otherwise(as_question.cast(_LANE))
            lanes = F.when(place.isNull(), F.concat(state["lanes"], F.array(new))).otherwise(F.transform(state["lanes"], lambda old_one, i: F.when(i == place - 1, new).otherwise(old_one)))
            return F.struct(lanes.alias("lanes"), F.when(c, state["kept"]).otherwise(F.concat(state["kept"], F.array(m["line_no"]))).alias("kept"), state["most"].alias("most"))

        return let(F.coalesce(choice, F.lit(False)), told)

    def step(state: Column, m: Column) -> Column:
        away = F.transform(state["lanes"], lambda one_lane: F.abs(one_lane["x"] - m["left"]))
        place = let(away, lambda d: F.when(F.array_min(d) <= state["most"]["lane"], F.size(d) + 1 - F.array_position(F.reverse(d), F.array_min(d)).cast("int")))
        return let(place, lambda p: decided(state, m, p))

    start = F.struct(F.array().cast(f"array<{_LANE}>").alias("lanes"), F.array().cast("array<int>").alias("kept"), F.col("most"))
    kept = lists.select(*_PAGE, F.explode(F.aggregate("marks", start, step)["kept"]).alias("line_no"))
    return marks.join(kept, [*_PAGE, "line_no"], "left_semi")


def question_regions(marks: DataFrame) -> DataFrame:
    """region_id, number, column, region (to the next marker of the column) and until of each question of a page."""
    order = W.partitionBy(*_PAGE).orderBy("box.top", "box.left", "line_no")
    named = marks.withColumns({"id": F.row_number().over(order), "x": F.col("box.left") + F.col("box.width") / 2, "mark_top": F.col("box.top")})
    split = S.column_split(named.withColumn("top", F.col("mark_top")), _PAGE)
    after = F.lead("mark_top").over(W.partitionBy(*_PAGE, "column").orderBy("mark_top", "id"))
    two = F.max("column").over(W.partitionBy(*_PAGE)) > 0
    h, w = F.col("page_height"), F.col("page_width")
    top = F.greatest(F.lit(0.0), F.col("mark_top") - F.greatest(F.lit(10.0), h * 0.006))
    until = F.when(F.col("next_top").isNull(), h).otherwise(F.least(h, F.greatest(F.col("top") + 40, F.col("next_top") - F.greatest(F.lit(8.0), h * 0.004))))
    out = split.withColumns({"next_top": after, "two": two}).withColumn("top", top).withColumn("until", until)
    left = F.when(F.col("two") & (F.col("column") == 1), w / 2).otherwise(F.lit(0.0))
    width = F.when(F.col("two"), w / 2).otherwise(w)
    region = F.struct(left.alias("left"), F.col("top"), width.alias("width"), (F.col("until") - F.col("top")).alias("height"))
    region_id = F.concat_ws("/", "doc_id", F.col("page").cast("string"), F.col("id").cast("string"))
    return out.select(*_PAGE, "page_width", "page_height", region_id.alias("region_id"), "number", "column", region.alias("region"), "until", F.col("line_no").alias("marker_line"), "text")


def recognised(pages: DataFrame) -> DataFrame:
    """doc_id, page, position (in reading order), column, number, box, stem and choices of every question of a page table.

    Pages without a marker give no item. Figures are taken as the pages tell them; strokes are merged before. The marker's
    line comes first, then the region's lines from top to bottom, without those within a figure that lies in the region.
    What several steps read (lines, figures, regions and the lines of each) is written to the shared folder once.
    """
    lines = staged(S.without_furniture(page_lines(pages)), "lines")
    figures = staged(page_figures(pages), "figures")
    marks = S.outside_small_print(in_figures(S.markers(lines), figures).withColumn("height", F.col("box.height")), _PAGE)
    regs = staged(question_regions(without_choice_numbers(marks)), "regions")
    held = staged(S.lines_in_regions(lines.select(*_PAGE, "line_no", F.col("text").alias("said"), F.col("box").alias("line")), regs, _PAGE), "held")
    choice = F.col("said").rlike(rf"^[{MARKS}]") | F.col("said").rlike(NUMERIC_CHOICE)
    heights = held.select("region_id", "line.top", "line.left", "line.height", choice.alias("choice"))
    near = regs.select(*_PAGE, "region_id", F.col("region").alias("held_in")).join(figures, _PAGE)
    ends = S.refined_bottoms(regs, heights, near.select("region_id", "ord", "figure"), "region_id")
    boxed = held.join(ends, "region_id").withColumn("box", F.struct("region.left", "region.top", "region.width", (F.least("page_height", "bottom") - F.col("region.top")).alias("height")))
    boxed = staged(boxed.where(F.col("line.top") <= F.col("bottom") + 2), "boxed")
    f, x, y = F.col("figure"), F.col("line.left") + F.col("line.width") / 2, F.col("line.top") + F.col("line.height") / 2
    drawn = (S.area(f) >= 900) & (S.overlap(f, F.col("box")) >= S.area(f) * 0.6) & x.between(f["left"] - 2, S.right(f) + 2) & y.between(f["top"] - 2, S.bottom(f) + 2)
    inside = boxed.select("region_id", "line_no", "line", "box", "marker_line").where("line_no <> marker_line").join(near.select("region_id", "figure"), "region_id").where(drawn).select("region_id", "line_no").distinct()
    left = boxed.join(inside, ["region_id", "line_no"], "left_anti")
    order = F.struct((F.col("line_no") != F.col("marker_line")).alias("after"), "line.top", "line.left", "line_no", F.trim("said").alias("said"))
    items = left.groupBy(*_PAGE, "region_id", "number", "column", "box").agg(F.transform(F.sort_array(F.collect_list(order)), lambda r: r["said"]).alias("said"))
    place = F.row_number().over(W.partitionBy(*_PAGE).orderBy("column", "box.top", "region_id"))
    parts = items.withColumn("parts", split_lines(F.col("said")))
    return parts.select(*_PAGE, place.alias("position"), "column", "number", "box", F.col("parts.stem").alias("stem"), F.col("parts.choices").alias("choices"))
