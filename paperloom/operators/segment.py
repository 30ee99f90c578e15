"""Pages to questions: markers, columns, regions, groups and the geometry between boxes, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS, stripped, text


def right(b: Column) -> Column:
    return b["left"] + b["width"]


def bottom(b: Column) -> Column:
    return b["top"] + b["height"]


def area(b: Column) -> Column:
    return F.greatest(b["width"], F.lit(0.0)) * F.greatest(b["height"], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection."""
    w = F.least(right(a), right(b)) - F.greatest(a["left"], b["left"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["top"], b["top"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union_box(a: Column, b: Column) -> Column:
    left, top = F.least(a["left"], b["left"]), F.least(a["top"], b["top"])
    return F.struct(left.alias("left"), top.alias("top"), (F.greatest(right(a), right(b)) - left).alias("width"), (F.greatest(bottom(a), bottom(b)) - top).alias("height"))


def near(a: Column, b: Column, gap: float) -> Column:
    return (a["left"] <= right(b) + gap) & (b["left"] <= right(a) + gap) & (a["top"] <= bottom(b) + gap) & (b["top"] <= bottom(a) + gap)


def centre_in(a: Column, b: Column) -> Column:
    x, y = a["left"] + a["width"] / 2, a["top"] + a["height"] / 2
    return x.between(b["left"], right(b)) & y.between(b["top"], bottom(b))


def normalised(b: Column, width: Column, height: Column) -> Column:
    return F.struct((b["left"] / width).alias("left"), (b["top"] / height).alias("top"), (b["width"] / width).alias("width"), (b["height"] / height).alias("height"))


def expanded(b: Column, by: float, width: Column, height: Column) -> Column:
    """A box grown on all sides, within the page."""
    left, top = F.greatest(b["left"] - by, F.lit(0.0)), F.greatest(b["top"] - by, F.lit(0.0))
    return F.struct(left.alias("left"), top.alias("top"), (F.least(right(b) + by, width) - left).alias("width"), (F.least(bottom(b) + by, height) - top).alias("height"))


def units(px: Column, dpi: Column) -> Column:
    """Pixels in units of 1/7200 inch; no dpi gives 0."""
    return F.when(dpi > 0, F.bround(px * 7200 / dpi, 0).cast("long")).otherwise(F.lit(0).cast("long"))


#: What shows a date, a header and a footer line, and what begins a question.
DATE = r"^[0-9]{2,4}\s*[.\-/]?\s*[0-9]{1,2}\s*[.\-/]?\s*[0-9]{1,2}\."
HALF_DAYS = ("오전", "오후", "AM", "PM")
HEADER_WORDS = ("年", "월", "교시", "점]", "학년도", "모의평가")
FOOTER_WORDS = ("저작권", "한국교육과정평가원")
MARKER = rf"^([1-9][0-9]?)[.)]({WS}|$)"
TOP_BAND, FOOT_BAND = 0.05, 0.90


def holds(c: Column, words: tuple[str, ...]) -> Column:
    return F.array_max(F.array(*[F.contains(c, F.lit(w)) for w in words]))


def dated(c: Column) -> Column:
    """A line of a print date: a date at its start, or a time of day in a line that begins with a digit and has three numbers."""
    t = stripped(text(c))
    return t.rlike(DATE) | (holds(t, HALF_DAYS) & t.rlike("^[0-9]") & (F.regexp_count(t, F.lit("[0-9]+")) >= 3))


def header_band(c: Column, top: Column, page_height: Column) -> Column:
    return (top < page_height * TOP_BAND) & holds(text(c), HEADER_WORDS)


def footer_band(c: Column, top: Column, page_height: Column) -> Column:
    t = stripped(text(c))
    return holds(t, FOOTER_WORDS) | ((top >= page_height * FOOT_BAND) & t.rlike(r"^[0-9]{1,3}$"))


def markers(lines: DataFrame) -> DataFrame:
    """Lines that begin a question: ``12.`` or ``12)`` before white space or the end, 1 to 99, taller than a hair, no date and no header."""
    number = F.regexp_extract("text", MARKER, 1)
    odd = dated(F.col("text")) | header_band(F.col("text"), F.col("box.top"), F.col("page_height"))
    return lines.where((number != "") & ~odd & (F.col("box.height") > 0.5)).withColumn("number", number.cast("int"))


def without_furniture(lines: DataFrame) -> DataFrame:
    """Lines without page numbers at the foot and copyright lines; dates and header lines are marked, since they only begin no question."""
    t, top, height = F.col("text"), F.col("box.top"), F.col("page_height")
    return lines.where(~footer_band(t, top, height)).withColumns({"dated": dated(t), "header": header_band(t, top, height)})


def column_split(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Column (0 or 1) of each marker: markers beyond the largest gap between centres (the first of equal ones) are in the
    second, if the gap is wide enough. A second column's bounds begin at the page's middle, not at the gap."""
    w = W.partitionBy(*keys)
    order = [c for c in ("x", "id", "top") if c in marks.columns]
    placed = marks.withColumn("_place", F.row_number().over(w.orderBy(*order)))
    gap = F.struct((F.lead("x").over(w.orderBy(*order)) - F.col("x")).alias("gap"), (-F.col("_place")).alias("after"))
    widest = F.max(F.when(F.col("_gap.gap").isNotNull(), F.col("_gap"))).over(w)
    out = placed.withColumn("_gap", gap).withColumn("_widest", widest)
    second = (F.col("_widest.gap") >= F.greatest(F.lit(80.0), F.col("page_width") * 0.18)) & (F.col("_place") > -F.col("_widest.after"))
    return out.withColumn("column", F.when(second, 1).otherwise(0)).drop("_place", "_gap", "_widest")


def regions(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Each question reaches to the next marker of its column, or to the page's end."""
    after = F.lead("top").over(W.partitionBy(*keys, "column").orderBy("top", "id"))
    return marks.withColumn("until", F.coalesce(after, F.col("page_height").cast("double")))


def lines_in_regions(lines: DataFrame, regs: DataFrame, keys: list[str], slack: float = 6.0, touch: float = 2.0) -> DataFrame:
    """Lines whose centre lies within a region's sides and whose height overlaps it or comes as near as ``touch``; the join is on the page, the rest a band."""
    x = F.col("line.left") + F.col("line.width") / 2
    inside = x.between(F.col("region.left") - slack, right(F.col("region")) + slack)
    level = (bottom(F.col("line")) >= F.col("region.top") - touch) & (F.col("line.top") <= bottom(F.col("region")) + touch)
    return lines.join(regs, keys).where(inside & level)


def figures_of(figures: DataFrame, regs: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """Figures of which most lies in a region."""
    return figures.join(regs, keys).where(overlap(F.col("figure"), F.col("region")) >= share * area(F.col("figure")))


def smallest_container(points: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """For each point the smallest figure that contains it."""
    holds = F.col("x").between(F.col("figure.left"), right(F.col("figure"))) & F.col("y").between(F.col("figure.top"), bottom(F.col("figure")))
    return points.join(figures, keys).where(holds).groupBy(*keys, "point_id").agg(F.min_by("figure_id", F.struct(area(F.col("figure")).alias("a"), "figure_id")).alias("figure_id"))


def owner(boxes: DataFrame, regs: DataFrame, keys: list[str]) -> DataFrame:
    """For each box the region that it overlaps most; of equal ones the first."""
    both = boxes.join(regs, keys).withColumn("_a", overlap(F.col("box"), F.col("region"))).where("_a > 0")
    return both.groupBy(*keys, "box_id").agg(F.max_by("region_id", F.struct(F.col("_a"), -F.col("ord"))).alias("region_id"))


def characters_inside(chars: DataFrame, figures: DataFrame, keys: list[str]) -> DataFrame:
    """How many characters lie in each figure."""
    holds = F.col("x").between(F.col("figure.left"), right(F.col("figure"))) & F.col("y").between(F.col("figure.top"), bottom(F.col("figure")))
    found = chars.join(figures, keys).where(holds).groupBy(*keys, "figure_id").agg(F.count(F.lit(1)).alias("chars"))
    return figures.join(found, [*keys, "figure_id"], "left").select(*keys, "figure_id", "figure", F.coalesce("chars", F.lit(0)).alias("chars"))


def figure_candidates(counted: DataFrame) -> DataFrame:
    return counted.where((area(F.col("figure")) >= 22000) & (F.col("figure.width") >= 60) & (F.col("figure.height") >= 60) & (F.col("chars") < 24))


def outside_small_print(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Markers without those in small figures that are clearly smaller than the median of the others."""
    median = F.percentile(F.when(~F.col("in_figure"), F.col("height")), 0.5).over(W.partitionBy(*keys))
    return marks.withColumn("_m", median).where(~(F.col("in_figure") & F.coalesce(F.col("height") <= 0.92 * F.col("_m"), F.lit(False)))).drop("_m")


def forward_match(passages: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """Each passage (start, page) with the first question in reading order that has its number, on its page or later."""
    q = questions.select(*keys, F.col("number").alias("start"), F.col("page").alias("_page"), F.col("ord").alias("_ord"), F.col("question_id"))
    found = passages.join(q, [*keys, "start"]).where(F.col("_page") >= F.col("page")).groupBy(*keys, "passage_id").agg(F.min_by("question_id", "_ord").alias("question_id"))
    return passages.join(found, [*keys, "passage_id"], "left")


def union_area(boxes: DataFrame, key: str) -> DataFrame:
    """Exact area of the union of boxes (left, right, top, bottom) of each key: slabs between neighbouring edges, merged within each slab."""
    edges = boxes.select(key, F.explode(F.array("left", "right")).alias("x")).distinct()
    slabs = edges.withColumn("x2", F.lead("x").over(W.partitionBy(key).orderBy("x"))).where("x2 is not null")
    inside = slabs.join(boxes, key).where((F.col("left") <= F.col("x")) & (F.col("right") >= F.col("x2")))
    before = F.max("bottom").over(W.partitionBy(key, "x").orderBy("top", "bottom").rowsBetween(W.unboundedPreceding, -1))
    length = F.greatest(F.lit(0.0), F.col("bottom") - F.greatest(F.col("top"), F.coalesce(before, F.col("top"))))
    parts = inside.withColumn("_a", length * (F.col("x2") - F.col("x")))
    return boxes.select(key).distinct().join(parts.groupBy(key).agg(F.sum("_a").alias("area")), key, "left").select(key, F.coalesce("area", F.lit(0.0)).alias("area"))


def grouped_runs(rows: DataFrame, start: Column, by: str, order: str) -> DataFrame:
    """Running group of each row: a start opens one; rows before the first start belong to the first group that follows (0 becomes 1)."""
    n = F.sum(start.cast("long")).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("group", F.greatest(n, F.lit(1)))


def variants(rows: DataFrame, by: str, order: str, number: str = "number") -> DataFrame:
    """Variant of each number: one more whenever the number doesn't rise; id ``v{variant}:q{number:02d}``."""
    w = W.partitionBy(by).orderBy(order)
    back = F.coalesce((F.col(number) <= F.lag(number).over(w)).cast("long"), F.lit(0))
    out = rows.withColumn("_back", back).withColumn("variant", F.sum("_back").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + 1).drop("_back")
    return out.withColumn("variant_id", F.concat(F.lit("v"), F.col("variant"), F.lit(":q"), F.lpad(F.col(number).cast("string"), 2, "0")))


def question_groups(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Number of the last question at or before each row (null before the first), with its variant."""
    q = variants(rows.where("number is not null"), by, order).select(by, order, "variant_id")
    last = F.last("variant_id", ignorenulls=True).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.join(q, [by, order], "left").withColumn("group_id", last).drop("variant_id")


def repaired_number(rows: DataFrame, by: str, order: str) -> DataFrame:
    """A section of three or more numbers that should rise by one from its first, and that has one missing and one repeated
    number: where the missing one belongs stands the repeated one, it is put right; all else stays."""
    section = W.partitionBy(by)
    n = F.count(F.lit(1)).over(section)
    out = rows.withColumns({
        "_place": F.row_number().over(section.orderBy(order)) - 1,
        "_first": F.first("number").over(section.orderBy(order)),
        "_times": F.count(F.lit(1)).over(W.partitionBy(by, "number")),
    })
    out = out.withColumns({"_n": n, "_all": F.collect_set("number").over(section), "_twice": F.collect_set(F.when(F.col("_times") > 1, F.col("number"))).over(section)})
    missing = F.array_except(F.sequence("_first", F.col("_first") + F.col("_n") - 1), "_all")
    here = F.col("_first") + F.col("_place")
    wrong = (F.col("_n") >= 3) & (F.size(missing) == 1) & (F.size("_twice") == 1) & (F.get("_twice", F.lit(0)) == F.col("number")) & (F.get(missing, F.lit(0)) == here)
    return out.withColumn("repaired", F.when(wrong, here).otherwise(F.col("number")).cast("long")).drop("_place", "_first", "_times", "_n", "_all", "_twice")


def without_adjacent_repeats(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    same = F.col(value).eqNullSafe(F.lag(value).over(W.partitionBy(by).orderBy(order)))
    first = F.row_number().over(W.partitionBy(by).orderBy(order)) == 1
    return rows.withColumn("_keep", first | ~same).where("_keep").drop("_keep")


def smoothed(rows: DataFrame, by: str, order: str, value: str, reach: int = 3) -> DataFrame:
    """Moving mean over 2 * reach + 1 places; places beyond the ends count as zero."""
    s = F.sum(value).over(W.partitionBy(by).orderBy(order).rowsBetween(-reach, reach))
    return rows.withColumn("smooth", s / float(2 * reach + 1))


def upper_median(values: Column) -> Column:
    """The element at the middle place, the upper of two."""
    return F.element_at(F.sort_array(values), F.floor(F.size(values) / 2).cast("int") + 1)


def refined_bottoms(regs: DataFrame, lines: DataFrame, figures: DataFrame, by: str) -> DataFrame:
    """by and bottom: where the content of each region (region, until, page_height) ends.

    Lines (top, left, height, choice) count to the last one that begins a choice, and on as long as no gap is too wide for
    their upper median height; without a choice all count. Figures (ord, figure) that follow closely within the region's
    sides are taken in, in their order: at most those of a region, so a fold over an array. A margin is added within the
    region's first bottom, which stays where no line is or too little height would be left.
    """
    w = W.partitionBy(by)
    end = F.col("top") + F.col("height")
    placed = lines.withColumn("_place", F.row_number().over(w.orderBy("top", "left"))).withColumn("_last", F.max(F.when(F.col("choice"), F.col("_place"))).over(w))
    middle = lines.groupBy(by).agg(F.coalesce(upper_median(F.collect_list(F.when(F.col("height") > 0, F.col("height")))), F.lit(18.0)).alias("_h"))
    run = placed.where("_last is null or _place >= _last").join(middle, by).join(regs.select(by, "page_height"), by)
    limit = F.greatest(F.lit(18.0), F.least(F.lit(72.0), F.greatest(F.col("_h") * 2.2, F.col("page_height") * 0.018)))
    before = F.max(end).over(w.orderBy("_place").rowsBetween(W.unboundedPreceding, -1))
    run = run.withColumn("_wide", F.col("_last").isNotNull() & F.coalesce(F.col("top") - before > limit, F.lit(False)))
    run = run.withColumn("_broken", F.max(F.col("_wide").cast("int")).over(w.orderBy("_place").rowsBetween(W.unboundedPreceding, W.currentRow)))
    content = run.where("_broken = 0").groupBy(by).agg(F.max(end).alias("_content"))
    x, r = F.col("figure.left") + F.col("figure.width") / 2, F.col("region")
    fits = x.between(r["left"] - 6, right(r) + 6) & (F.col("figure.width") <= F.greatest(F.lit(1.0), r["width"]) * 1.4)
    drawn = figures.join(regs.select(by, "region"), by).where(fits).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("figure.top").alias("top"), bottom(F.col("figure")).alias("bottom")))).alias("_figures"))
    tail = F.greatest(F.lit(120.0), F.least(F.lit(260.0), F.col("page_height") * 0.12))
    out = regs.join(content, by, "left").join(drawn, by, "left").withColumn("_tail", tail)
    state = F.struct(F.col("_content").alias("at"), F.col("until").alias("until"), F.col("_tail").alias("tail"))

    def taken(a: Column, f: Column) -> Column:
        ok = (f["top"] >= a["at"] - 4) & (f["top"] <= a["until"] + 2) & (f["top"] - a["at"] <= a["tail"])
        return F.struct(F.when(ok, F.greatest(a["at"], F.least(a["until"], f["bottom"]))).otherwise(a["at"]).alias("at"), a["until"].alias("until"), a["tail"].alias("tail"))

    none = F.array().cast("array<struct<ord:bigint,top:double,bottom:double>>")
    content_end = F.aggregate(F.coalesce("_figures", none), state, taken)["at"]
    margin = F.greatest(F.lit(8.0), F.col("page_height") * 0.008)
    fine = F.least(F.col("until"), content_end + margin)
    return out.select(by, F.when(F.coalesce(fine - F.col("region.top") >= 40, F.lit(False)), fine).otherwise(F.col("until")).alias("bottom"))


def placed_cells(cells: DataFrame, by: str, most: int = 20000) -> DataFrame:
    """Grid places of spanned cells (row, col, row_span, col_span): all places of each cell, or, where cells overlap or are too many, only its own."""
    grid = cells.withColumn("_r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))).withColumn("_c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    times = grid.groupBy(by, "_r", "_c").agg(F.count(F.lit(1)).alias("_n"))
    bad = times.groupBy(by).agg((F.max("_n") > 1).alias("_clash"), F.count(F.lit(1)).alias("_cells"))
    own = (F.col("_r") == F.col("row")) & (F.col("_c") == F.col("col"))
    return grid.join(bad, by).where(own | ~(F.col("_clash") | (F.col("_cells") > most))).select(by, F.col("_r").alias("grid_row"), F.col("_c").alias("grid_col"), "cell_id")


def groups_by_end(rows: DataFrame, end: Column, by: str, order: str) -> DataFrame:
    """Group of each row where a group closes with its end mark: the marks before the row."""
    n = F.sum(end.cast("long")).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("group", n - end.cast("long"))


def walked_columns(rows: DataFrame, by: str, order: str, top: str = "top") -> DataFrame:
    """Running column of lines: a line that stands above its predecessor begins a new one."""
    w = W.partitionBy(by).orderBy(order)
    back = F.coalesce((F.col(top) < F.lag(top).over(w)).cast("long"), F.lit(0))
    return rows.withColumn("_back", back).withColumn("column", F.sum("_back").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_back")
