"""Composition of an exam: answer keys, numbering with its issues, answer tables and explanations, heights and the column plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import DASHES, WS, circled_answer, stripped, text, wrapped_lines

TEMPLATE_FIELDS = "key string, columns int, circled_choices boolean, answer_blank boolean, answer_key boolean, inline_short_choices boolean, default_title string"
#: Presets of the engine: a caller can pass any other rows of these fields.
TEMPLATES = [
    ("basic", 1, False, False, False, False, "시험지"),
    ("workbook", 1, True, True, True, False, "학습지"),
    ("mock_exam", 2, True, False, True, True, "모의고사"),
    ("school_exam", 2, True, False, True, True, "정기고사"),
    ("quiz", 1, False, True, False, True, "쪽지 시험"),
    ("answer_sheet", 2, True, False, True, True, "정답지"),
]
CAPACITY, LAST_NUMBER = 100, 999
_RANGE = rf"^{WS}*\[{WS}*\d{{1,3}}{WS}*[{DASHES}]{WS}*\d{{1,3}}{WS}*\]"


def templates(spark) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, TEMPLATE_FIELDS)


def with_template(rows: DataFrame, key: str = "template") -> DataFrame:
    """Rows with their template's fields; an unknown or missing key is the basic one. The table of templates is fixed and small."""
    presets = templates(rows.sparkSession)
    known = [t[0] for t in TEMPLATES]
    chosen = F.when(F.col(key).isin(known), F.col(key)).otherwise(F.lit("basic"))
    return rows.withColumn("_key", chosen).join(F.broadcast(presets.withColumnRenamed("key", "_key")), "_key").withColumnRenamed("_key", "template_key")


def resolved_title(title: Column, key: Column, default: Column, placeholder: str = "시험지") -> Column:
    clean = stripped(text(title))
    return F.when((clean == "") | ((key != "basic") & (clean == placeholder)), default).otherwise(clean)


def with_answer_key(items: DataFrame, key: DataFrame) -> DataFrame:
    """Items (number, answer) with the key's (number, value) where they have none; ``mapped`` tells which."""
    k = key.select("number", F.col("value").alias("_value"))
    fits = F.col("_value").isNotNull() & (text("answer") == "")
    return items.join(k, "number", "left").withColumns({"mapped": fits, "answer": F.when(fits, F.col("_value")).otherwise(F.col("answer"))}).drop("_value")


def key_report(items: DataFrame, key: DataFrame) -> DataFrame:
    """mapped: items that took an answer; unmatched: numbers of the key that no item has."""
    taken = with_answer_key(items, key).agg(F.count_if("mapped").alias("mapped"))
    rest = key.join(items.select("number"), "number", "left_anti").agg(F.count(F.lit(1)).alias("unmatched"))
    return taken.join(F.broadcast(rest))


def unsupported_reason(layout: Column, problem_type: Column, number: Column, stem: Column, choices: Column, images: Column, group_id: Column) -> Column:
    """Why an item can't be renumbered, the first reason that holds, or null.

    layout is a map of strings; an item without a map has an unknown layout.
    """
    has = lambda *keys: _any(*[F.coalesce(layout[k], F.lit("")) != "" for k in keys])
    block = F.coalesce(layout["block_type"], F.lit(""))
    bare = (stripped(text(stem)) == "") & (F.coalesce(F.size(choices), F.lit(0)) <= 0) & (F.coalesce(F.size(images), F.lit(0)) > 0)
    fixed = (block != "problem") & ((has("column_index") & has("source_page")) | has("bbox_px") | has("source_lines"))
    return (
        F.when(layout.isNull(), "unknown_layout")
        .when((text(problem_type) == "passage") | text(number).rlike(_RANGE) | text(stem).rlike(_RANGE), "passage")
        .when((block == "problem_with_shared_passage") | (text(group_id) != "") | has("group_id", "passage_id", "passage_item_id", "member_item_ids", "group", "shared_passage"), "group")
        .when(has("continuation"), "continuation")
        .when(has("source_text_flow"), "source_text_flow")
        .when(has("image_only") | (block == "image_fallback") | bare, "image_only")
        .when(has("source_layout", "preserve_source_layout") | fixed, "source_layout")
    )


def _any(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def numbering_issues(items: DataFrame, mode: str = "preserve", start: int = 1, duplicates_confirmed: bool = False, by: tuple[str, ...] = (), order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Issues of selections (number, reason, in the order of ``order``; one selection for each value of ``by``): what keeps them from being numbered."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    times = F.count(F.lit(1)).over(W.partitionBy(*by, "_number"))  # a column, or its text would be worked out and sorted twice
    marked = items.withColumn("_number", stripped(text(F.col("number").cast("string")))).withColumns({"position": place, "_times": times})
    preserve = F.lit(mode == "preserve")
    issue = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(preserve & (F.col("_number") == ""), "missing_original_number")
        .when(preserve & (F.col("_times") > 1) & ~F.lit(duplicates_confirmed), "duplicate_original_number")
        .when(~preserve & (F.col("position") + (start - 1) > LAST_NUMBER), "number_range_exceeded")
    )
    return marked.withColumn("issue", issue).where("issue is not null").select(*by, "position", F.col("_number").alias("original_number"), "issue")


def renumbered(items: DataFrame, start: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive numbers from ``start`` in the order of pos."""
    return items.withColumn("new_number", (F.row_number().over(W.partitionBy(*by).orderBy("pos")) + (start - 1)).cast("long"))


def without_prefix(stem: Column, number: Column) -> Column:
    """The stem without its own number as a delimited question mark; decimals and other numbers stay."""
    pattern = F.concat(F.lit(r"^[ \t]*(?:문제[ \t]*)?"), number, F.lit(r"[ \t]*[.)](?:[ \t]+|(?=\r?\n|$))"))
    return F.when(number.rlike(r"^\d{1,3}$"), F.regexp_replace(stem, pattern, F.lit(""))).otherwise(stem)


def quick_answer_lines(items: DataFrame, per_line: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Lines of ``number. answer`` entries, per_line of them in a line, in the order of pos."""
    place = F.row_number().over(W.partitionBy(*by).orderBy("pos"))
    entry = F.concat(F.coalesce(F.col("number").cast("string"), place.cast("string")), F.lit(". "), F.when(text("answer") == "", F.lit("－")).otherwise(F.col("answer")))
    rows = items.select(*by, place.alias("_place"), entry.alias("_entry")).withColumn("line", F.floor((F.col("_place") - 1) / per_line).cast("long"))
    return rows.groupBy(*by, "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_place", "_entry"))), lambda x: x["_entry"]), "    ").alias("entries"))


def answer_rows(items: DataFrame, per_row: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of labels and answers, per_row of each; all blocks but the first are padded. Passage labels have no answer and fall away."""
    number = F.col("number").cast("string")
    counted = items.where(~F.coalesce(number.rlike(_RANGE), F.lit(False)))
    place = F.row_number().over(W.partitionBy(*by).orderBy("pos"))
    rows = counted.select(*by, place.alias("_place"), number.alias("_label"), F.when(text("answer") == "", F.lit("－")).otherwise(F.col("answer")).alias("_answer"))
    rows = rows.withColumn("block", F.floor((F.col("_place") - 1) / per_row).cast("long"))
    sorted_rows = F.sort_array(F.collect_list(F.struct("_place", "_label", "_answer")))
    padded = lambda xs, block: F.concat(xs, F.when(block > 0, F.array_repeat(F.lit(""), F.lit(per_row) - F.size(xs))).otherwise(F.array().cast("array<string>")))
    grouped = rows.groupBy(*by, "block").agg(sorted_rows.alias("s"))
    return grouped.select(*by, "block", padded(F.transform("s", lambda x: x["_label"]), F.col("block")).alias("labels"), padded(F.transform("s", lambda x: x["_answer"]), F.col("block")).alias("answers"))


def explanations(items: DataFrame, circled: bool = True) -> DataFrame:
    """Heading and lines of each item that has an explanation."""
    answer = circled_answer(F.col("answer"), F.lit(circled), F.size("choices") > 0)
    heading = F.concat(F.col("number"), F.when(answer == "", F.lit(".")).otherwise(F.concat(F.lit(". 정답 "), answer)))
    return items.where(stripped(text("explanation")) != "").select("pos", heading.alias("heading"), F.split(stripped(F.col("explanation")), "\r\n|\r|\n").alias("lines"))


def wants_answer_key(items: DataFrame, enabled: bool, sheet: bool, *by: str) -> DataFrame:
    """Whether an answer key is appended, of each exam (by), or one row."""
    return items.groupBy(*by).agg((F.lit(enabled and not sheet) & F.coalesce(F.bool_or(stripped(text("answer")) != ""), F.lit(False))).alias("appended"))


def needs_answer_blank(stem: Column, has_choices: Column, template_blank: Column) -> Column:
    return template_blank & ~has_choices & ~text(stem).rlike(r"[(\[][\s＿_]{2,}[)\]]|답\s*[:：]?\s*[(\[]")


def table_height(tables: Column, limit: int) -> Column:
    """Height of tables (rows of cells) whose columns share a line of ``limit`` units."""
    most = lambda rows: F.greatest(F.lit(1), F.array_max(F.transform(rows, lambda r: F.greatest(F.size(r), F.lit(0)))))

    def row(r: Column, room: Column) -> Column:
        lines = F.array_max(F.transform(r, lambda c: wrapped_lines(text(c), room)))
        return 6 + F.greatest(F.lit(1).cast("long"), F.coalesce(lines, F.lit(1).cast("long"))) * 4

    def one(n: Column, rows: Column) -> Column:
        room = F.greatest(F.lit(12), F.floor(limit / most(rows)).cast("int"))
        heights = F.transform(rows, lambda r: row(r, room))
        return n + F.when(F.size(rows) > 0, 4 + F.aggregate(heights, F.lit(0).cast("long"), lambda a, h: a + h)).otherwise(F.lit(0)).cast("long")

    return F.aggregate(F.coalesce(tables, F.array().cast("array<array<array<string>>>")), F.lit(0).cast("long"), one)


def estimated_height(stem: Column, choices: Column, images: Column, columns: int, inline: bool = False, tables: Column | None = None, title: Column | None = None, answer: Column | None = None, explanation: Column | None = None, blank: bool = False) -> Column:
    """Height of an item in hundredths of a column; ``answer`` and ``explanation`` are given where the template prints them,
    ``blank`` where it leaves room for an answer to an item without choices."""
    limit = 48 if columns > 1 else 92
    lines = lambda c: wrapped_lines(c, limit) * 5
    head = F.coalesce(*[F.nullif(text(c), F.lit("")) for c in (stem, title) if c is not None], F.lit("문제"))
    each = F.aggregate(choices, F.lit(0).cast("long"), lambda n, c: n + lines(c))
    short = F.lit(inline) & (F.length(F.array_join(choices, "")) <= 90)
    body = F.when(F.size(choices) > 0, F.when(short, lines(F.array_join(choices, "　　"))).otherwise(each)).otherwise(F.lit(6 if blank else 0))
    whole = F.lit(10) + lines(head) + body + F.greatest(F.size(images), F.lit(0)) * 34
    if tables is not None:
        whole += table_height(tables, limit)
    if answer is not None:
        whole += F.when(text(answer) != "", 6).otherwise(0)
    if explanation is not None:
        whole += F.when(text(explanation) != "", lines(text(explanation))).otherwise(0)
    return F.greatest(F.lit(14), whole).cast("long")


def planned(items: DataFrame, by: str, columns: int = 2) -> DataFrame:
    """The column plan of each selection: items (pos, height) fill columns of 100; one that would overflow starts a new column.

    A fold over each selection's array: a selection is an exam, whose items are at most ``LAST_NUMBER``.
    """
    start = F.struct(F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<pos:bigint,height:bigint,start_slot:bigint,end_slot:bigint,break_before:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        h = x["height"]
        big = h > CAPACITY
        brk = (acc["used"] > 0) & (big | (acc["used"] + h > CAPACITY))
        first = acc["slot"] + brk.cast("long")
        last = first + F.when(big, F.ceil(h / CAPACITY) - 1).otherwise(F.lit(0)).cast("long")
        left = F.when(big, h % CAPACITY).otherwise(F.when(brk, F.lit(0).cast("long")).otherwise(acc["used"]) + h)
        full = big & (h % CAPACITY == 0)
        placed = F.struct(x["pos"].alias("pos"), h.alias("height"), first.alias("start_slot"), last.alias("end_slot"), brk.alias("break_before"))
        return F.struct((last + full.cast("long")).alias("slot"), left.cast("long").alias("used"), F.concat(acc["out"], F.array(placed)).alias("out"))

    rows = items.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("height").cast("long").alias("height")))).alias("s"))
    plan = rows.select(by, F.explode(F.aggregate("s", start, step)["out"]).alias("p")).select(by, "p.*")
    risk = F.when(F.col("height") > CAPACITY, "split").when(F.col("height") >= 82, "tight").otherwise("none")
    return plan.withColumns({"page": F.floor(F.col("start_slot") / columns).cast("long") + 1, "column": F.col("start_slot") % columns + 1, "risk": risk})


def basket(log: DataFrame, by: str) -> DataFrame:
    """Ordered baskets after a log (pos, op, id, at): add, remove, move and clear, each a fold over the basket's own log."""
    start = F.array().cast("array<bigint>")

    def step(acc: Column, x: Column) -> Column:
        rest = F.filter(acc, lambda i: i != x["id"])
        at = F.least(F.greatest(F.coalesce(x["at"], F.size(rest).cast("long")), F.lit(0)), F.size(rest).cast("long")).cast("int")
        put = F.concat(F.slice(rest, F.lit(1), at), F.array(x["id"]), F.slice(rest, at + 1, F.size(rest)))
        there = F.array_contains(acc, x["id"])
        return (
            F.when(x["op"] == "clear", start)
            .when(x["op"] == "remove", rest)
            .when((x["op"] == "add") & there, acc)
            .when((x["op"] == "move") & ~there, acc)
            .otherwise(put)
        )

    rows = log.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("pos", "op", F.col("id").cast("long").alias("id"), F.col("at").cast("long").alias("at")))).alias("s"))
    return rows.select(by, F.aggregate("s", start, step).alias("ids"))


def column_count(values: Column) -> Column:
    """The largest valid column count, 0 if none is."""
    return F.coalesce(F.max(F.when(values.isin(1, 2), values)), F.lit(0))


def breaks_column(page: str, column: str, by: tuple[str, ...] = (), order: str = "pos") -> Column:
    """Whether an item starts a new column: on the page of its predecessor, in a larger column."""
    w = W.partitionBy(*by).orderBy(order)
    return F.coalesce((F.lag(page).over(w) == F.col(page)) & (F.col(column) > F.lag(column).over(w)), F.lit(False))


def unpositioned_images(images: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """Images without a place: first to the items with a cue, then to the others, in order; the rest goes to the last one."""
    order = F.row_number().over(W.partitionBy(by).orderBy(F.col("cue").desc(), "pos"))
    n = F.count(F.lit(1)).over(W.partitionBy(by))
    seats = items.withColumns({"_seat": order, "_n": n})
    first = seats.groupBy(by).agg(F.max("_n").alias("_n"))
    queued = images.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy("image"))).join(first, by)
    return queued.withColumn("_seat", F.least("_k", "_n")).join(seats.select(by, "_seat", F.col("pos").alias("item_pos")), [by, "_seat"]).select(by, "image", "item_pos")


def endnotes_fit(notes: DataFrame, by: str) -> DataFrame:
    """Whether a document's endnotes cut it into items: numbers exactly 1..n, at least two, and at least 80 % with an answer."""
    numbers = F.sort_array(F.collect_list("number"))
    g = notes.groupBy(by).agg(numbers.alias("_n"), F.avg((text("answer") != "").cast("double")).alias("_share"))
    return g.select(by, ((F.size("_n") >= 2) & (F.col("_n") == F.sequence(F.lit(1), F.size("_n"))) & (F.col("_share") >= 0.8)).alias("fits"))
