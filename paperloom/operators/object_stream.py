"""Questions from the object stream of an edited document: texts, pictures and tables in order (by, pos, kind, value, cells).

Documents come in three forms, and facts of the whole document tell which: a source that stands behind each question, no
score marker at all, or score markers before the choices. Each form has a plan of windows of its own over all documents that
have it; one aggregate and a join send the documents to theirs. Whatever follows the first answer section is cut off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.choices import split_choices
from ..functions.exam_text import MARKS, RANGE_HEAD
from ..functions.text import DASHES, WS, stripped, text
from ..session import staged
from .sections import answer_sections, question_number

#: Score markers, sources behind questions and what shows that they are some, intents, scores, answer sections, passages.
MARKER = rf"^\[([0-9]{{1,2}}){WS}*점\]{WS}*\[([^\]]*?)([0-9]{{1,3}}){WS}*(?:번)?\]$"
SOURCE = rf"^\[(.*?)([0-9]{{1,3}}){WS}*번\]$"
SOURCE_HINT = r"[0-9]{2,4}|[년월]|고[123]|중[123]|전국|모의|수능|평가|교육청|평가원"
INTENT, SCORE = r"(?s)^\[출제의도\]\s*(.*)$", rf"\[{WS}*([0-9]{{1,2}}){WS}*점{WS}*\]"
ANSWERS = rf"^(?:\[정답\]|빠른{WS}*정답|정답{WS}*(?:및|과){WS}*해설|정답{WS}*표)"
EXAMS, AREAS = ("학년도", "모의고사", "모의평가", "수능"), ("수학영역", "수학 영역", "국어영역", "영어영역")
PASSAGE = rf"^{WS}*\[{WS}*([0-9]{{1,2}}){WS}*[{DASHES}]{WS}*([0-9]{{1,2}}){WS}*\]"
MOST_CHOICES = 5
COLUMNS = ("mode", "place", "number", "unit", "score", "intent", "stem", "choices", "images", "tables", "is_passage")


def _answers(c: Column) -> Column:
    """Whether a text begins an answer section."""
    t = stripped(c)
    bare = F.regexp_replace(t, WS + "+", "")
    return F.coalesce(t.rlike(ANSWERS) | (F.regexp_count(t, F.lit(r"\[정답\]")) >= 3) | F.contains(bare, F.lit("빠른정답")) | bare.endswith("(해설)") | bare.isin("해설", "풀이"), F.lit(False))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return F.array_max(F.array(*[F.contains(c, F.lit(w)) for w in words]))


def prepared(stream: DataFrame, by: list[str]) -> DataFrame:
    """The stream with said (a text, or a table's cells in a row) and mode (trailing, paragraphs or markers) of each document."""
    cells = F.array_join(F.flatten("cells"), " ", "")
    rows = stream.withColumn("said", F.when(F.col("kind") == "text", stripped(text("value"))).when(F.col("kind") == "table", cells).otherwise(""))
    is_text = F.col("kind") == "text"
    rows = rows.withColumns({
        "source": is_text & F.col("said").rlike(SOURCE) & F.regexp_extract("said", SOURCE, 1).rlike(SOURCE_HINT), "marker": is_text & F.col("said").rlike(MARKER),
        "answers": (F.col("kind") != "image") & _answers(F.col("said")), "masthead": (F.col("kind") == "table") & ((F.col("said") == "") | (_any(F.col("said"), EXAMS) & _any(F.col("said"), AREAS))),
    })
    every = W.partitionBy(*by)
    mode = F.when(F.max("source").over(every), "trailing").when(F.max("marker").over(every), "markers").otherwise("paragraphs")
    return rows.withColumn("mode", mode)


def _questions(rows: DataFrame, by: list[str], group: str) -> DataFrame:
    """Pictures and tables of each group, and its texts (of rows with part stem or choices) in order."""
    listed = lambda part: F.transform(F.sort_array(F.collect_list(F.when(part, F.struct("pos", "said")))), lambda x: x["said"])
    images = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "image", F.struct("pos", "value")))), lambda x: x["value"])
    is_text = (F.col("kind") == "text") & (F.col("said") != "")
    return rows.groupBy(*by, group).agg(
        F.array_join(listed(is_text & (F.col("part") == "stem")), "\n").alias("stem_text"), F.array_join(listed(is_text & (F.col("part") == "choices")), "\n").alias("choice_text"),
        images.alias("images"), F.count_if((F.col("kind") == "table") & ~F.col("skip")).alias("tables"), F.first(F.when(F.col("part") == "mark", F.col("said")), ignorenulls=True).alias("mark"),
    )


def _before_answers(rows: DataFrame, by: list[str]) -> DataFrame:
    ended = F.max(F.col("answers").cast("int")).over(W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_ended", ended).where("_ended = 0").drop("_ended")


def trailing(rows: DataFrame, by: list[str]) -> DataFrame:
    """Questions that a source closes; an intent right behind it is the closed question's. What no source closes is no question."""
    rows = _before_answers(rows, by)
    w = W.partitionBy(*by).orderBy("pos")
    rows = rows.withColumn("group", F.coalesce(F.sum(F.col("source").cast("long")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    empty = (F.col("kind") == "text") & (F.col("said") == "")
    inner = W.partitionBy(*by, "group").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    first_table = F.col("masthead") & (F.coalesce(F.sum(((F.col("kind") == "image") | ((F.col("kind") == "text") & ~empty)).cast("int")).over(inner), F.lit(0)) == 0)
    intent = (F.col("kind") == "text") & F.col("said").rlike(INTENT)
    rows = rows.withColumns({"skip": first_table, "is_intent": intent}).where(~empty)
    content = F.coalesce(F.sum((~F.col("is_intent") & ~F.col("skip")).cast("int")).over(inner), F.lit(0)) == 0
    rows = rows.withColumn("told", F.col("is_intent") & content & (F.col("group") > 0))
    intents = rows.where("told").groupBy(*by, (F.col("group") - 1).alias("group")).agg(F.max_by(F.regexp_extract("said", INTENT, 1), "pos").alias("intent"))
    rows = rows.where("NOT told").withColumn("part", F.when(F.col("source"), "mark").otherwise("stem"))
    found = _questions(rows, by, "group").where("mark IS NOT NULL").join(intents, [*by, "group"], "left")
    score = F.regexp_extract("stem_text", SCORE, 1)
    at = F.regexp_instr("stem_text", F.lit(SCORE))
    body = F.when(at > 0, F.concat(F.substring("stem_text", F.lit(1), at - 1), F.substring("stem_text", at + F.length(F.regexp_extract("stem_text", SCORE, 0)), F.length("stem_text")))).otherwise(F.col("stem_text"))
    found = found.withColumns({"score": score, "parts": split_choices(stripped(body))})
    inside = F.substring("mark", F.lit(2), F.length("mark") - 2)
    unit = F.when(F.col("score") != "", F.concat(F.lit("["), "score", F.lit("점]["), inside, F.lit("]"))).otherwise(F.col("mark"))
    out = found.withColumns({"number": F.regexp_extract("mark", SOURCE, 2).cast("int").cast("string"), "unit": unit, "stem": F.col("parts.stem"), "choices": F.slice("parts.choices", 1, MOST_CHOICES)})
    return out.where((F.col("stem") != "") | (F.size("choices") > 0) | (F.size("images") > 0) | (F.col("tables") > 0)).withColumnRenamed("group", "place")


def marked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Questions of a stem, a score marker and choices: choices go on while a text has a circled digit, or follows one before the
    fifth; the next text begins a question. What the choices' texts hold besides choices goes to the stem, once."""
    rows = _before_answers(rows, by)
    w = W.partitionBy(*by).orderBy("pos")
    texts = (F.col("kind") == "text") & (F.col("said") != "") & ~F.col("marker")
    rows = rows.withColumns({"segment": F.sum(F.col("marker").cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), "is_text": texts, "labels": F.when(texts, F.regexp_count("said", F.lit(f"[{MARKS}]"))).otherwise(F.lit(0))})
    inner = W.partitionBy(*by, "segment").orderBy("pos")
    so_far = F.coalesce(F.sum("labels").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    stops = F.col("is_text") & ~((F.col("labels") > 0) | ((so_far > 0) & (so_far < MOST_CHOICES)))
    rows = rows.withColumn("stops", (stops & (F.col("segment") > 0)).cast("int"))
    after = F.max("stops").over(inner.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("behind", F.when(F.col("segment") == 0, 1).otherwise(after))
    rows = rows.withColumn("group", F.col("segment") + F.col("behind"))
    own = W.partitionBy(*by, "group").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    first_table = F.col("masthead") & (F.coalesce(F.sum((F.col("is_text") | F.col("marker") | (F.col("kind") == "image")).cast("int")).over(own), F.lit(0)) == 0)
    part = F.when(F.col("marker"), "mark").when(F.col("behind") == 1, "stem").otherwise("choices")
    found = _questions(rows.withColumns({"skip": first_table, "part": part}), by, "group")
    found = found.withColumns({"parts": split_choices(F.col("choice_text")), "number": F.regexp_extract("mark", MARKER, 3), "section": F.trim(F.regexp_extract("mark", MARKER, 2))})
    stem = stripped(F.concat_ws("\n", F.nullif("stem_text", F.lit("")), F.nullif("parts.stem", F.lit(""))))
    plain = F.coalesce(F.nullif(F.regexp_replace("number", "^0+", ""), F.lit("")), F.col("number"), F.lit(""))
    out = found.withColumns({"number": plain, "unit": F.coalesce("mark", F.lit("")), "stem": stem, "choices": F.slice("parts.choices", 1, MOST_CHOICES), "score": F.coalesce(F.regexp_extract("mark", MARKER, 1), F.lit("")), "intent": F.lit(None).cast("string")})
    return out.where((F.col("stem") != "") | (F.size("choices") > 0) | (F.size("images") > 0) | (F.col("tables") > 0)).withColumnRenamed("group", "place")


def paragraphs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Questions by their leading numbers; a passage that leads several on is an item of its own, before the first of them.

    A document without two questions gives nothing: other readers take it.
    """
    lines = rows.where("kind = 'text'").select(*by, "kind", "value", F.posexplode(F.split(text("value"), "\n")).alias("line", "text"), "pos")
    lines = lines.unionByName(rows.where("kind <> 'text'").select(*by, "kind", "value", F.lit(0).alias("line"), F.lit("").alias("text"), "pos"))
    lines = lines.withColumn("row", F.struct("pos", "line")).drop("pos", "line").withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy("row")).cast("long"))
    kept = answer_sections(staged(lines.drop("row"), "lines"), by).where("section IS NULL").withColumn("number", question_number(F.col("text")))
    w = W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    waits = F.coalesce(F.last(F.when(F.col("number").isNotNull(), 0).when(F.ltrim("text").rlike(RANGE_HEAD), 1), ignorenulls=True).over(w), F.lit(1))
    kept = kept.withColumns({"asked": F.count("number").over(w), "waits": waits, "questions": F.count("number").over(W.partitionBy(*by))})
    kept = kept.withColumn("place", F.col("asked") + F.col("waits")).where("place <= questions AND questions > 1")
    line = F.struct("pos", "text", F.col("number").isNotNull().alias("starts"))
    image = F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == "image", F.struct("pos", "value")))), lambda x: x["value"])
    chunks = kept.groupBy(*by, "place").agg(F.sort_array(F.collect_list(F.when(F.col("kind") == "text", line))).alias("lines"), image.alias("images"), F.count_if(F.col("kind") == "table").alias("tables"), F.min("number").alias("number"))
    joined = lambda some: stripped(F.array_join(F.transform(some, lambda x: x["text"]), "\n"))
    start = F.array_position(F.transform("lines", lambda x: x["starts"]), F.lit(True)).cast("int")
    lead = F.filter(F.slice("lines", F.lit(1), F.greatest(start - 1, F.lit(0))), lambda x: x["text"].isNotNull())
    head = F.get(F.filter(lead, lambda x: stripped(x["text"]) != ""), F.lit(0))["text"]
    passage = F.coalesce(head.rlike(PASSAGE) | F.contains(head, F.lit("다음 글을 읽")) | F.contains(head, F.lit("다음을 읽")), F.lit(False))
    label = F.when(head.rlike(PASSAGE), F.concat(F.lit("["), F.regexp_extract(head, PASSAGE, 1), F.lit("~"), F.regexp_extract(head, PASSAGE, 2), F.lit("]"))).otherwise("")
    chunks = chunks.withColumns({"passage": passage, "label": label, "lead": joined(lead), "whole": joined(F.col("lines")), "rest": joined(F.slice("lines", F.greatest(start, F.lit(1)), F.greatest(F.size("lines"), F.lit(1))))})
    none = F.array().cast("array<string>")
    asked = F.struct(F.lit(1).alias("second"), F.col("number").cast("string").alias("number"), split_choices(F.when(F.col("passage"), F.col("rest")).otherwise(F.col("whole"))).alias("parts"), F.col("images").alias("images"), F.col("tables").alias("tables"), F.lit(False).alias("is_passage"))
    told = F.struct(F.lit(0).alias("second"), F.col("label").alias("number"), F.struct(F.col("lead").alias("stem"), none.alias("choices")).alias("parts"), none.alias("images"), F.lit(0).cast("long").alias("tables"), F.lit(True).alias("is_passage"))
    both = F.when(F.col("passage"), F.array(told, asked)).otherwise(F.array(asked))
    out = chunks.select(*by, "place", F.explode(both).alias("x")).select(*by, (F.col("place") * 2 + F.col("x.second")).alias("place"), "x.number", "x.images", "x.tables", "x.is_passage", F.col("x.parts.stem").alias("stem"), F.col("x.parts.choices").alias("choices"))
    return out.withColumns({"unit": F.lit(""), "score": F.lit(""), "intent": F.lit(None).cast("string")})


def questions(stream: DataFrame, by: list[str]) -> DataFrame:
    """by and ``COLUMNS`` of each question of each document, by the plan of the document's form; place is their order."""
    rows = staged(prepared(stream, by), "stream")
    plans = {"trailing": trailing, "markers": marked, "paragraphs": paragraphs}
    out = None
    for mode, plan in plans.items():
        found = plan(rows.where(F.col("mode") == mode).drop("mode"), by).withColumn("mode", F.lit(mode))
        if "is_passage" not in found.columns:
            found = found.withColumn("is_passage", F.lit(False))
        found = found.withColumns({"place": F.row_number().over(W.partitionBy(*by).orderBy("place")), "intent": F.coalesce("intent", F.lit(""))}).select(*by, *COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out
