"""Answer sections of documents: from a heading after the first question to where the questions go on.

A section ends before the paragraph whose number follows the largest one kept so far, so where it ends depends on what was
kept before it. That is found in rounds over all documents at once: a running maximum from where the last section ended
finds the next heading and what number is due, and the first paragraph with it ends the section. Rounds are as many as a
document has sections.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exam_columns import key_pairs, opens_key
from ..functions.exam_text import BLANK, KEY_HEAD, MARKS, NUMBER_HEAD
from ..functions.text import CIRCLED, stripped, text
from ..session import staged

#: How many paragraphs after a title may hold the answers that make it one, and how many answers they are.
AHEAD, ANSWERS = 5, 2


def question_number(c: Column) -> Column:
    """The number that a paragraph begins with as a question, or null."""
    return F.nullif(F.regexp_extract(F.ltrim(c), NUMBER_HEAD, 1), F.lit("")).cast("int")


def openings(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """Paragraphs (by, pos, text) with number, answer (their number leads to a circled digit) and opens: whether they begin with a
    heading of answers, or are a short title that ends in one and that at least two answers follow."""
    after = W.partitionBy(*by).orderBy("pos").rowsBetween(1, AHEAD)
    t = stripped(text("text"))
    lines = F.filter(F.transform(F.split(F.concat_ws("\n", F.col("_text"), F.array_join("_after", "\n")), "\n"), stripped), lambda x: x != "")
    rows = paragraphs.withColumns({"_text": t, "_after": F.collect_list(text("text")).over(after), "number": question_number(text("text"))}).withColumn("_lines", lines)
    first, rest = F.get("_lines", F.lit(0)), F.slice("_lines", F.lit(2), F.greatest(F.size("_lines"), F.lit(1)))
    title = (F.length(first) <= 60) & ~F.contains(first, F.lit("?")) & first.rlike(f"{KEY_HEAD}$") & ~F.coalesce(F.get(rest, F.lit(0)).rlike(f"^[{MARKS}]"), F.lit(False))
    told = F.size(key_pairs(F.array_join(rest, "\n")))
    opens = (F.col("_text") != "") & (opens_key(F.col("_text")) | (F.col("number").isNull() & title & (told >= ANSWERS)))
    answer = F.ltrim(text("text")).rlike(rf"{NUMBER_HEAD}{BLANK}*(?:정답{BLANK}*[:：]?{BLANK}*)?[{CIRCLED}]")
    return rows.withColumns({"answer": answer, "opens": F.coalesce(opens, F.lit(False))}).drop("_text", "_after", "_lines")


def answer_sections(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """Paragraphs (by, pos, text, and whatever else they have) with section: the position of the heading of the answer section
    that they stand in, null outside."""
    facts = staged(openings(paragraphs.select(*by, "pos", "text"), by).select(*by, "pos", "number", "answer", "opens"), "paragraphs")
    state = staged(facts.where("opens").select(*by).distinct().withColumns({"since": F.lit(None).cast(facts.schema["pos"].dataType), "top": F.lit(0)}), "documents")
    found: list[DataFrame] = []
    before = W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    while not state.isEmpty():
        rows = facts.join(state, by).where("since IS NULL OR pos >= since")
        rows = rows.withColumn("due", F.greatest("top", F.coalesce(F.max("number").over(before), F.lit(0))))
        heads = rows.where("opens AND due > 0").groupBy(*by).agg(F.min(F.struct("pos", "due")).alias("head")).select(*by, F.col("head.pos").alias("section"), F.col("head.due").alias("due"))
        ends = facts.join(heads, by).where((F.col("pos") > F.col("section")) & (F.col("number") == F.col("due") + 1) & ~F.col("answer")).groupBy(*by).agg(F.min("pos").alias("until"))
        cuts = staged(heads.join(ends, by, "left"), "sections")
        found.append(cuts.select(*by, "section", "until"))
        state = staged(cuts.where("until IS NOT NULL").select(*by, F.col("until").alias("since"), F.col("due").alias("top")), "documents")
    if not found:
        return paragraphs.withColumn("section", F.lit(None).cast(facts.schema["pos"].dataType))
    cuts = reduce(DataFrame.unionByName, found).withColumnsRenamed({c: f"_{c}" for c in by})
    inside = [paragraphs[c] == cuts[f"_{c}"] for c in by] + [paragraphs["pos"] >= cuts["section"], F.coalesce(paragraphs["pos"] < cuts["until"], F.lit(True))]
    return paragraphs.join(cuts, inside, "left").drop(*[f"_{c}" for c in by], "until")
