"""Rules of exam headers, ranges, answers and choices as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import exam_text as T
from .choices import let
from .text import CIRCLED, DASHES, cleaned, stripped, text


def first_keyword(name: Column, rules: list[tuple[str, list[str]]], default: str = "") -> Column:
    """The label of the first rule one of whose keywords a name holds."""
    low = F.lower(text(name))
    out = F.lit(default)
    for label, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w.lower()))
        out = F.when(hit, label).otherwise(out)
    return out


def exam_header(raw: Column) -> Column:
    """year, month, organizer, exam_type and grade of a header line or file name; what isn't there is empty."""
    v = F.trim(F.regexp_replace(text(raw), r"[\s_]+", " "))
    has = lambda *words: F.lit(False) if not words else _any([F.contains(v, F.lit(w)) for w in words])
    kind = F.when(has("학력평가"), "학력평가").when(has("모의평가"), "모의평가").when(has("대학수학능력시험", "수능"), "수능").when(has("교육청", "모의고사"), "모의고사").otherwise("")
    organizer = F.when(kind.isin("모의평가", "수능"), "평가원").when(kind != "", "교육청").otherwise("")
    return F.struct(
        F.regexp_extract(v, r"(20\d{2})\s*(?:학년도|년)", 1).alias("year"), F.regexp_extract(v, r"(?<!\d)(\d{1,2})\s*월", 1).alias("month"),
        organizer.alias("organizer"), kind.alias("exam_type"), F.regexp_extract(v, r"고\s*([1-3])", 1).alias("grade"),
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def masthead(h: Column) -> Column:
    """The title line of an exam; empty without a year or a kind."""
    year = F.concat(h["year"], F.lit("학년도 "))
    month = F.when(h["month"] != "", F.concat(h["month"], F.lit("월 "))).otherwise("")
    grade = F.when(h["grade"] != "", F.concat(F.lit("고"), h["grade"], F.lit(" "))).otherwise("")
    kind = F.when(h["exam_type"] == "학력평가", "전국연합학력평가").otherwise(h["exam_type"])
    return (
        F.when((h["year"] == "") | (h["exam_type"] == ""), "")
        .when(h["exam_type"] == "수능", F.concat(year, F.lit("대학수학능력시험 문제지")))
        .when(h["organizer"] == "평가원", F.concat(year, F.lit("대학수학능력시험 "), month, F.lit("모의평가 문제지")))
        .otherwise(F.concat(year, month, grade, kind, F.lit(" 문제지")))
    )


def shared_range(raw: Column) -> Column:
    """First and last number of ``[n~m]`` at a text's start where n is no larger than m, else null."""
    pattern = rf"^\s*\[\s*(\d{{1,3}})\s*[{DASHES}]\s*(\d{{1,3}})\s*\]"
    a, b = (F.try_to_number(F.nullif(F.regexp_extract(text(raw), pattern, i), F.lit("")), F.lit("999")).cast("int") for i in (1, 2))
    return F.when(a <= b, F.array(a, b))


def answer_numbers(answer: Column) -> Column:
    """Distinct choice numbers in an answer, digits that stand alone and circled ones."""
    plain = F.translate(text(answer), CIRCLED, "123456789")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"(?<!\d)([1-9])(?!\d)")), lambda x: x.cast("int")))


def _table(function, kind: str, names: list[str]):
    def column(c: Column) -> Column:
        @F.pandas_udf(kind)
        def batch(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([function(t) for t in texts.fillna("")], columns=names)

        return batch(c)

    return column


stem_and_choices = _table(T.split_choices, "stem string, choices array<string>", ["stem", "choices"])


def answer_and_explanation(c: Column) -> Column:
    """body, answer (of the last answer line) and explanation: explanations reach from their head to the next answer line."""
    t = F.regexp_replace(text(c), "\r\n?", "\n")
    line, head = f"(?dim){T.ANSWER_LINE}", f"(?dim){T.EXPLANATION_HEAD}"
    block = rf"(?dims){T.EXPLANATION_HEAD}.*?(?={T.ANSWER_LINE}|\z)"
    body = F.regexp_replace(F.regexp_replace(t, block, ""), line + "\n?", "")
    answers = F.regexp_extract_all(t, F.lit(line), F.lit(1))
    told = F.regexp_replace(F.array_join(F.regexp_extract_all(t, F.lit(block), F.lit(0)), ""), head + "\n?", "")
    return F.struct(cleaned(body).alias("body"), stripped(F.coalesce(F.get(answers, F.size(answers) - 1), F.lit(""))).alias("answer"), cleaned(told).alias("explanation"))


def opens_key(c: Column) -> Column:
    """Whether a paragraph begins with a heading of the answer section."""
    first = F.regexp_extract(stripped(text(c)), "^[^\n]*", 0)
    return first.rlike(rf"^({T.KEY_HEAD}|\[{T.BLANK}*정답{T.BLANK}*표{T.BLANK}*\])") & ~first.rlike(T.NUMBER_HEAD)


def key_pairs(c: Column) -> Column:
    """number and value of each answer that a text tells, the first for a number; lists of numeric choices tell none."""
    bare = F.regexp_replace(text(c), rf"(?=[{T.MARKS}])(?<![0-9{T.MARKS}]\s{{0,40}}){T.CHOICE_LIST}", "|")  # the look behind is costly: only at marks
    said = F.regexp_extract_all(bare, F.lit(rf"(?=[0-9]){T.PAIR}"), F.lit(0))
    pairs = F.transform(said, lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").cast("string").alias("number"), F.right(x, F.lit(1)).alias("value")))
    return let(pairs, lambda p: F.filter(p, lambda x, i: F.array_position(p["number"], x["number"]) == i + 1))
