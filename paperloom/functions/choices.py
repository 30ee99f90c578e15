"""Choices of a question as columns: labels of lines, several choices in a line, and the fold that tells stem from choices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exam_text import MARKS, NUMBER_HEAD
from .text import cleaned, stripped, text

_LABEL = rf"^(?:([{MARKS}])|\(?([1-9])[.)]|([a-eA-E])[.)]|([1-5])[ \t])\s*(\S.*)$"
_LINE = "struct<raw:string,line:string,kind:string,number:int,rest:string,inline:array<string>,before:string>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def _label(line: Column) -> Column:
    """kind (circled, dotted, letter, bare or null), number and rest of the label that a line begins with."""
    part = lambda k: F.regexp_extract(line, _LABEL, k)
    kind = F.when(part(1) != "", "circled").when(part(2) != "", "dotted").when(part(3) != "", "letter").when(part(4) != "", "bare")
    number = F.nullif(F.concat(part(2), part(4)), F.lit("")).cast("int")
    return F.struct(kind.alias("kind"), F.coalesce(number, F.lit(0)).alias("number"), F.rtrim(part(5)).alias("rest"))


def _inline(line: Column) -> Column:
    """Choices within a line, and what stands before them: two circled digits or more, or words 1, 2, 3 and on that rise."""
    circled = F.regexp_count(line, F.lit(f"[{MARKS}]")) > 1
    marked = F.transform(F.regexp_extract_all(line, F.lit(f"[{MARKS}][^{MARKS}]*"), F.lit(0)), lambda c: F.coalesce(F.nullif(stripped(F.substring(c, 2, 1 << 20)), F.lit("")), F.substring(c, 1, 1)))
    word = r"(?<!\S)(?:\([1-5]\)|\([1-5]|[1-5][.)]|[1-5]\.\)|[1-5])(?!\S)"
    numbers = F.transform(F.regexp_extract_all(line, F.lit(word), F.lit(0)), lambda w: F.regexp_extract(w, "[1-5]", 0).cast("int"))
    rise = (F.slice(numbers, 1, 3) == F.array(F.lit(1), F.lit(2), F.lit(3))) & (F.array_distinct(F.array_sort(numbers)) == numbers)
    numbered = F.transform(F.regexp_extract_all(line, F.lit(rf"(?s){word}(?:(?!{word}).)*"), F.lit(0)), lambda c: let(stripped(F.regexp_replace(c, "^" + word, "")), lambda body: F.when(body != "", body).otherwise(F.regexp_extract(c, "[1-5]", 0))))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(circled, marked).when(F.coalesce(rise, F.lit(False)), numbered).otherwise(none).alias("inline"),
        F.when(circled, stripped(F.regexp_extract(line, f"^[^{MARKS}]*", 0))).when(F.coalesce(rise, F.lit(False)), stripped(F.regexp_extract(line, rf"(?s)^(?:(?!{word}).)*", 0))).otherwise("").alias("before"),
    )


def _read(raw: Column, first: Column) -> Column:
    line = stripped(raw)
    own = first & raw.rlike(NUMBER_HEAD)  # the question's own number is no label
    return let(F.struct(_label(line).alias("label"), _inline(line).alias("cuts")), lambda x: F.struct(
        F.regexp_replace(raw, r"[ \t]+$", "").alias("raw"), line.alias("line"), F.when(~own, x["label"]["kind"]).alias("kind"), x["label"]["number"].alias("number"),
        x["label"]["rest"].alias("rest"), x["cuts"]["inline"].alias("inline"), x["cuts"]["before"].alias("before"),
    ).cast(_LINE))


def _added(state: Column, item: Column) -> Column:
    """One line more: to the choices, if its label is due or begins a run of 1, 2, 3, or else to the stem."""
    x = item["e0"]
    counts = lambda k, n: F.coalesce((item[f"e{k}"]["kind"] == x["kind"]) & (item[f"e{k}"]["number"] == n), F.lit(False))
    begins = counts(0, 1) & counts(1, 2) & counts(2, 3)
    some = F.size(state["choices"]) > 0
    due = x["kind"].isin("circled", "letter") | ((x["kind"] == "dotted") & some & (x["number"] == F.size(state["choices"]) + 1)) | ((x["kind"] == "bare") & some)
    taken = F.coalesce(x["kind"].isNotNull() & (due | (begins & ~some)), F.lit(False))
    within = F.size(x["inline"]) > 0
    stem = F.when(within, F.when(x["before"] != "", F.concat(state["stem"], F.array(x["before"]))).otherwise(state["stem"])).when(taken, state["stem"]).otherwise(F.concat(state["stem"], F.array(x["raw"])))
    choices = F.when(within, F.concat(state["choices"], x["inline"])).when(taken, F.concat(state["choices"], F.array(x["rest"]))).otherwise(state["choices"])
    return F.struct(stem.alias("stem"), choices.alias("choices"))


def split_lines(lines: Column) -> Column:
    """Stem and choices of a question's lines.

    Circled and lettered lines are choices wherever they stand; numbered ones begin where three lines in a row count 1, 2,
    3, and dotted ones go on with the number that is due. A fold over one question's lines.
    """
    none = F.array().cast("array<string>")
    read = F.transform(lines, lambda raw, i: _read(raw, i == 0))
    three = let(read, lambda r: F.arrays_zip(r.alias("e0"), F.slice(r, F.lit(2), F.greatest(F.size(r), F.lit(1))).alias("e1"), F.slice(r, F.lit(3), F.greatest(F.size(r), F.lit(1))).alias("e2")))
    out = F.aggregate(three, F.struct(none.alias("stem"), none.alias("choices")), _added)
    return let(out, lambda o: F.struct(cleaned(F.array_join(o["stem"], "\n")).alias("stem"), o["choices"].alias("choices")))


def split_choices(c: Column) -> Column:
    """Stem and choices of a text."""
    return split_lines(F.split(F.regexp_replace(text(c), "\r\n?", "\n"), "\n"))
