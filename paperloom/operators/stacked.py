"""Formulas that a page's text has torn into rows: roots, logarithms, limits, exponents and fractions are put together again.

Rows (by, pos, text) go through seven steps in a fixed order. Each of the row steps classifies every row by windows over its
neighbours and works out what it would become together with the row before, or with the next ones; where such matches
overlap, the first wins. That choice is made within islands: runs of rows that matches connect, which are a few rows
long whatever a document's length is. A row outside islands is one of its own and stays as it is. Each step reads what the
former one gives once, and all of them work on the one exchange by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS, stripped, text

#: Boxes that stand for a bar, what may stand before a fraction, and the patterns of torn rows.
BOX, GREEK, OPERATORS = "□▢", "α-ωΑ-Ω", r"=+\-−*/×÷(<\[{,:"
WORD = rf"[A-Za-z0-9{GREEK}∞+\-.]+"
PART = rf"^[A-Za-z0-9{GREEK}∞+\-*/^_(){{}}\[\].]+$"
ROOT = rf"^([0-9]{{1,2}})[{BOX}]([A-Za-z0-9{GREEK}]+)(.*?)([0-9]{{1,4}})[{BOX}]([0-9]{{1,3}})$"
LIMIT = rf"^[A-Za-z{GREEK}][A-Za-z0-9{GREEK}]*{WS}*(?:→|->|\\to){WS}*[-+∞A-Za-z0-9{GREEK}]+[{BOX}]*$"
UNDER, UNDER_ALONE, OVER = rf"^(.*?)[{BOX}]({WORD})(.*)$", rf"^(.*?)[{BOX}]({WORD})$", rf"^({WORD})(.*)$"
EXPONENT = r"^(?:[+\-]?[0-9]+|[+\-]?\\frac\{[^{}]{1,40}\}\{[^{}]{1,40}\})$"
FACTOR = rf"^({WS}*[×*]{WS}*)([A-Za-z0-9{GREEK}]+)$"
COPRIME, BOTH = "서로소", rf"p{WS}*\+{WS}*q|(?<![A-Za-z0-9_])p{WS}*,{WS}*q(?![A-Za-z0-9_])|p{WS}*와{WS}*q"
HANGUL, CASE = "[가-힣]", rf"[A-Za-z]\(x\){WS}*="
ROWS_OF_A_CASE = 8
_OUT = "struct<pos:bigint,text:string>"


def _rtrim(c: Column) -> Column:
    return F.regexp_replace(c, WS + "+$", "")


def _group(c: Column, pattern: str, k: int) -> Column:
    """A group of a pattern, null where the pattern doesn't match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, k))


def _part(c: Column) -> Column:
    """Whether a row can be a numerator or a denominator."""
    return (F.length(c) <= 80) & c.rlike(PART) & ~c.rlike("^[①-⑤]")


def _open(head: Column) -> Column:
    """Whether a fraction can begin after this: at the row's start or after an operator."""
    return F.coalesce(_rtrim(head).rlike(f"^$|[{OPERATORS}]$"), F.lit(False))


def _base(head: Column) -> Column:
    """Whether an exponent can stand on this."""
    h = _rtrim(head)
    return ~h.rlike(HANGUL) & ~h.rlike("^[①-⑤]") & ~_open(head) & h.rlike(rf"[A-Za-z0-9{GREEK})\]}}]$")


def _frac(top: Column, below: Column) -> Column:
    return F.concat(F.lit("\\frac{"), top, F.lit("}{"), below, F.lit("}"))


def merged(rows: DataFrame, by: list[str], back: Column | None, ahead: Column, width: int, gone: Column | None = None) -> DataFrame:
    """Rows (by, pos, text) after a step: ``back`` is what a row becomes with the row before it, ``ahead`` what it becomes with the
    ``width`` - 1 rows after it (null: nothing); back comes first, and a row that has been merged is no row before any more.
    Rows that are ``gone`` vanish and are no row before either."""
    w = W.partitionBy(*by).orderBy("pos")
    told = rows.withColumns({"_gone": F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))})
    told = told.withColumns({"_back": F.lit(None).cast("string") if back is None else F.when(~F.col("_gone"), back), "_ahead": F.when(~F.col("_gone"), ahead)})
    reached = F.max(F.col("_ahead").isNotNull().cast("int")).over(w.rowsBetween(1 - width, -1)) if width > 1 else F.lit(0)
    tied = F.col("_back").isNotNull() | F.col("_gone") | F.coalesce(F.lag("_gone").over(w), F.lit(False)) | (F.coalesce(reached, F.lit(0)) > 0)
    told = told.withColumn("_tied", F.coalesce(tied, F.lit(False)))
    told = told.withColumn("_island", F.sum((~F.col("_tied")).cast("long")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    item = F.struct("pos", "text", "_back", "_ahead", "_gone", "_tied")
    islands = told.groupBy(*by, "_island").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.array().cast(f"array<{_OUT}>").alias("out"), F.lit(0).alias("skip"), F.lit(False).alias("free"))
    as_row = lambda pos, said: F.struct(pos.alias("pos"), said.alias("text")).cast(_OUT)

    def step(state: Column, x: Column) -> Column:
        keep, back_now = state["out"], state["free"] & x["_back"].isNotNull()
        last = F.element_at(keep, -1)
        out = (
            F.when((state["skip"] > 0) | x["_gone"], keep)
            .when(back_now, F.concat(F.slice(keep, F.lit(1), F.greatest(F.size(keep) - 1, F.lit(0))), F.array(as_row(last["pos"], x["_back"]))))
            .otherwise(F.concat(keep, F.array(as_row(x["pos"], F.coalesce(x["_ahead"], x["text"])))))
        )
        skip = F.when(state["skip"] > 0, state["skip"] - 1).when(x["_gone"] | back_now | x["_ahead"].isNull(), F.lit(0)).otherwise(F.lit(width - 1))
        free = F.when(state["skip"] > 0, F.lit(False)).when(x["_gone"], state["free"]).otherwise(~back_now & x["_ahead"].isNull())
        return F.struct(out.alias("out"), skip.alias("skip"), free.alias("free"))

    first = F.col("items")[0]
    alone = (F.size("items") == 1) & ~first["_tied"]
    rows = F.when(alone, F.array(as_row(first["pos"], first["text"]))).otherwise(F.aggregate("items", start, step)["out"])
    return islands.select(*by, F.explode(rows).alias("row")).select(*by, "row.pos", "row.text")


def _neighbours(rows: DataFrame, by: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    w = W.partitionBy(*by).orderBy("pos")
    near = rows.withColumns({"n1": stripped(F.lead("text").over(w)), "n2": stripped(F.lead("text", 2).over(w)), "n3": stripped(F.lead("text", 3).over(w)), "p1": stripped(F.lag("text").over(w))})
    return near, {c: F.col(c) for c in ("n1", "n2", "n3", "p1")}


def roots(rows: DataFrame, by: list[str]) -> DataFrame:
    """``…√``, a number, ``3□2…2□3``: a root of an index, whose last factor has a fraction as its exponent."""
    near, n = _neighbours(rows, by)
    now = _rtrim(F.col("text"))
    part = [_group(n["n2"], ROOT, k) for k in range(6)]
    head = _rtrim(F.regexp_replace(now, "√$", ""))
    formula = F.concat(F.lit("\\sqrt["), part[1], F.lit("]{"), part[2], F.lit("}"), part[3], part[4], F.lit("^{"), _frac(n["n1"], part[5]), F.lit("}"))
    match = now.endswith("√") & n["n1"].rlike("^[0-9]+$") & ~part[3].rlike(HANGUL)
    return merged(near, by, None, F.when(match, _rtrim(F.concat(head, F.when(head != "", " ").otherwise(""), formula))), 3)


def limits(rows: DataFrame, by: list[str]) -> DataFrame:
    """``…lim``, what the variable goes to, a numerator and a denominator in rows of their own."""
    near, n = _neighbours(rows, by)
    now = _rtrim(F.col("text"))
    at = lambda mark: F.instr(n["n2"], mark)
    cut = F.when(at("의 값은?") > 1, at("의 값은?")).when(at("의 값을") > 1, at("의 값을")).when(at("의") > 1, at("의"))
    top = F.when(cut.isNull(), n["n2"]).otherwise(stripped(F.substring(n["n2"], F.lit(1), cut - 1)))
    rest = F.when(cut.isNull(), F.lit("")).otherwise(stripped(F.substring(n["n2"], cut, F.length(n["n2"]))))
    script = F.regexp_replace(F.replace(F.regexp_replace(n["n1"], f"^[{BOX}]+|[{BOX}]+$", ""), F.lit("→"), F.lit("\\to")), WS + "+", "")
    match = now.endswith("lim") & n["n1"].rlike(LIMIT) & (F.length(n["n3"]) <= 80) & n["n3"].rlike(PART) & (top != "") & ~top.rlike(HANGUL)
    head = _rtrim(F.regexp_replace(now, "lim$", ""))
    return merged(near, by, None, F.when(match, stripped(F.concat(head, F.lit(" \\lim_{"), script, F.lit("}"), _frac(top, n["n3"]), rest))), 4)


def exponents(rows: DataFrame, by: list[str]) -> DataFrame:
    """``x□2`` below or above its numerator: a fraction as exponent; a number above ``× a``: its exponent."""
    near, n = _neighbours(rows, by)
    now = _rtrim(F.col("text"))
    digits = lambda c: c.rlike("^[0-9]{1,3}$")
    raised = lambda head, top, below: _rtrim(F.concat(head, F.lit("^{"), _frac(top, below), F.lit("}")))
    head, below, rest = (_group(now, UNDER, k) for k in (1, 2, 3))
    back = F.when((stripped(rest) == "") & _base(head) & digits(below) & _part(n["p1"]), raised(head, n["p1"], below))
    head, below, top = _group(now, UNDER_ALONE, 1), _group(now, UNDER_ALONE, 2), _group(n["n1"], OVER, 1)
    over = F.when((stripped(_group(n["n1"], OVER, 2)) == "") & _base(head) & digits(below) & _part(top), raised(head, top, below))
    after = _rtrim(F.lead("text").over(W.partitionBy(*by).orderBy("pos")))
    near = near.withColumn("after", after)
    power = F.when(stripped(F.col("text")).rlike(EXPONENT) & F.col("after").rlike(FACTOR), F.concat(_group(F.col("after"), FACTOR, 1), _group(F.col("after"), FACTOR, 2), F.lit("^{"), stripped(F.col("text")), F.lit("}")))
    return merged(near, by, back, F.coalesce(over, power), 2)


def fractions(rows: DataFrame, by: list[str]) -> DataFrame:
    """``y=□2`` below or above its numerator; rows of boxes alone below a definition by cases vanish."""
    w = W.partitionBy(*by).orderBy("pos")
    rows = rows.withColumns({"both": F.max(F.col("text").rlike(BOTH)).over(W.partitionBy(*by)), "near": F.array_join(F.collect_list("text").over(w.rowsBetween(-ROWS_OF_A_CASE, 0)), "\n")})
    gone = stripped(F.col("text")).rlike(f"^[{BOX}]+$") & F.contains("near", F.lit("{")) & F.col("near").rlike(CASE)
    rows = rows.withColumn("gone", F.coalesce(gone, F.lit(False)))
    last = F.last(F.when(~F.col("gone"), F.col("text")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    near, n = _neighbours(rows, by)
    near = near.withColumn("p1", stripped(last))
    now = _rtrim(F.col("text"))
    fine = lambda rest: (stripped(rest) == "") | (~stripped(rest).rlike(r"^[(\[{]") & ~rest.rlike(f"[{BOX}]"))
    odd = lambda below: F.col("both") & (below == "p")
    joined = lambda head, top, below, rest: _rtrim(F.concat(head, _frac(top, below), rest))
    head, below, rest = (_group(now, UNDER, k) for k in (1, 2, 3))
    back = F.when(_open(head) & ~head.rlike(HANGUL) & _part(n["p1"]) & fine(rest) & ~odd(below), joined(head, n["p1"], below, rest))
    head, below, top, rest = _group(now, UNDER_ALONE, 1), _group(now, UNDER_ALONE, 2), _group(n["n1"], OVER, 1), _group(n["n1"], OVER, 2)
    ahead = F.when(_open(head) & fine(rest) & ~odd(below), joined(head, top, below, rest))
    return merged(near, by, back, ahead, 2, F.col("gone"))


def logarithms(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?<![A-Za-z\\])log([0-9A-Za-z{GREEK}]{{1,4}})[{BOX}]([A-Za-z{GREEK}][A-Za-z0-9{GREEK}]*)", r"\\log_{$1}$2")


def cleared(c: Column) -> Column:
    """Without boxes behind limits; a box before a number alone is one over it."""
    out = F.regexp_replace(c, rf"([A-Za-z0-9{GREEK}]+{WS}*(?:→|->|\\to){WS}*[-+∞A-Za-z0-9{GREEK}]+)[{BOX}]+", "$1")
    return F.regexp_replace(out, rf"(^|[=(:,+\-*/<>≤≥]{WS}*)[{BOX}]([0-9]{{1,3}})(?![0-9])", r"$1\\frac{1}{$2}")


def ratios(rows: DataFrame, by: list[str]) -> DataFrame:
    """``□p`` is p over q where a document asks for coprime p and q, unless q has a root or π shortly before."""
    every = W.partitionBy(*by)
    asked = F.max(F.contains("text", F.lit(COPRIME))).over(every) & F.max(F.col("text").rlike(BOTH)).over(every)
    ratio = F.regexp_replace("text", rf"(?<!(?:q√|q\\sqrt|qπ|q\\pi).{{0,78}})[{BOX}]p(?![A-Za-z0-9{GREEK}])", r"\\frac{p}{q}")
    return rows.withColumn("_asked", asked).withColumn("text", F.when(F.col("_asked"), ratio).otherwise(F.col("text"))).drop("_asked")


def repaired(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, pos (of the first of merged rows) and text of the rows of each document, after all steps in their order."""
    out = rows.select(*by, F.col("pos").cast("long").alias("pos"), text("text").alias("text"))
    out = roots(out, by).withColumn("text", logarithms(F.col("text")))
    out = ratios(fractions(exponents(limits(out, by), by), by), by)
    return out.select(*by, "pos", cleared(F.col("text")).alias("text"))
