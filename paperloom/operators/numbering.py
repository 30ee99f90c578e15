"""Automatic paragraph numbers: a counter for each numbering and level, templates over levels, and the formats of numbers.

Counters need no sequence: a level's counter is the running count of its paragraphs less that count at the last paragraph of
a shallower level, so all ten levels come from windows of one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = 10
#: Where a Hangul syllable's first consonants and vowels stand, the letters of a list, and the parts of a Roman number.
CONSONANTS, VOWELS = (0, 2, 3, 5, 6, 7, 9, 11, 12, 14, 15, 16, 17, 18), (0, 4, 8, 13, 18, 20)
JAMO = "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ"
ROMAN = (("", "M", "MM", "MMM"), ("", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"), ("", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"), ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))


def char(code: Column) -> Column:
    """The character of a code point below 65,536."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 4, "0")), "UTF-16BE")


def _at(values: tuple, k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), k.cast("int") + 1)


def _roman(v: Column) -> Column:
    parts = [_at(signs, F.floor(v / unit) % 10) for signs, unit in zip(ROMAN, (1000, 100, 10, 1), strict=True)]
    return F.when(v > 3999, v.cast("string")).otherwise(F.concat(*parts))


def _circled(first: int, count: int):
    return lambda v, plain: F.when(v <= count, char(v + (first - 1))).otherwise(plain)


def _circled_digit(v: Column) -> Column:
    code = F.when(v <= 20, v + 0x245F).when(v <= 35, v - 21 + 0x3251).otherwise(v - 36 + 0x32B1)
    return F.when(v <= 50, char(code)).otherwise(F.concat(F.lit("("), v.cast("string"), F.lit(")")))


def _syllable(v: Column) -> Column:
    vowel = F.least(F.floor((v - 1) / len(CONSONANTS)), F.lit(len(VOWELS) - 1))
    return char(F.lit(0xAC00) + _at(CONSONANTS, (v - 1) % len(CONSONANTS)) * 588 + _at(VOWELS, vowel) * 28)


def _letter(first: int):
    return lambda v: char((v - 1) % 26 + first)


#: How a counter of 1 or more is written, by the format's name; other names, and counters beyond a circled alphabet, are digits.
FORMATS = {
    "CIRCLED_DIGIT": _circled_digit,
    "HANGUL_SYLLABLE": _syllable,
    "CIRCLED_HANGUL_SYLLABLE": lambda v: _circled(0x326E, 14)(v, _syllable(v)),
    "HANGUL_JAMO": lambda v: _at(tuple(JAMO), (v - 1) % len(JAMO)),
    "CIRCLED_HANGUL_JAMO": lambda v: _circled(0x3260, 14)(v, _at(tuple(JAMO), (v - 1) % len(JAMO))),
    "LATIN_CAPITAL": _letter(0x41),
    "LATIN_SMALL": _letter(0x61),
    "CIRCLED_LATIN_CAPITAL": lambda v: _circled(0x24B6, 26)(v, v.cast("string")),
    "CIRCLED_LATIN_SMALL": lambda v: _circled(0x24D0, 26)(v, v.cast("string")),
    "ROMAN_CAPITAL": _roman,
    "ROMAN_SMALL": lambda v: F.lower(_roman(v)),
}


def formatted(value: Column, kind: Column) -> Column:
    """A counter in a format; 0 stays 0 in digits, and is 1 elsewhere."""
    v = F.greatest(value, F.lit(1))
    out = F.when((value == 0) & (kind == "DIGIT"), "0").otherwise(v.cast("string"))
    for name, write in FORMATS.items():
        out = F.when(kind == name, write(v)).otherwise(out)
    return out


def numbered(paragraphs: DataFrame, heads: DataFrame, by: list[str]) -> DataFrame:
    """The paragraphs (by, pos, numbering, level from 1 to 10) with their label, empty for those without a numbering.

    ``heads`` has a row for each numbering and level: kind (the format), template (``^n`` stands for level n's number) and
    start. A level without a head counts in digits from 1 and is written ``^n.``; a numbering without heads gives no label. A
    level that hasn't counted yet, or has begun anew, shows its start.
    """
    one = F.struct(F.coalesce("kind", F.lit("DIGIT")).alias("kind"), "template", F.coalesce("start", F.lit(1)).cast("long").alias("start"))
    known = heads.groupBy("numbering").agg(F.map_from_entries(F.collect_list(F.struct("level", one))).alias("heads"))
    rows = paragraphs.join(known, "numbering", "left")
    level, w = F.col("level"), W.partitionBy(*by, "numbering").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = {f"_n{n}": F.sum((level == n).cast("long")).over(w) for n in range(1, LEVELS + 1)}
    rows = rows.withColumns(counts)
    rows = rows.withColumns({f"_b{n}": F.coalesce(F.max(F.when(level < n, F.col(f"_n{n}"))).over(w), F.lit(0)) for n in range(1, LEVELS + 1)})
    head = lambda n: F.get(F.array(F.element_at("heads", n)), F.lit(0))
    template = F.coalesce(F.trim(F.element_at("heads", level)["template"]), F.concat(F.lit("^"), level.cast("string"), F.lit(".")))
    counters = []
    for n in range(1, LEVELS + 1):
        start = F.coalesce(head(F.lit(n))["start"], F.lit(1).cast("long"))
        count = F.col(f"_n{n}") - F.col(f"_b{n}")
        counters.append(F.struct(F.when(count > 0, start + count - 1).otherwise(start).alias("value"), F.coalesce(head(F.lit(n))["kind"], F.lit("DIGIT")).alias("kind")))
    rows = rows.withColumn("_said", F.transform(F.array(*counters), lambda c: formatted(c["value"], c["kind"])))
    out = template
    for n in range(LEVELS, 0, -1):
        out = F.replace(out, F.lit(f"^{n}"), F.get("_said", F.lit(n - 1)))
    label = F.trim(F.regexp_replace(out, r"\^(?![\p{L}\p{N}])", ""))
    extra = [f"_{c}{n}" for c in "nb" for n in range(1, LEVELS + 1)]
    return rows.withColumn("label", F.when(F.col("heads").isNotNull() & level.isNotNull(), label).otherwise("")).drop("heads", "_said", *extra)
