"""Text functions as columns, with the white space, case and width rules that items follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's regular expressions know it, in a form that Java and RE2 read alike.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ODD = WS.replace(r"\x{1C}-\x{20}", r"\x{1C}-\x{1F}")  # but for the blank
#: The signs between the numbers of a range of questions.
DASHES = r"~∼～\-–"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CIRCLED = "①②③④⑤⑥⑦⑧⑨"


def text(c: str | Column) -> Column:
    """The empty string stands for a missing text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_fold(c: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(c, UPPER, LOWER)


def casefolded(c: Column) -> Column:
    """Without case, as comparisons want it: sharp s is ss, ligatures are their letters, every sigma is one."""
    sigma = lambda x: F.translate(x, "ς", "σ")  # noqa: E731  between the two, or Spark would take lower alone
    return sigma(F.lower(sigma(F.upper(c))))


def like(c: Column, needle: str) -> Column:
    """Contains, with the needle's % and _ as wildcards, ASCII case folded, and no escape character."""
    return ascii_fold(c).like("%" + needle.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%")


def collapsed(c: Column) -> Column:
    """White-space runs as one blank, none at the ends; single blanks, which are most runs, are left alone."""
    return F.trim(F.regexp_replace(c, f" {WS}+|{_ODD}{WS}*", " "))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def cleaned(c: Column) -> Column:
    """Line ends as LF, no blanks at line ends, at most one empty line in a row, stripped."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "[ \t]+\n", "\n")
    return stripped(F.regexp_replace(c, "\n{3,}", "\n\n"))


#: Characters that are shown twice as wide as a letter, beyond U+00FF and no white space.
#: The range comes first: most characters are outside it, and no other is looked up.
WIDE = r"[\x{100}-\x{10FFFF}&&[^\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"


def with_line_feeds(c: Column) -> Column:
    """Line ends as LF; texts that have no others are only searched for bytes."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _doubled(c: Column) -> Column:
    """A text in which each wide character is followed by one more, so that lengths are widths."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(c, WIDE, "$0\x01"))


def visual_units(c: Column) -> Column:
    """Width: white space and characters up to U+00FF count 1, wider ones 2."""
    return F.length(_doubled(c))


def wrapped_lines(c: Column, limit: int | Column) -> Column:
    """Lines that a text takes at a width: each of its lines takes at least one."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    lines = F.split(_doubled(with_line_feeds(c)), "\n")
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(1), F.ceil(F.length(x) / limit)).cast("long"))


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def shifted(items: Column, k: int) -> Column:
    """For each place of an array a struct of the k elements from it on (null beyond the end); no lambda looks back at the array."""
    return F.arrays_zip(*[F.slice(items, i + 1, F.greatest(F.size(items), F.lit(1))).alias(f"e{i}") for i in range(k)])


def grams(c: Column, n: int = 3) -> Column:
    """All substrings of n characters; of a shorter text the text itself, of an empty one none."""
    whole = F.filter(shifted(characters(c), n), lambda x: x[f"e{n - 1}"].isNotNull())
    long = F.transform(whole, lambda x: F.concat(*[x[f"e{i}"] for i in range(n)]))
    return F.when(F.length(c) >= n, long).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def json_list(c: Column) -> Column:
    """JSON text as a list of strings: a scalar or unreadable text is its only element, missing text gives none."""
    read = F.from_json(c, "array<string>")
    alone = F.when(F.length(text(c)) == 0, F.array().cast("array<string>")).otherwise(F.array(c))
    return F.when(F.substring(F.ltrim(text(c)), 1, 1) == "[", F.coalesce(read, alone)).otherwise(alone)


def circled_answer(answer: Column, circled: Column, has_choices: Column) -> Column:
    """1 to 9 as ① to ⑨ where the template circles choices and the item has some."""
    a = stripped(text(answer))
    digit = F.when(a.rlike("^[1-9]$"), F.substring(F.lit(CIRCLED), F.try_to_number(a, F.lit("9")).cast("int"), F.lit(1)))
    return F.when(circled & has_choices & digit.isNotNull(), digit).otherwise(a)


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)
