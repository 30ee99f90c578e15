"""Automatic numbers against a list of counters, and every format by hand."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from paperloom.operators import numbering


def test_every_format(spark):
    want = {
        "DIGIT": {0: "0", 1: "1", 12: "12"}, "CIRCLED_DIGIT": {0: "①", 1: "①", 20: "⑳", 21: "㉑", 35: "㉟", 36: "㊱", 50: "㊿", 51: "(51)"},
        "HANGUL_SYLLABLE": {1: "가", 2: "나", 14: "하", 15: "거", 29: "고", 84: "히", 85: "기"}, "CIRCLED_HANGUL_SYLLABLE": {1: "㉮", 14: "㉻", 15: "거"},
        "HANGUL_JAMO": {1: "ㄱ", 14: "ㅎ", 15: "ㄱ"}, "CIRCLED_HANGUL_JAMO": {1: "㉠", 14: "㉭", 15: "ㄱ"}, "LATIN_CAPITAL": {1: "A", 27: "A"}, "LATIN_SMALL": {2: "b", 26: "z"},
        "CIRCLED_LATIN_CAPITAL": {1: "Ⓐ", 26: "Ⓩ", 27: "27"}, "CIRCLED_LATIN_SMALL": {1: "ⓐ", 27: "27"}, "ROMAN_CAPITAL": {4: "IV", 1994: "MCMXCIV", 3999: "MMMCMXCIX", 4000: "4000"}, "ROMAN_SMALL": {9: "ix"}, "OTHER": {7: "7"},
    }
    rows = [(k, v, t) for k, of in want.items() for v, t in of.items()]
    df = spark.createDataFrame(rows, "kind string, v long, want string")
    assert [(r.kind, r.v, r.got) for r in df.select("kind", "v", "want", numbering.formatted(F.col("v"), F.col("kind")).alias("got")).collect() if r.got != r.want] == []


HEADS = [("a", 1, "DIGIT", "^1.", 1), ("a", 2, "LATIN_SMALL", " (^2) ", 2), ("a", 3, "DIGIT", "^1-^2-^3 ^", 1), ("a", 10, "DIGIT", "^10/^1", 5), ("b", 2, "HANGUL_SYLLABLE", "^2", 1), ("b", 1, "DIGIT", "", 0)]


def counted(rows):
    heads = {}
    for n, level, kind, template, start in HEADS:
        heads.setdefault(n, {})[level] = (kind, template, start)
    counters, out = {}, []
    for n, level in rows:
        if n not in heads:
            out.append("")
            continue
        c = counters.setdefault(n, {})
        c[level] = c[level] + 1 if level in c else heads[n].get(level, (0, 0, 1))[2]
        for deeper in range(level + 1, 11):
            c.pop(deeper, None)

        def said(m, c=c, of=heads[n]):
            k = int(m[1])
            kind, _, start = of.get(k, ("DIGIT", "", 1))
            v = c.get(k, start)
            return {"LATIN_SMALL": lambda: chr(96 + max(1, v)), "HANGUL_SYLLABLE": lambda: "가나다라마바사아자차카타파하"[max(1, v) - 1]}.get(kind, lambda: str(v))()

        text = re.sub(r"\^(10|[1-9])", said, heads[n][level][1].strip() if level in heads[n] else f"^{level}.")
        out.append(re.sub(r"\^(?![^\W_])", "", text).strip())
    return out


def test_labels_are_those_of_counters(spark):
    rng = random.Random(7)
    docs = [[(rng.choice(["a", "a", "b", "c", None]), rng.choice([1, 2, 2, 3, 4, 10])) for _ in range(rng.randrange(1, 25))] for _ in range(40)]
    rows = [(d, k, n, level) for d, of in enumerate(docs) for k, (n, level) in enumerate(of)]
    df = spark.createDataFrame(rows, "doc int, pos int, numbering string, level int")
    got = numbering.numbered(df, spark.createDataFrame(HEADS, "numbering string, level int, kind string, template string, start int"), ["doc"])
    labels = {(r.doc, r.pos): r.label for r in got.collect()}
    assert [[labels[d, k] for k in range(len(of))] for d, of in enumerate(docs)] == [counted(of) for of in docs]
