"""The page source and the way from pages to items, on the pages that pin its rules; choices against the plain rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import choices, exam_columns, exam_text
from paperloom.operators import pages
from paperloom.sources.pages import register


def page(doc, lines, drawings=(), number=1):
    """A page of lines (x, y, text, size) in points; a line's width is half its size a character."""
    told = [{"bbox": [x, y - s, x + len(t) * s / 2, y + s * 0.3], "spans": [{"text": t, "font": "F", "size": s, "bbox": [x, y - s, x + 9, y], "chars": [{"c": c, "bbox": [x, y - s, x + 4, y]} for c in t]}]} for x, y, t, s in lines]
    return json.dumps({"doc_id": doc, "page": number, "width": 595, "height": 842, "drawings": drawings, "blocks": [{"lines": told}]}, ensure_ascii=False)


def read(spark, folder, *rows, **options):
    (folder / "p.jsonl").write_text("\n".join(rows) + "\n", encoding="utf-8")
    register(spark)
    return spark.read.format("pages").options(**options).load(str(folder))


def stacked(*texts, x=72, size=11, step=18, top=100):
    return [(x, top + k * step, t, size) for k, t in enumerate(texts)]


def test_questions_and_choices_of_pages(spark, tmp_path):
    rows = [
        page("numbers choices", [(72, 100, "1. First problem statement here.", 11), *stacked("1) alpha", "2) beta", "3) gamma", x=90, top=122), (72, 220, "2. Second problem statement here.", 11), *stacked("1) yes", "2) no", "3) maybe", x=90, top=242)]),
        page("no choices", [(72, 100, "1. Alpha problem body.", 11), (72, 170, "2. Beta problem body.", 11), (72, 240, "3. Gamma problem body.", 11)]),
        page("five choices", [(72, 100, "1. Only one problem.", 11), *stacked("1) a", "2) b", "3) c", "4) d", "5) e", x=90, top=122)]),
        page("boxed numbers", [(72, 100, "1. First real problem statement.", 13), (340, 160, "1. embedded data item", 9), (340, 185, "2. another data item", 9), (72, 320, "2. Second real problem statement.", 13)], [[320, 130, 540, 260]]),
        page("two columns", [(40, 100, "1. left", 11), (40, 130, "① 가 ② 나", 11), (320, 100, "2. right", 11), (320, 130, "more", 11), (40, 300, "3. left again", 11), (300, 800, "7", 9), (40, 780, "저작권 X", 9)]),
        page("nothing", [(72, 100, "no question here", 11)]),
    ]
    got = {}
    for r in pages.recognised(read(spark, tmp_path, *rows)).orderBy("doc_id", "position").collect():
        got.setdefault(r.doc_id, []).append((r.number, r.stem, list(r.choices)))
    assert {d: [n for n, *_ in q] for d, q in got.items()} == {"numbers choices": [1, 2], "no choices": [1, 2, 3], "five choices": [1], "boxed numbers": [1, 2], "two columns": [1, 3, 2]}
    assert [c for *_, c in got["numbers choices"]] == [["alpha", "beta", "gamma"], ["yes", "no", "maybe"]] and got["five choices"][0][2] == list("abcde")
    assert got["two columns"] == [(1, "1. left", ["가", "나"]), (3, "3. left again", []), (2, "2. right\nmore", [])]
    assert got["boxed numbers"][0][1].splitlines()[0] == "1. First real problem statement."


def test_ranges_of_bytes_hold_each_page_once(spark, tmp_path):
    rows = [page(f"d{k % 3}", [(72, 100, f"{k}. 문항 {'x' * (k % 17)}", 11)], number=k) for k in range(1, 60)] + ["broken", "[1]", '{"doc_id": "q"}']
    for split in ("150", "611", "1000000"):
        df = read(spark, tmp_path, *rows, split=split)
        assert sorted(r.page for r in df.where("reason IS NULL").select("page").collect()) == list(range(1, 60))
        assert df.where("reason IS NOT NULL").count() == 3
    assert [r.page for r in df.where("doc_id = 'd1' AND page > 50").orderBy("page").select("page").collect()] == [52, 55, 58]
    narrow = spark.read.format("pages").schema("page int, lines array<struct<text:string>>").load(str(tmp_path)).where("page = 7").collect()
    assert [tuple(r) for r in narrow] == [(7, [(f"7. 문항 {'x' * 7}",)])]


def test_chars_and_spans(spark, tmp_path):
    r = read(spark, tmp_path, page("d", [(72, 100, "ab", 10)]), dpi="72").first()
    assert (r.page_width, r.page_height) == (595, 842) and [c.c for c in r.lines[0].chars] == ["a", "b"]
    assert tuple(r.lines[0].box) == (72, 90, 10, 13) and (r.lines[0].spans[0].font, r.lines[0].spans[0].size) == ("F", 10.0)


PARTS = ["① 가 ② 나 ③ 다", "① a", "② b", "1) x", "2) y", "3) z", "1. x", "2. y", "3. z", "4. w", "(1) q", "(2) r", "(3) s", "a) k", "B. l", "1 one 2 two 3 three", "1 2 3 4 5", "12. stem", "stem text", "  padded  ", "", "③", "❶ ❷", "1 bare", "2 bare", "3 bare", "문제 3. 무엇", "1. 2", "a 1 b 2 c 3 d", "5 x", "(4) t"]


@pytest.mark.parametrize("seed", [1, 2])
def test_choices_as_columns_are_the_plain_rules(spark, seed):
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 9))) for _ in range(300)] + ["", None, "\r\n① a\r\n② b"]
    got = {r.i: (r.c.stem, list(r.c.choices)) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", choices.split_choices(F.col("t")).alias("c")).collect()}
    assert got == {i: exam_text.split_choices(t or "") for i, t in enumerate(texts)}


def test_answer_pairs_as_columns_are_the_plain_rule(spark):
    rng = random.Random(9)
    parts = ["1", "2", "13", "③", "①", "②", ".", ")", " ", "  ", "\n", "번", "정답", ":", "가", "❶", "1234", "3.5"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(2000)] + ["", None, "① 1 ② 2", "9 ① 1 ② 2"]
    got = {r.i: {p.number: p.value for p in r.p} for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", exam_columns.key_pairs(F.col("t")).alias("p")).collect()}
    assert got == {i: exam_text.answer_pairs(t or "") for i, t in enumerate(texts)}
