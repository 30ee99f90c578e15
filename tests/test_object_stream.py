"""Questions from object streams: one document for each form, and what each form's rules decide."""

from __future__ import annotations

from paperloom.operators import object_stream

T = lambda *texts: [("text", t, None) for t in texts]
IMAGE = [("image", "a.png", None)]
TABLE = [("table", None, [["x", "y"], ["1", None]])]
MASTHEAD = [("table", None, [["2025학년도 수능", "수학영역"]])]
DOCS = {
    "trailing": [*MASTHEAD, *T("첫째 값은? [3점]", "① 1 ② 2 ③ 3 ④ 4 ⑤ 5 ⑥ 6"), *IMAGE, *T("[2024년 고3 수능 07번]", "[출제의도] 셈하기", "", "둘째는?"), *TABLE, *T("[전국 8 번]", "닫히지 않음", "빠른 정답", "[2024년 9번]")],
    "markers": [*MASTHEAD, *T("첫 문제", "더"), *IMAGE, *T("[3점][시험 05]", "① 가 ② 나", "이어짐", "③ 다 ④ 라 ⑤ 마", "둘째 문제"), *TABLE, *T("[4점][시험 6번]", "① 하나 ② 둘", "[2점][시험 7]", "끝 문장", "정답 및 해설", "[3점][시험 9]")],
    "paragraphs": [*T("머리말", "1. 첫째\n① 가 ② 나"), *IMAGE, *T("[2~3] 다음 글을 읽고 답하시오.\n글", "2. 둘째", "3. 셋째"), *TABLE, *T("빠른 정답", "1. ① 2. ②")],
    "one": T("1. 하나뿐"),
    "empty": T("", " "),
}


def run(spark, docs):
    rows = [(d, k, *x) for d, of in docs.items() for k, x in enumerate(of)]
    df = spark.createDataFrame(rows, "doc string, pos int, kind string, value string, cells array<array<string>>")
    out = {}
    for r in object_stream.questions(df, ["doc"]).orderBy("doc", "place").collect():
        out.setdefault(r.doc, []).append(r)
    return out


def test_each_form(spark):
    got = run(spark, DOCS)
    assert set(got) == {"trailing", "markers", "paragraphs"} and all(r.mode == d for d, of in got.items() for r in of)
    a, b = got["trailing"]
    assert (a.number, a.unit, a.score, a.intent, a.stem, list(a.choices), list(a.images), a.tables) == ("7", "[3점][2024년 고3 수능 07번]", "3", "셈하기", "첫째 값은?", list("12345"), ["a.png"], 0)
    assert (b.number, b.unit, b.stem, b.tables, list(b.images)) == ("8", "[전국 8 번]", "둘째는?", 1, [])
    a, b, c = got["markers"]  # a marker with nothing before and behind it is no question
    assert (a.number, a.unit, a.stem, list(a.choices)[:2], len(a.choices), list(a.images), a.tables) == ("5", "[3점][시험 05]", "첫 문제\n더\n이어짐", ["가", "나"], 5, ["a.png"], 0)
    assert (b.number, b.stem, list(b.choices), b.tables) == ("6", "둘째 문제", ["하나", "둘"], 1)
    assert (c.number, c.unit, c.stem, list(c.choices)) == ("", "", "끝 문장", [])
    told = [(r.number, r.is_passage, r.stem, list(r.choices), list(r.images), r.tables) for r in got["paragraphs"]]
    assert told == [("1", False, "머리말\n1. 첫째", ["가", "나"], ["a.png"], 0), ("[2~3]", True, "[2~3] 다음 글을 읽고 답하시오.\n글", [], [], 0), ("2", False, "2. 둘째", [], [], 0), ("3", False, "3. 셋째", [], [], 1)]
