"""Text rules against tables of input and expected output."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paperloom.functions import exam_columns, exam_text as T, text as X


@pytest.mark.parametrize(
    ("script", "latex"),
    [
        ("root {3} of {x+1}", r"\sqrt[3]{x+1}"), ("1 over 2", r"\frac{1}{2}"), ("{a+b} over {c}", r"\frac{a+b}{c}"), ("sqrt {x}", r"\sqrt{x}"),
        ("x^2 + y_1", "x^{2}+y_{1}"), ("alpha times beta", r"\alpha\times\beta"), ("pi r^{2}", r"\pi r^{2}"),
        ("LEFT ⌊ a+b RIGHT ⌋", r"\left\lfloor a+b\right\rfloor"), ("a ± b != c LEQ d", r"a\pm b\neq c\leq d"), ("LEFT { x RIGHT }", r"\left\{x\right\}"),
        ("{ { 1 } over { x } } over { y }", r"\frac{\frac{1}{x}}{y}"), ('{a} over {b} + x _ {"over"}', r"\frac{a}{b}+x_{\text{over}}"),
        ("groot + cover", "groot+cover"), ("{ vec {AB} }", r"\overrightarrow{AB}"), ("arch {AB}", r"\overset{\frown}{AB}"), ("OVERBRACE {x+y} {n}", r"\overbrace{x+y}^{n}"),
        ("{n} choose {r}", r"\binom{n}{r}"), ("^3sqrt {x^{2}+1}", r"\sqrt[3]{x^{2}+1}"), ("lim _{x->0} {sin x} over {x}", r"\lim_{x\rightarrow0}\frac{\sin x}{x}"),
        ('x=1"이면 "y=2', r"x=1\text{이면}y=2"), ("{a _{n}it^{2} +5} over {3}", r"\frac{a_{n}^{2}+5}{3}"), ("{ pmatrix {a & b # c & d} }", r"\begin{pmatrix}a&b\\c&d\end{pmatrix}"),
        ("{cases{`x&x<0#y&x>0}}", r"\begin{cases}x&x<0\\y&x>0\end{cases}"), ("", ""), ("}}a", "a"), ("over x ^", "overx^{}"), ("{" * 5000, "{" * 5000),
    ],
)
def test_scripts(script, latex):
    assert T.script_to_latex(script) == latex


def test_math_spans():
    for raw, normal in (("x²", "x^{2}"), ("xₙ", "x_{n}"), ("½", r"\frac{1}{2}")):
        assert [s["normalized"] for s in T.math_spans(f"값 {raw} 는")] == [normal]
    for raw in ("시험일 2026-07-07", "쪽 범위 100-200", "문항 ID A1-2026", "가격은 $5 and $10"):
        assert T.math_spans(raw) == []
    assert T.split_math("가 $x+1$ 나") == [("가 ", False), ("$x+1$", True), (" 나", False)]


def test_choices():
    assert T.split_choices("1. 고르시오.\n① 가 ② 나 ③ 다") == ("1. 고르시오.", ["가", "나", "다"])
    assert T.split_choices("고르면? 1 가 2 나 3 다") == ("고르면?", ["가", "나", "다"])
    assert T.split_choices("2. 옳은 것은?\n1) 가\n2) 나\n3) 다") == ("2. 옳은 것은?", ["가", "나", "다"])
    assert T.split_choices("1. 본문만 있다.") == ("1. 본문만 있다.", [])


def test_answers():
    assert T.split_answer("본문\n정답: ①\n해설: 까닭\n더\n정답: ③") == ("본문", "③", "까닭\n더")
    assert T.answer_pairs("1. ③ 2. ⑤ 1. ①") == {"1": "③", "2": "⑤"}
    assert T.answer_pairs("① 1 ② 2 ③ 3") == {}
    assert T.answer_pairs("", [[["1", "2"], ["②", "④"]]]) == {"1": "②", "2": "④"}


def blocks(*texts):
    return [{"text": t} for t in texts]


def test_chunks_take_the_key_and_lose_it():
    items, report = T.chunked([*blocks("1. 첫째", "① 가 ② 나", "2. 둘째", "① 가 ② 나", "빠른 정답", "1. ③ 2. ⑤")])
    assert [(i["number"], i["answer"], i["choices"]) for i in items] == [("1", "③", ["가", "나"]), ("2", "⑤", ["가", "나"])]
    assert report == {"mapped": 2, "unmatched": 0} and not any("정답" in i["stem"] for i in items)
    items, report = T.chunked([*blocks("1. 첫째", "2. 둘째"), {"text": "정답표", "tables": [[["1", "2", "9"], ["②", "④", "①"]]]}])
    assert [i["answer"] for i in items] == ["②", "④"] and report["unmatched"] == 1


def test_chunks_keep_what_stands_before_a_question():
    items, _ = T.chunked(blocks("머리말", "1. 첫째\n[정답] ③", "[2~3] 다음 글을 읽고", "지문", "2. 둘째", "정답 및 해설 없는 글"))
    assert [i["stem"] for i in items][:2] == ["머리말\n1. 첫째", "[2~3] 다음 글을 읽고\n지문\n2. 둘째\n정답 및 해설 없는 글"] or len(items) == 2
    assert items[0]["answer"] == "③"
    assert len(T.chunked(blocks("정답 및 해설", "1. 가", "2. 나"))[0]) == 2
    assert T.chunked(blocks("번호 없는 글"))[0][0]["stem"] == "번호 없는 글" and T.chunked([]) == ([], {"mapped": 0, "unmatched": 0})


def test_numbers_and_glyphs():
    assert [T.numbered(n, k) for n, k in ((4, "roman"), (9, "ROMAN"), (3, "circled"), (2, "hangul"), (3, "jamo"), (2, "latin"), (7, "digit"))] == ["iv", "IX", "③", "나", "ㄷ", "b", "7"]
    assert T.glyphs("𝑥＋１") == "x+1□" and T.glyphs("", {"": "√"}) == "√"
    assert T.semantic("Ａ-b, ß！") == "abss"


def test_headers(spark):
    rows = [("2025학년도 6월 모의평가", "2025학년도 대학수학능력시험 6월 모의평가 문제지"), ("2024년_9월_고2_전국연합학력평가", "2024학년도 9월 고2 전국연합학력평가 문제지"), ("2026학년도 수능", "2026학년도 대학수학능력시험 문제지"), ("6월 모의평가", ""), ("2025년 회의록", ""), (None, "")]
    got = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(rows)], "i int, raw string").select("i", exam_columns.masthead(exam_columns.exam_header(F.col("raw"))).alias("m"))
    assert [r.m for r in got.orderBy("i").collect()] == [m for _, m in rows]


def test_columns(spark):
    df = spark.createDataFrame([("  a  b\x1c",), ("가나 x",), ("",), (None,)], "t string")
    out = df.select(X.collapsed(X.text("t")).alias("c"), X.visual_units(X.text("t")).alias("u"), X.grams(X.text("t")).alias("g")).collect()
    assert [r.c for r in out] == ["a b", "가나 x", "", ""] and out[1].u == 6 and out[1].g == ["가나 ", "나 x"] and out[2].g == []
    found = spark.createDataFrame([("50% a\\b",), ("50x a\\b",), ("ÄB",)], "t string")
    assert found.where(X.like(F.col("t"), "0% A\\B")).count() == 2 and found.where(X.like(F.col("t"), "äb")).count() == 0


def test_numbered_lines():
    assert T.numbered_lines(["27. 값은?", "더"], "3") == ["3. 값은?", "더"]
    assert T.numbered_lines(["3.5는 수다."], "4") == ["4. 3.5는 수다."]
    assert T.numbered_lines(["[1~2] 다음 글을 읽고 답하시오.", "지문", "옳은 것은? [2점]"], "1") == ["[1~2] 다음 글을 읽고 답하시오.", "지문", "1. 옳은 것은? [2점]"]
    assert T.numbered_lines([], "1") == ["1."] and T.numbered_lines(["가"], "") == ["가"]


def test_key_sections():
    for t in ("빠른 정답", "정답 및 해설", " 정답과 해설 1회", "정답표", "[정답 표] 1. ③"):
        assert T.starts_key(t), t
    for t in ("[정답] ③", "1. 정답표를 보고", "본문", "", "   ", "철수가 만든 정답표"):
        assert not T.starts_key(t), t
    title = "2025학년도 화학 정답 및 해설"
    assert T.starts_key(title, ("1. ③", "2. ④")) and not T.starts_key(title, ("1. ③",)) and not T.starts_key(title, ("① 가", "1. ③ 2. ④"))


def test_key_ends_before_the_next_question():
    items, report = T.chunked(blocks("1. 가", "빠른 정답", "1. ③", "2. ④", "2. 나", "① x ② y"))
    assert [(i["number"], i["answer"], i["stem"], i["choices"]) for i in items] == [("1", "③", "1. 가", []), ("2", "④", "2. 나", ["x", "y"])]
    assert report == {"mapped": 2, "unmatched": 0}


def test_formulas_with_scripts_are_whole():
    told = lambda t: [s["text"] for s in T.math_spans(t)]
    assert told("값 x^{2}+1 은") == ["x^{2}+1"] and told("a_1 + b") == ["a_1 + b"] and told("x_{n+1}") == ["x_{n+1}"] and told("y=a^2") == ["y=a^2"]


def test_answer_lines_and_heads():
    for line in ("답답한 사람은 누구인가?", "해설자는 말했다.", "Answers vary here", "정답률이 낮다", "풀이법을 쓰시오", "solutions exist"):
        assert T.split_answer(f"{line}\n답 ②") == (line, "②", "")
    assert T.split_answer("본문\n답 : 3\n해설\n까닭\n[풀이]더\n정답\t4") == ("본문", "4", "까닭\n더")
    assert T.split_answer("본문\n[정답] ③\n남은 본문") == ("본문\n남은 본문", "③", "")
    assert T.split_answer("본문\n정답 및 해설\n더") == ("본문\n정답 및 해설\n더", "", "")
    assert T.split_answer("정답: 해설\nAnswer : x+1 \n  Solution\n까닭\n\n\n\n끝") == ("정답: 해설", "x+1", "까닭\n\n끝")
    assert T.split_answer("가\r\n풀이: 하나\r\n해설 둘") == ("가", "", "하나\n둘") and T.split_answer("") == ("", "", "")


def test_labels_of_choices():
    assert T.split_choices("고르면?\n1 가\n2 나\n3 다\n4 라") == ("고르면?", ["가", "나", "다", "라"])
    assert T.split_choices("고르면?\n1) 가\n2) 나") == ("고르면?\n1) 가\n2) 나", [])
    assert T.split_choices("고르면?\n(1) 가\n(2) 나\n(3) 다\n7) 라") == ("고르면?\n7) 라", ["가", "나", "다"])
    assert T.split_choices("고르면?\nA. 가\n③ 나") == ("고르면?", ["가", "나"])
    assert T.split_choices("  들여 쓴 줄\n값 2 3 4") == ("들여 쓴 줄\n값 2 3 4", [])
    assert T.split_choices("① ② ③") == ("", ["①", "②", "③"]) and T.split_choices("") == ("", [])


def test_pairs_among_lists_of_choices():
    assert T.answer_pairs("1번 정답 ② 2) ④, 1234 ⑤ 3.5 ①") == {"1": "②", "2": "④"}
    assert T.answer_pairs("1 ③ 2 ① 3 ④") == {"1": "③", "2": "①", "3": "④"}
    assert T.answer_pairs("보기 ① 10 ② 20 ③ 30\n7. ④") == {"7": "④"}
    assert T.answer_pairs("3 ❷") == {}


def test_loose_keys_are_worked_out_once(spark):
    from paperloom import catalog

    plan = catalog.queries()["DED_5_loose_keys"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("미적분") == 1


def test_widths_of_odd_lines(spark):
    texts = ["", "a\r\nb\rc\n", "\r\r\n\n", "가" * 30 + "\r" + "é" * 60, "x" * 100, "😀　 " * 20]
    units = lambda t: sum(2 if ord(c) > 255 and not c.isspace() else 1 for c in t)
    want = [sum(max(1, -(-units(x) // 48)) for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n")) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = rows.select(X.wrapped_lines(X.text("t"), 48).alias("n"), X.visual_units(X.text("t")).alias("u")).collect()
    assert [(r.n, r.u) for r in got] == [(w, units(t)) for w, t in zip(want, texts, strict=True)]


def test_names_from_heads_of_long_texts(spark):
    import random
    import re
    import unicodedata

    from paperloom.operators import bank

    deal = random.Random(9)
    kinds = ["ab.c-_ 9", "ae\u0301\u0323o ", "\u1112\u1161\u11ab가각 a", "가\u11a8b", "  ?!\t\n", "漢字 x", "a/ \\b", "\u212a\u2126\u0958z", "a\u0345\u0301/é"]
    texts = ["", " ", "/", "a" * 79 + "e" + "\u0301" * 900 + "b", "a" + "\u0301" * 900 + "b" * 200, "e\u0301" * 500, " " * 2000 + "name", "x " * 60 + "\u1112\u1161\u11ab" * 300, "한글 " * 900, "?" * 999 + "/" + " " * 999 + "\u0301x" * 200]
    texts += ["".join(deal.choice(deal.choice(kinds)) for _ in range(n)) for n in (60, 200, 250, 400, 900) for _ in range(20)]
    texts += ["".join(deal.choice(kind) for _ in range(n)) for n in (250, 700) for kind in kinds for _ in range(5)]
    names = r"[^0-9A-Za-z가-힣._-]+"
    composed = lambda t: unicodedata.normalize("NFC", t)
    upload = lambda t: composed(re.split(r"[/\\]", t)[-1]).strip(" ") or "upload"
    want = [(re.sub(names, "_", composed(t))[:80], re.sub(names.replace("-]", " -]"), "_", upload(t))[:120]) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [(r.name, r.upload) for r in rows.select(bank.safe_name(F.col("t")).alias("name"), bank.upload_name(F.col("t")).alias("upload")).collect()] == want
    long = spark.range(1).select(F.octet_length(bank._telling(F.repeat(F.lit("word and é "), 100000), 80)).alias("n")).first()
    assert long.n <= 4 * 3 * 80  # no more is composed
