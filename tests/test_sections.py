"""Answer sections of documents: the cases that pin the rule, and random documents against the plain scan."""

from __future__ import annotations

import random

from paperloom.functions import exam_text
from paperloom.operators import sections

CASES = [
    (["1. 첫째", "① 가 ② 나", "2. 둘째", "① 가", "빠른 정답", "1. ③ 2. ⑤"], [4, 5]),
    (["1. 첫째", "2. 둘째", "정답표", ""], [2, 3]),
    (["1. 첫째", "[정답] ③", "2. 둘째", "[정답] ⑤", "3. 셋째", "[정답] ①"], []),
    (["정답 및 해설", "1. ③ 첫 문항 해설", "2. ⑤ 둘째 문항 해설"], []),
    (["1. 가", "2. 나", "2025학년도 3월 모의고사 정답 및 해설", "[정답표] 1. ③ 2. ⑤", "1. [해설] 정답 ③ 해설입니다."], [2, 3, 4]),
    (["1. 가", "빠른 정답", "1. ③", "2. ④", "2. 나", "정답표", "3. ①", "3. 다"], [1, 2, 3, 5, 6]),
    (["1. 철수가 만든 정답표", "① 가", "철수가 만든 정답표", "① 가 2. ③ 3. ④"], []),
    ([], []), (["본문"], []),
]


def run(spark, docs):
    rows = spark.createDataFrame([(d, k, t, "x") for d, of in enumerate(docs) for k, t in enumerate(of)], "doc int, pos int, text string, until string")
    out = sections.answer_sections(rows.withColumnRenamed("until", "more"), ["doc"]).collect()
    assert len(out) == sum(map(len, docs))
    return [sorted(r.pos for r in out if r.doc == d and r.section is not None) for d in range(len(docs))]


def test_sections(spark):
    assert run(spark, [of for of, _ in CASES]) == [cut for _, cut in CASES]


def test_rounds_are_the_scan(spark):
    rng = random.Random(8)
    parts = ["빠른 정답", "정답 및 해설", "본문", "1회 정답표", "1. ③ 2. ④"] + [f"{n}. 문항" for n in range(1, 7)] + [f"{n}. ③" for n in range(1, 7)]
    docs = [[rng.choice(parts) for _ in range(rng.randrange(1, 22))] for _ in range(120)]
    want = []
    for of in docs:
        blocks = [{"text": t, "k": k} for k, t in enumerate(of)]
        want.append([b["k"] for b in exam_text._without_key(blocks)[1]])
    assert run(spark, docs) == want
