"""Page rules against tables worked out by hand, which share nothing with the queries' SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import compose, router
from paperloom.operators import segment as S

BOX = "struct<left:double,top:double,width:double,height:double>"


def test_columns_split_at_the_largest_gap(spark):
    rows = [(1, 1, 50.0), (1, 2, 60.0), (1, 3, 260.0), (1, 4, 290.0), (2, 1, 50.0), (2, 2, 150.0), (3, 1, 40.0), (4, 1, 10.0), (4, 2, 210.0), (4, 3, 410.0)]
    df = spark.createDataFrame([(p, i, x, 600.0) for p, i, x in rows], "page int, id int, x double, page_width double")
    got = {(r.page, r.id): r.column for r in S.column_split(df, ["page"]).collect()}
    # page 1: 260 and 290 lie left of the middle and beyond the gap; page 2: a gap of 100 is under 108; page 4: the first of two equal gaps.
    assert got == {(1, 1): 0, (1, 2): 0, (1, 3): 1, (1, 4): 1, (2, 1): 0, (2, 2): 0, (3, 1): 0, (4, 1): 0, (4, 2): 1, (4, 3): 1}


def test_only_the_missing_number_is_put_right(spark):
    rows = {"a": [1, 2, 4, 2], "b": [1, 2, 2, 4], "c": [1, 1], "d": [5, 6, 6, 8, 9], "e": [1, 2, 2, 2, 5], "f": [3, 4, 5], "g": [2, 2, 4]}
    df = spark.createDataFrame([(s, k, n) for s, numbers in rows.items() for k, n in enumerate(numbers)], "s string, k int, number long")
    got = {s: [r.repaired for r in S.repaired_number(df.where(F.col("s") == s), "s", "k").orderBy("k").collect()] for s in rows}
    assert got == rows | {"b": [1, 2, 3, 4], "d": [5, 6, 7, 8, 9], "g": [2, 3, 4]}


def test_lines_that_nearly_touch_a_region(spark):
    lines = spark.createDataFrame([(1, k, (10.0, t, 20.0, 10.0)) for k, t in enumerate((87.0, 88.0, 150.0, 202.0, 203.0))] + [(1, 9, (-27.0, 120.0, 40.0, 10.0)), (1, 10, (-26.0, 120.0, 40.0, 10.0))], f"page int, id int, line {BOX}")
    regs = spark.createDataFrame([(1, (0.0, 100.0, 100.0, 100.0))], f"page int, region {BOX}")
    assert {r.id for r in S.lines_in_regions(lines, regs, ["page"]).collect()} == {1, 2, 3, 10}


def test_content_ends_after_the_last_choice(spark):
    line = lambda key, top, height=12.0, choice=False: (key, top, 50.0, height, choice)
    lines = [
        line("run", 100.0), line("run", 120.0, choice=True), line("run", 140.0, choice=True), line("run", 160.0), line("run", 198.0), line("run", 250.0),
        line("plain", 100.0), line("plain", 400.0), line("short", 100.0), line("figure", 100.0, choice=True),
    ]
    regs = [(k, (0.0, 90.0, 300.0, 600.0), 700.0, 1000.0) for k in ("run", "plain", "short", "figure", "empty")]
    figures = [("figure", 2, (20.0, 240.0, 100.0, 60.0)), ("figure", 1, (20.0, 150.0, 100.0, 60.0)), ("figure", 3, (20.0, 160.0, 500.0, 90.0)), ("figure", 4, (400.0, 160.0, 50.0, 90.0)), ("figure", 5, (20.0, 430.0, 50.0, 90.0))]
    got = S.refined_bottoms(
        spark.createDataFrame(regs, f"key string, region {BOX}, until double, page_height double"),
        spark.createDataFrame(lines, "key string, top double, left double, height double, choice boolean"),
        spark.createDataFrame(figures, f"key string, ord long, figure {BOX}"), "key",
    )
    # The upper median height is 12, so a gap of 26.4 is the most: 160 + 12 to 198 is 26, to 250 is 40. Margin 8. The third figure
    # is too wide, the fourth beside the region, the fifth more than 120 below. "short" would be 30 high.
    assert {r.key: r.bottom for r in got.collect()} == {"run": 218.0, "plain": 420.0, "short": 700.0, "figure": 308.0, "empty": 700.0}


def test_markers_and_furniture(spark):
    texts = ["1. a", "12) b", "100. c", "1.5 d", "2024. 3. 5. e", "3. 2024학년도", "7.", "10시 30분 5초 오후", "저작권 x", "17", "PM 3. 4. 5."]
    rows = [(i, t, (0.0, 10.0 if i == 5 else 950.0 if i == 9 else 400.0, 10.0, 0.4 if t == "12) b" else 9.0), 1000.0) for i, t in enumerate(texts)] + [(20, "17", (0.0, 100.0, 10.0, 9.0), 1000.0), (21, "3. 2024학년도", (0.0, 100.0, 10.0, 9.0), 1000.0)]
    df = spark.createDataFrame(rows, f"id int, text string, box {BOX}, page_height double")
    assert {r.id: r.number for r in S.markers(df).collect()} == {0: 1, 6: 7, 21: 3}
    left = {r.id: (r.dated, r.header) for r in S.without_furniture(df).collect()}
    assert set(left) == {0, 1, 2, 3, 4, 5, 6, 7, 10, 20, 21} and {i for i, (x, _) in left.items() if x} == {4, 7} and {i for i, (_, x) in left.items() if x} == {5}


def test_block_kinds(spark):
    want = {"": "unknown", " \t": "unknown", "y = 2": "formula", "확률과 통계": "formula", "③ 다": "choice", "2) x": "choice", "6) x": "stem", "(2) x": "stem", "C. x": "choice", "제1장": "section", "가" * 23 + "장": "section", "가" * 24 + "장": "stem", "사회 영역": "stem", "login": "formula"}
    df = spark.createDataFrame(list(want.items()), "t string, kind string")
    assert {r.t: r.k for r in df.select("t", router.block_kind(F.col("t")).alias("k")).collect()} == {t: "formula" if "log" in t else k for t, k in want.items()}


def test_heights_by_hand(spark):
    schema = "id int, stem string, title string, choices array<string>, images array<string>, tables array<array<array<string>>>, answer string, explanation string"
    rows = [
        (1, "가" * 24, None, [], [], [], "③", "나" * 25),  # 10 + 5 + blank 6 + answer 6 + 2 lines
        (2, "", "제목", ["a", "b"], ["x"], [], "", ""),  # 10 + 5 + 2 * 5 + 34
        (3, None, None, [], [], [[["a" * 13, "b"], ["c", "d"]], []], None, None),  # 10 + 5 + 6 + 4 + 2 * (6 + 4)
        (4, None, None, [], [], [[["a" * 25, "b"], ["c", "d"]]], None, None),  # a cell of 24 units takes two lines
    ]
    df = spark.createDataFrame(rows, schema)
    c = F.col
    h = compose.estimated_height(c("stem"), c("choices"), c("images"), 2, tables=c("tables"), title=c("title"), answer=c("answer"), explanation=c("explanation"), blank=True)
    assert {r.id: r.h for r in df.select("id", h.alias("h")).collect()} == {1: 37, 2: 59, 3: 45, 4: 49}
