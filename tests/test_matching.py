"""One-use matching against the sequential rule on random inputs with ties, and fractions of choices on the rows that pin them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import matching


def taken_in_turn(wanted, costs):
    """wanted, in order, and costs[wanted][donor]: each takes the cheapest donor that is free."""
    used, out = set(), {}
    for w in wanted:
        free = [(c, d) for d, c in costs.get(w, {}).items() if d not in used]
        out[w] = min(free)[1] if free else None
        used.add(out[w])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_are_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(g, w, d, rng.randrange(4)) for g in range(25) for w in range(rng.randrange(1, 9)) for d in range(9) if rng.random() < 0.6]
    got = {(r.g, r.wanted): r.donor for r in matching.one_use(spark.createDataFrame(rows, "g int, wanted int, donor int, c int"), ["g"], F.col("wanted"), [F.col("c")]).collect()}
    want = {}
    for g in range(25):
        costs = {}
        for _, w, d, c in (r for r in rows if r[0] == g):
            costs.setdefault(w, {})[d] = c
        want |= {(g, w): d for w, d in taken_in_turn(sorted(costs), costs).items() if d is not None}
    assert got == want
    assert matching.one_use(spark.createDataFrame([], "g int, wanted int, donor int, c int"), ["g"], F.col("wanted"), [F.col("c")]).count() == 0


def test_nearest_donors(spark):
    rng = random.Random(3)
    places = [(g, k, float(rng.randrange(-40, 300)), float(rng.randrange(-30, 200))) for g in range(12) for k in range(20)]
    of = lambda half, name: spark.createDataFrame([p for p in places if p[1] % 2 == half], f"g int, {name} int, x double, y double")
    got = {(r.g, r.wanted): r.donor for r in matching.nearest_donors(of(1, "wanted"), of(0, "donor"), ["g"], 90.0, 60.0).collect()}
    want = {}
    for g in range(12):
        mine = [p for p in places if p[0] == g]
        order = sorted((p for p in mine if p[1] % 2), key=lambda p: (p[3], p[2], p[1]))
        costs = {w[1]: {d[1]: (d[3] - w[3], abs(d[2] - w[2]), d[3], d[2]) for d in mine if d[1] % 2 == 0 and 0 < d[3] - w[3] <= 60 and abs(d[2] - w[2]) <= 90} for w in order}
        want |= {(g, w): d for w, d in taken_in_turn([w[1] for w in order], costs).items()}
    assert got == want and any(d is None for d in got.values()) and any(d is not None for d in got.values())


def test_tables_of_a_region(spark):
    box, cells = "struct<left:double,top:double,width:double,height:double>", "array<array<string>>"
    page = (0.0, 0.0, 100.0, 100.0)
    source = spark.createDataFrame([(1, 1, 1, [["a", "b"], ["c"]], page), (1, 2, 2, [["a", "b"], ["c"]], page), (1, 3, 3, [["x"]], page)], f"g int, wanted int, place int, cells {cells}, region {box}")
    output = spark.createDataFrame([
        (1, 10, 1, [["a", "z"], ["c"]], (0.0, 0.0, 10.0, 10.0)), (1, 11, 2, [["a", "b"], ["c"]], (95.0, 0.0, 10.0, 10.0)), (1, 12, 3, [["a", "y"], ["c"]], (5.0, 5.0, 10.0, 10.0)),
        (1, 13, 4, [["a", "b", "c"]], (0.0, 0.0, 5.0, 5.0)), (1, 14, 5, [[None]], (0.0, 0.0, 5.0, 5.0)),
    ], f"g int, donor int, place int, cells {cells}, box {box}")
    got = {r.wanted: (r.donor, r.different) for r in matching.table_matches(source, output, ["g"]).collect()}
    assert got == {1: (10, 1), 2: (12, 1), 3: (14, 1)}  # 11 agrees in every cell, but only half of it lies in the region


def row(text, x, y, width=48.0, height=24.0):
    return text, (float(x), float(y), width, height)


FULL = [row("15. stem", 0, 0, 500.0)] + [row(v, 220 + 120 * k, 100) for k, v in enumerate(("15", "27", "39", "51", "63"))] + [row(f"{c}□", 220 + 120 * k, 120, 66.0, 36.0) for k, c in enumerate("①②③④⑤")] + [row("4", 220 + 120 * k, 145) for k in range(5)]
MIXED = [row("6. stem", 0, 0, 500.0)] + [row(v, x, 100) for x, v in ((220, "15"), (460, "17"), (700, "19"))] + [row(v, x, 120, 66.0, 36.0) for x, v in ((220, "①□"), (340, "②8"), (460, "③□"), (580, "④9"), (700, "⑤□"))] + [row("2", x, 145) for x in (220, 460, 700)]
SIGNS = [row("①-□", 0, 100, 48.0), row("②", 200, 100), row("③2□", 400, 100), row("④□5", 600, 100), row("⑤-x", 800, 100)] + [row(t, x, y) for t, x, y in (("3", 0, 80), ("7", 0, 130), ("a+1", 200, 90), ("b", 200, 120), ("1", 400, 60), ("2", 400, 160), ("9", 800, 99), ("far", 800, 30), ("한글", 600, 90))]


def test_fractions_of_choices(spark):
    lines = [(q, k, t, b) for q, rows in enumerate((FULL, MIXED, SIGNS, [row("① alone", 0, 0)])) for k, (t, b) in enumerate(rows)]
    df = spark.createDataFrame(lines, "q int, place int, text string, box struct<left:double,top:double,width:double,height:double>")
    got = {r.q: (r.stem, list(r.choices)) for r in matching.choice_fractions(df, ["q"]).collect()}
    assert got[0] == ("15. stem", [rf"\frac{{{n}}}{{4}}" for n in (15, 27, 39, 51, 63)])
    assert got[1] == ("6. stem", [r"\frac{15}{2}", "8", r"\frac{17}{2}", "9", r"\frac{19}{2}"])
    assert got[2] == ("far\n한글", [r"-\frac{3}{7}", r"\frac{a+1}{b}", r"2^{\frac{1}{2}}", r"\frac{1}{5}", r"-\frac{9}{x}"])
    assert 3 not in got
