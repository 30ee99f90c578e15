"""Formulas from boxes: random formula trees, laid out as a page would have them, must come back; named cases beside them."""

from __future__ import annotations

import random

import pytest

from paperloom.operators import formula

H = 10.0  # the height of a letter
LATEX = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "lim": r"\lim"}


def extent(node, s):
    """Width, and how far a node reaches above and below the line through its middle."""
    kind = node[0]
    if kind == "seq":
        parts = [extent(n, s) for n in node[1]]
        return sum(w + s for w, _, _ in parts), max(u for _, u, _ in parts), max(d for _, _, d in parts)
    if kind == "t":
        return 6 * s * len(node[1]) ** 0.5, H / 2 * s, H / 2 * s
    if kind == "frac":
        (a, au, ad), (b, bu, bd) = extent(node[1], s), extent(node[2], s)
        return max(a, b) + 4 * s, s + au + ad, s + bu + bd
    if kind == "sqrt":
        w, u, d = extent(node[1], s)
        return w + 7 * s, u + 1.5 * s, d + 0.5 * s
    if kind == "script":
        w, u, d = extent(node[1], s)
        for x, up in ((node[2], False), (node[3], True)):
            if x:
                xw, xu, xd = extent(x, 0.6 * s)
                w, u, d = (max(w, extent(node[1], s)[0] + xw + s), max(u, 4 * s + xu + xd), d) if up else (max(w, extent(node[1], s)[0] + xw + s), u, max(d, 4 * s + xu + xd))
        return w, u, d
    low, high = (extent(x, 0.6 * s) for x in node[2:])
    return max(8 * s, low[0], high[0]), 7 * s + high[1] + high[2], 7 * s + low[1] + low[2]


def laid(node, x, y, s, out):
    kind = node[0]
    box = lambda c, left, top, right, bottom: out.append((len(out), c, (left, top, right - left, bottom - top)))
    w, u, d = extent(node, s)
    if kind == "seq":
        for n in node[1]:
            laid(n, x, y, s, out)
            x += extent(n, s)[0] + s
    elif kind == "t":
        box(node[1], x, y - H / 2 * s, x + w, y + H / 2 * s)
    elif kind == "frac":
        (a, _, ad), (b, bu, _) = extent(node[1], s), extent(node[2], s)
        box("—", x, y - 0.4 * s, x + w, y + 0.4 * s)
        laid(node[1], x + (w - a) / 2, y - s - ad, s, out)
        laid(node[2], x + (w - b) / 2, y + s + bu, s, out)
    elif kind == "sqrt":
        box("√", x, y - u, x + w, y + d)
        laid(node[1], x + 6 * s, y, s, out)
        if node[2]:
            box(node[2], x, y - u * 0.7 - 2.5 * s, x + 3 * s, y - u * 0.7 + 2.5 * s)
    elif kind == "script":
        laid(node[1], x, y, s, out)
        right = x + extent(node[1], s)[0] + s / 2
        for n, up in ((node[2], False), (node[3], True)):
            if n:
                _, nu, nd = extent(n, 0.6 * s)
                laid(n, right, y - 4 * s - nd if up else y + 4 * s + nu, 0.6 * s, out)
    else:
        low, high = (extent(n, 0.6 * s) for n in node[2:])
        box(node[1], x + w / 2 - 4 * s, y - 6 * s, x + w / 2 + 4 * s, y + 6 * s)
        laid(node[2], x + (w - low[0]) / 2, y + 7 * s + low[1], 0.6 * s, out)
        laid(node[3], x + (w - high[0]) / 2, y - 7 * s - high[2], 0.6 * s, out)
    return out


def written(node):
    kind = node[0]
    if kind == "seq":
        return "".join(map(written, node[1]))
    if kind == "t":
        return node[1]
    if kind == "frac":
        return rf"\frac{{{written(node[1])}}}{{{written(node[2])}}}"
    if kind == "sqrt":
        return rf"\sqrt{f'[{node[2]}]' if node[2] else ''}{{{written(node[1])}}}"
    if kind == "script":
        return written(node[1]) + "".join(f"{m}{{{written(n)}}}" for m, n in (("_", node[2]), ("^", node[3])) if n)
    return f"{LATEX[node[1]]}_{{{written(node[2])}}}^{{{written(node[3])}}}"


def tree(rng, depth):
    t = lambda: ("t", rng.choice("abcxyz123+"))
    seq = lambda d, most=3: ("seq", [tree(rng, d) for _ in range(rng.randrange(1, most + 1))])
    if depth == 0:
        return t()
    kind = rng.choice(["t", "t", "frac", "sqrt", "script", "op"])
    if kind == "frac":
        return "frac", seq(depth - 1), seq(depth - 1)
    if kind == "sqrt":
        return "sqrt", seq(depth - 1), rng.choice([None, None, "3"])
    if kind == "script":
        low, high = rng.choice([(1, 0), (0, 1), (1, 1)])
        return "script", ("t", rng.choice("abcxyz")), seq(depth - 1, 2) if low else None, seq(depth - 1, 2) if high else None
    if kind == "op":
        return "op", rng.choice("∑∏∫"), ("seq", [("t", "k"), ("t", "="), t()]), ("seq", [t()])
    return t()


def boxes(spark, trees):
    rows = [(page, line, i, c, b) for (page, line), n in trees.items() for i, c, b in laid(n, 20.0 + 3 * line, 100.0, 1.0, [])]
    return spark.createDataFrame(rows, "page int, line int, id int, c string, box struct<left:double,top:double,width:double,height:double>")


T = lambda s: ("seq", [("t", c) for c in s])
NAMED = {
    r"\frac{a+1}{b}": ("frac", T("a+1"), T("b")),
    r"\frac{\frac{a}{b}}{c+d}": ("frac", ("seq", [("frac", T("a"), T("b"))]), T("c+d")),
    r"\frac{1}{\frac{x}{2}+y}": ("frac", T("1"), ("seq", [("frac", T("x"), T("2")), ("t", "+"), ("t", "y")])),
    r"\sqrt{x+1}": ("sqrt", T("x+1"), None),
    r"\sqrt[3]{\frac{a}{b}}": ("sqrt", ("seq", [("frac", T("a"), T("b"))]), "3"),
    r"x^{2}": ("script", ("t", "x"), None, T("2")),
    r"a_{n+1}^{2}": ("script", ("t", "a"), T("n+1"), T("2")),
    r"x^{\frac{1}{2}}": ("script", ("t", "x"), None, ("seq", [("frac", T("1"), T("2"))])),
    r"x^{y^{2}}": ("script", ("t", "x"), None, ("seq", [("script", ("t", "y"), None, T("2"))])),
    r"\sum_{k=1}^{n}k": ("seq", [("op", "∑", T("k=1"), T("n")), ("t", "k")]),
    r"\int_{0}^{1}\frac{x}{2}": ("seq", [("op", "∫", T("0"), T("1")), ("frac", T("x"), T("2"))]),
}


def test_named_formulas(spark):
    told = NAMED
    got = {r.line: r.latex for r in formula.formulas(boxes(spark, {(1, k): n for k, n in enumerate(told.values())}), ["page", "line"]).collect()}
    assert [got[k] for k in range(len(told))] == list(told)


def test_limit_below_only(spark):
    rows = [(1, 0, "lim", (0.0, 0.0, 14.0, 10.0)), (1, 1, "n", (0.0, 12.0, 4.0, 6.0)), (1, 2, "→", (4.0, 12.0, 4.0, 6.0)), (1, 3, "∞", (9.0, 12.0, 4.0, 6.0)), (1, 4, "a", (16.0, 0.0, 6.0, 10.0)), (2, 0, "∑", (0.0, 0.0, 8.0, 12.0)), (2, 1, "a", (9.0, 1.0, 6.0, 10.0))]
    df = spark.createDataFrame(rows, "line int, id int, c string, box struct<left:double,top:double,width:double,height:double>")
    assert {r.line: r.latex for r in formula.formulas(df, ["line"]).collect()} == {1: r"\lim_{n\rightarrow \infty }a", 2: r"\sum a"}
    assert formula.formulas(df.limit(0), ["line"]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_formulas_come_back(spark, seed):
    rng = random.Random(seed)
    trees = {(p, k): ("seq", [tree(rng, 2) for _ in range(rng.randrange(1, 4))]) for p in range(5) for k in range(30)}
    got = {(r.page, r.line): r.latex for r in formula.formulas(boxes(spark, trees), ["page", "line"]).collect()}
    want = {k: written(n) for k, n in trees.items()}
    wrong = {k: (got.get(k), want[k]) for k in want if got.get(k) != want[k]}
    assert not wrong, (len(wrong), list(wrong.values())[:4])
