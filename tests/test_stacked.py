"""Rows of torn formulas: each rule by hand, and overlapping matches against a scan from top to bottom."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import stacked

CASES = {
    "값 √\n3\n3□2×5□4": r"값 \sqrt[3]{2}×5^{\frac{3}{4}}",
    "√\n3\n3□2 가 5□4": "√\n3\n3□2 가 5□4",
    "log2□x + alog3□y": r"\log_{2}x + alog3□y",
    "lim\nh→0□\nf(1+h)-f(1)의\nh\nvalue": r"\lim_{h\to0}\frac{f(1+h)-f(1)}{h}의" + "\nvalue",
    "식 lim\nx -> ∞\nx+1의 값은?\nx-1": r"식 \lim_{x->∞}\frac{x+1}{x-1}의 값은?",
    "b=□2\n1\nok": "b=\\frac{1}{2}\nok",
    "3t2-6t\nx=t3-□2\nok": "x=t3-\\frac{3t2-6t}{2}\nok",
    "문장\nP(A)=□5": "문장\nP(A)=\\frac{1}{5}",
    "①\nx=□2": "①\nx=\\frac{1}{2}",
    "P(A)=□5\ncos(x)=-□3\nx\\to0□": "P(A)=\\frac{1}{5}\ncos(x)=-\\frac{1}{3}\nx\\to0",
    "7\n2□3": r"2^{\frac{7}{3}}",
    "2□3\n7": r"2^{\frac{7}{3}}",
    "3\n × a": " × a^{3}",
    "f(x)={x (x>0)\n□\n□□\n-x": "f(x)={x (x>0)\n-x",
    "□\n-x": "□\n-x",
    "확률은 □p 이다. 서로소\np+q의 값": "확률은 \\frac{p}{q} 이다. 서로소\np+q의 값",
    "q√2 와 □p 서로소\np, q": "q√2 와 □p 서로소\np, q",
    "□p\np+q": "□p\np+q",
    "1\n=□2\n3": "=\\frac{1}{2}\n3",
    "": "", "plain": "plain",
}


def run(spark, texts, step=None):
    rows = spark.createDataFrame([(d, k, t) for d, s in enumerate(texts) for k, t in enumerate(s.split("\n"))], "doc int, pos int, text string")
    out = stacked.repaired(rows, ["doc"]) if step is None else step(rows.withColumn("pos", F.col("pos").cast("long")), ["doc"])
    got = {}
    for r in out.orderBy("doc", "pos").collect():
        got.setdefault(r.doc, []).append(r.text)
    return ["\n".join(got.get(d, [])) for d in range(len(texts))]


def test_each_rule(spark):
    assert dict(zip(CASES, run(spark, list(CASES)), strict=True)) == CASES


@pytest.mark.parametrize("seed", [1, 2])
def test_the_first_of_overlapping_matches_wins(spark, seed):
    """Letters decide: b joins the row before, a joins the next one, x vanishes."""
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice(["a1", "b2", "ab3", "c4", "x"]) for _ in range(rng.randrange(1, 14))) for _ in range(200)]

    def scan(lines):
        out, free, i = [], [], 0
        while i < len(lines):
            t = lines[i]
            if t == "x":
                i += 1
            elif "b" in t and out and free[-1]:
                out[-1], free[-1] = f"[{out[-1]}<{t}]", False
                i += 1
            elif "a" in t and i + 1 < len(lines):
                out.append(f"[{t}>{lines[i + 1]}]")
                free.append(False)
                i += 2
            else:
                out.append(t)
                free.append(True)
                i += 1
        return out

    def step(rows, by):
        from pyspark.sql import Window as W

        w = W.partitionBy(*by).orderBy("pos")
        gone = F.col("text") == "x"
        last = F.last(F.when(~gone, F.col("text")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
        rows = rows.withColumns({"p": last, "n": F.lead("text").over(w)})
        back = F.when(F.contains("text", F.lit("b")) & F.col("p").isNotNull(), F.concat(F.lit("["), "p", F.lit("<"), "text", F.lit("]")))
        ahead = F.when(F.contains("text", F.lit("a")) & F.col("n").isNotNull(), F.concat(F.lit("["), "text", F.lit(">"), "n", F.lit("]")))
        return stacked.merged(rows, by, back, ahead, 2, gone)

    assert run(spark, texts, step) == ["\n".join(scan(t.split("\n"))) for t in texts]


def test_steps_share_one_exchange(spark):
    rows = spark.createDataFrame([(1, 0, "y=□2"), (1, 1, "3"), (2, 0, "x")], "doc int, pos int, text string")
    out = stacked.repaired(rows, ["doc"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Union" not in plan
    assert {(r.doc, r.pos): r.text for r in out.collect()} == {(1, 0): "y=\\frac{3}{2}", (2, 0): "x"}
