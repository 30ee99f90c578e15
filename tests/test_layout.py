"""Grids against cell-by-cell painting, and profiles by hand."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import layout_score


def test_cover_is_what_painting_gives(spark):
    rng = random.Random(1)
    rows = [(p, "source", *(lambda x, y: (x, y, x + rng.randrange(0, 60), y + rng.randrange(0, 60)))(rng.randrange(-20, 110), rng.randrange(-20, 110))) for p in range(4) for _ in range(25)]
    df = spark.createDataFrame([(p, s, float(a), float(b), float(c), float(d)) for p, s, a, b, c, d in rows], "page int, side string, left double, top double, right double, bottom double")
    want = np.zeros((4, 16, 16), int)
    for p, _, a, b, c, d in rows:
        cell = lambda x, up: min(max(int(np.ceil(x * 16 / 100) if up else np.floor(x * 16 / 100)), 0), 16)
        want[p, cell(b, 0) : cell(d, 1), cell(a, 0) : cell(c, 1)] += 1
    got = layout_score.covered(df, ["page"], 100.0, 100.0, 16).collect()
    assert len(got) == 4 * 256 and all(want[r.page, r.row, r.col] == r.cover for r in got)


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), ([], [1.0], 0.0), ([0.0], [0.0], 1.0), ([0.0], [2.0], 0.0), ([1.0, 3.0], [2.0, 6.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([2.0, 2.0, 9.0], [2.0, 1.0], 0.65 * (1 - (abs(1 / 2 - 2 / 3) + abs(1 / 2 - 1 / 3)) / 2) + 0.35 * 1.5 / 2)])
def test_profiles(spark, a, b, want):
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(layout_score.profile_similarity(F.col("a"), F.col("b")).alias("s")).first()
    assert row.s == pytest.approx(want)


def test_scores_of_equal_and_of_missing_sides(spark):
    box = lambda p, s, x: (p, s, x, 10.0, x + 20, 30.0)
    df = spark.createDataFrame([box(1, "source", 5.0), box(1, "output", 5.0), box(2, "source", 5.0)], "page int, side string, left double, top double, right double, bottom double")
    got = {r.page: r for r in layout_score.layout_scores(df, ["page"], 100.0, 100.0).collect()}
    assert got[1].score == pytest.approx(1.0) and got[2].score == 0.0


def test_scores_need_no_row_a_cell(spark):
    rng = random.Random(3)
    rows = [(p, s, *(lambda x, y: (x, y, x + rng.randrange(0, 60), y + rng.randrange(0, 60)))(rng.randrange(-20, 110), rng.randrange(-20, 110))) for p in range(70) for s in ("source", "output") for _ in range(6)]
    df = spark.createDataFrame([(p, s, *map(float, r)) for p, s, *r in rows], "page int, side string, left double, top double, right double, bottom double")
    scores = layout_score.layout_scores(df, ["page"], 100.0, 100.0, 16)
    assert "sequence" not in scores._jdf.queryExecution().optimizedPlan().toString()
    cells = {(r.page, r.side, r.row, r.col): r.cover > 0 for r in layout_score.covered(df, ["page", "side"], 100.0, 100.0, 16).collect()}
    for r in scores.collect():
        x, y = (np.array([[cells[r.page, s, i, j] for j in range(16)] for i in range(16)], float) for s in ("source", "output"))
        soft = [z.reshape(4, 4, 4, 4).mean((1, 3)) for z in (x, y)]
        assert r.occupancy_score == pytest.approx(np.minimum(*soft).sum() / np.maximum(*soft).sum())
        assert r.density_score == pytest.approx(min(x.sum(), y.sum()) / max(x.sum(), y.sum()))
        smooth = [[sum(z.sum(1)[max(i - 3, 0) : i + 4]) / 7 for i in range(16)] for z in (x, y)]
        one = spark.createDataFrame([tuple(map(lambda v: list(map(float, v)), smooth))], "a array<double>, b array<double>") if r.page % 35 == 0 else None
        assert one is None or one.select(layout_score.profile_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(r.row_score)
