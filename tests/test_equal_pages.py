"""Near-equal pages against all pairs, and documents that are far apart in their table."""

from __future__ import annotations

import collections
import random

import pytest

from paperloom import catalog
from paperloom.operators import audit
from paperloom.session import staged


def grams(t, n):
    return collections.Counter(t[i : i + n] for i in range(len(t) - n + 1)) if len(t) >= n else collections.Counter([t] if t else [])


def texts(rng):
    """Texts of all sizes with few and with many grams, some of them changed a little, some copied."""
    out = ["", None, "a", "a", "ab", "ab", "abc", "aaaa", "aaaaa", "a" * 500, "a" * 505, "a" * 520, "😀" * 200 + "é", "é" + "😀" * 200, "😀" * 200]
    for size in (5, 33, 34, 35, 67, 68, 140, 300, 900, 2500):
        for letters in ("ab", "abcdefghijklmnop ", "가나다라é😀 "):
            t = "".join(rng.choice(letters) for _ in range(size))
            out += [t, t]
            for change in (1, 2, 4, 8):
                u = list(t)
                for _ in range(change):
                    at = rng.randrange(len(u))
                    u[at : at + rng.randrange(2)] = rng.choice(letters)
                out.append("".join(u))
            out.append(t + t[: size // 40])
    return out


@pytest.mark.parametrize(("n", "least"), [(3, 0.985), (3, 0.9), (5, 0.97)])
def test_pairs_are_all_pairs(spark, n, least):
    rows = [(i % 2, i, t) for i, t in enumerate(x for t in texts(random.Random(7)) for x in (t, t))]
    df = spark.createDataFrame(rows, "g int, page long, t string")
    first, want = {}, set()
    for g, p, t in rows:
        if t and (g, t) in first:
            want.add((g, first[g, t], p, 1.0, True))
        elif t:
            first[g, t] = p
    kept = [(g, p, grams(t, n)) for (g, t), p in first.items()]
    for i, (g, a, x) in enumerate(kept):
        for h, b, y in kept[i + 1 :]:
            dice = 2 * (x & y).total() / (x.total() + y.total())
            if g == h and dice >= least:
                want.add((g, a, b, round(dice, 9), False))
    got = [(r.g, r.a, r.b, round(r.dice, 9), r.copy) for r in audit.near_equal_pages(df, "g", "page", "t", n, least).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({x for x in want if not x[4]}) > 20


def test_documents_far_apart_meet(spark, tmp_path):
    t = "".join(random.Random(1).choice("abcdefgh ") for _ in range(700))
    rows = [(3, t, "en"), (4000, t + "x", "en"), (9000, t, "en"), (9001, t, "de"), (12, "other words", "en"), (5, None, "en"), (6, t, None)]
    spark.createDataFrame([(i, x, lang, "s", 1) for i, x, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.lang, r.a, r.b, r.copy) for r in catalog.queries()["JOIN_14_equal_pages"](spark, str(tmp_path)).collect()}
    assert got == {("en", 3, 4000, False), ("en", 3, 9000, True)}


def test_only_texts_of_pairs_move(spark, monkeypatch):
    rng, rows = random.Random(3), []
    for _ in range(12):  # texts with eight others each that are like them, but not enough
        t = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1200))
        for _ in range(9):
            u = list(t)
            for at in rng.sample(range(len(u)), 20):
                u[at] = rng.choice("qrst")
            rows.append((1, len(rows), "".join(u)))
    rows += [(1, 500, rows[7][2] + "x"), (1, 501, rows[7][2]), (1, 502, rows[7][2])]
    kept = {}
    monkeypatch.setattr(audit, "staged", lambda df, name, *more: kept.setdefault(name, staged(df, name, *more)))
    got = {(r.a, r.b, r.copy) for r in audit.near_equal_pages(spark.createDataFrame(rows, "g int, page long, t string"), "g", "page", "t").collect()}
    assert got == {(7, 500, False), (7, 501, True), (7, 502, True)}
    assert max(df.count() for df in kept.values() if "text" in df.columns) == 2
