"""Operators on fixtures, ordered folds against loops, and every query against its SQL."""

from __future__ import annotations

import collections
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom import catalog
from paperloom.operators import audit, bank, compose, geometry, jobs, router, segment
from paperloom.registry import ORACLES, QUERIES, table

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return tuple(map(plain, v.values())) if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(n) for n in names]
    want = collections.Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert collections.Counter(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_import_order(spark):
    schema = "id long, source_name string, stem string"
    old = spark.createDataFrame([(1, "a", "Alpha"), (2, "b", "Gamma")], schema).withColumn("content_hash", bank.identity(F.col("stem")))
    new = spark.createDataFrame([(10, "a", " Alpha "), (11, "b", "Alpha"), (12, "c", "Alpha"), (13, "c", "  "), (14, "c", ""), (15, "a", "ALPHA")], schema)
    got = {r.id: (r.state, r.duplicate_of) for r in bank.import_unique(new, old).collect()}
    assert got == {10: ("existing", 1), 11: ("created", None), 12: ("skipped", None), 13: ("created", None), 14: ("created", None), 15: ("created", None)}


def test_layout_plan_is_the_loop(spark):
    got = {(r.sel, r.pos): (r.start_slot, r.end_slot, r.break_before) for r in QUERIES["WIN_14_layout_plan"](spark, DATA).collect()}
    rows = collections.defaultdict(list)
    from paperloom.plans.compose_queries import numbered

    for r in numbered(spark, DATA).orderBy("sel", "pos").collect():
        rows[r.sel].append((r.pos, r.quantity * 3))
    for sel, items in rows.items():
        slot = used = 0
        for pos, h in items:
            brk = used > 0 and (h > 100 or used + h > 100)
            slot, used = (slot + 1, 0) if brk else (slot, used)
            first = last = slot
            if h > 100:
                last = slot = first + -(-h // 100) - 1
                used = h % 100
                slot, used = (slot, used) if used else (slot + 1, 0)
            else:
                used += h
            assert got[sel, pos] == (first, last, brk)


def test_baskets_and_limits_are_loops(spark):
    e = table(spark, DATA, "events").orderBy("event_id").collect()
    baskets, opened = collections.defaultdict(list), {}
    allowed = {}
    for r in e:
        b, i = baskets[r.user_id], json.loads(r.props)["k"]
        if r.event_type == "error":
            b.clear()
        elif r.event_type == "purchase":
            b[:] = [x for x in b if x != i]
        elif r.event_type == "view":
            if i in b:
                b.remove(i)
                b.insert(0, i)
        elif i not in b:
            b.append(i)
    for r in sorted(e, key=lambda r: (r.ts, r.event_id)):
        t0, n = opened.get(r.user_id, (None, 0))
        t = r.ts.timestamp()
        if t0 is None or t >= t0 + 86400:
            t0, n = t, 0
        opened[r.user_id] = t0, n + 1
        allowed[r.event_id] = n + 1 <= 2
    assert {r.user_id: r.ids for r in QUERIES["CMP_1_baskets"](spark, DATA).collect()} == dict(baskets)
    assert {r.pos: r.allowed for r in QUERIES["STM_6_fixed_window"](spark, DATA).collect()} == allowed


def test_reviews_find_what_is_wrong(spark):
    good = ("1", "t", "stem", ["① a", "② b"], "1", "why")
    cases = [(good, 100), (("", *good[1:]), 97), (("1", "t", "", ["① a", "② b"], "1", "why"), 80), (("1", "t", "s", ["① a", "③ b"], "1", "why"), 80), (("1", "t", "s", ["① a", "② A "], "1", "why"), 77), (("1", "t", "s", ["① a", "② b"], "", "why"), 80), (("1", "t", "s", ["① a", "② b"], "④", "why"), 80), (("1", "t", "s", ["① a", "② b"], "?", ""), 80), (("1", "t", "$x", ["① a", "② b"], "1", "why"), 80), (("1", "t", "{x}}", ["① a", "② b"], "1", "why"), 80), (("1", "t", "s", [], "3", "why"), 97)]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, number string, title string, stem string, choices array<string>, answer string, explanation string")
    assert [r.score for r in audit.reviewed(df).orderBy("i").collect()] == [s for _, s in cases]


def test_numbering_limits(spark):
    items = spark.createDataFrame([(1, "27", None), (2, "27", None), (3, " ", None), (4, "5", "group")], "pos int, number string, reason string")
    got = [(r.position, r.issue) for r in compose.numbering_issues(items).orderBy("position").collect()]
    assert got == [(1, "duplicate_original_number"), (2, "duplicate_original_number"), (3, "missing_original_number"), (4, "group")]
    assert [r.issue for r in compose.numbering_issues(items, "sequential", 998).orderBy("position").collect()] == ["number_range_exceeded", "group"]


def test_numbering_is_sorted_in_tasks_of_bounded_size(spark, monkeypatch):
    import re

    from paperloom.plans import compose_queries

    plan = lambda: QUERIES["CMP_3_numbering_issues"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    rows = QUERIES["CMP_3_numbering_issues"](spark, DATA).collect()
    assert plan().count("Exchange ") == 1 and plan().count("Sort ") == 2
    monkeypatch.setattr(compose_queries, "SORTED", 500, raising=False)
    tasks = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 500)
    assert re.findall(r"Exchange hashpartitioning\(sel#\d+L?, (\d+)\)", plan()) == [str(tasks)]
    assert sorted(QUERIES["CMP_3_numbering_issues"](spark, DATA).collect()) == sorted(rows)


def test_greedy_geometry(spark):
    one = spark.range(1)
    box, band, segment = "array<struct<left:double,top:double,right:double,bottom:double>>", "array<struct<top:double,bottom:double>>", "array<struct<axis:double,start:double,end:double>>"
    lit = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), kind)
    boxes = lambda *rows: lit([dict(zip(("left", "top", "right", "bottom"), r, strict=True)) for r in rows], box)
    got = lambda c: plain(one.select(c.alias("x")).first().x)
    assert got(geometry.merged_once(boxes((0, 0, 10, 10), (12, 0, 20, 10), (50, 50, 60, 60)), 3, 100, 100)) == ((0, 0, 20, 10), (50, 50, 60, 60))
    assert got(geometry.merged_once(boxes((0, 0, 10, 10), (12, 0, 20, 10)), 3, 15, 100)) == ((0, 0, 10, 10), (12, 0, 20, 10))
    bands = lambda *rows: lit([{"top": a, "bottom": b} for a, b in rows], band)
    assert got(geometry.band_score(bands((0, 10), (20, 30)), bands((1, 11), (50, 60)), 2)) == 0.5 and got(geometry.band_score(bands(), bands(), 2)) == 1
    assert got(geometry.note_places(F.array(*map(F.lit, ("b", "a", ""))), F.array(*map(F.lit, ("xa", "xb", "ya"))))) == (1, 2, None)
    parts = [{"axis": a, "start": s, "end": e} for a, s, e in ((1.0, 0, 5), (1.2, 4, 9), (8, 0, 1))]
    assert got(geometry.merged_segments(lit(parts, segment), 0.5, 1)) == ((1.1, 0, 9), (8.0, 0, 1))


def test_boxes_merge_in_passes(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 30.0, 0.0, 40.0, 10.0), (1, 3, 12.0, 0.0, 28.0, 10.0), (2, 1, 0.0, 0.0, 1.0, 1.0)]  # the third joins the first, which then reaches the second
    df = spark.createDataFrame(rows, "page int, ord int, left double, top double, right double, bottom double")
    assert sorted(tuple(r) for r in geometry.merge_page_boxes(df, ["page"], 3.0).collect()) == [(1, 0, 0, 40, 10), (2, 0, 0, 1, 1)]


def test_routes(spark):
    rows = spark.createDataFrame([("red", True), ("red", False), ("yellow", False), ("green", True)], "t string, ai boolean")
    got = {(r.t, r.ai): (r.r.route, r.r.next_best_action) for r in rows.select("*", router.route(F.col("t"), F.col("ai"), F.lit(False)).alias("r")).collect()}
    assert got == {("red", True): ("ai_patch", None), ("red", False): ("local_only", "ai_repair"), ("yellow", False): ("local_only", "local_retry"), ("green", True): ("local_only", None)}


def test_injected_defects_are_reported(spark):
    source = spark.createDataFrame([(1, w) for w in "a b c c d".split()], "g int, key string")
    for lost in "abcd":
        rows = source.collect()
        rows.remove(next(r for r in rows if r.key == lost))
        out = spark.createDataFrame(rows, source.schema)
        assert [r.key for r in audit.missing_things(source, out).collect()] == [lost]
        assert audit.overlap(source, out, ["g"]).first().matched == 4


def test_retry_and_state_helpers(spark):
    s = spark.createDataFrame([("queued",), ("running",), ("failed",)], "s string")
    assert [r.c for r in s.select(jobs.cancelled(F.col("s")).alias("c")).collect()] == ["cancelled", "cancel_requested", "failed"]
    marks = spark.createDataFrame([(1, 0.0, 100.0, 600.0), (1, 0.0, 400.0, 600.0), (2, 0.0, 100.0, 600.0), (2, 0.0, 150.0, 600.0)], "page int, top double, x double, page_width double")
    assert [r.column for r in segment.column_split(marks, ["page"]).orderBy("page", "x").collect()] == [0, 1, 0, 0]


def test_risks_do_not_follow_partitions(spark, tmp_path):
    import random

    rng, rows, want = random.Random(5), [], {}
    for page in range(1, 200):  # means of 0.55, which sums of some orders miss by a digit
        n = rng.randrange(3, 12)
        while not 0 <= (last := 55 * n - sum(shares := [rng.randrange(100) for _ in range(n - 1)])) < 100:
            pass
        keys = [page * 10000 + i * 100 + c for i, c in enumerate([*shares, last])]
        rows += [(k, page, "O", 1000.0, "1-URGENT") for k in keys]
        want[page] = sum_in_order([k % 100 / 100 for k in keys]) / n < 0.55
    rng.shuffle(rows)
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").repartition(7).write.parquet(f"{tmp_path}/orders.parquet")
    assert len(set(want.values())) == 2
    diagnosed = {r.page: r.avg_confidence < 0.55 for r in router_diagnostics(spark, tmp_path).collect()}
    assert diagnosed == want
    read = [{r.page: r.risk for r in QUERIES["AGG_6_risk"](spark, str(tmp_path)).collect()} for _ in range(2)]
    assert read[0] == read[1] and len(read[0]) == len(want)


def sum_in_order(values):
    total = 0.0
    for v in values:
        total += v
    return total


def router_diagnostics(spark, folder):
    from paperloom.plans.audit_queries import page_diagnostics

    return page_diagnostics(spark, str(folder))
