"""Streams over small files, and the queue's state machine."""

from __future__ import annotations

from datetime import datetime, timedelta

from paperloom.streaming import jobs as S

T0 = datetime(2024, 1, 1)


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}").collect()


def stream(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).parquet(str(tmp_path / "in"))


def test_first_submissions(spark, tmp_path):
    rows = [("a", "k", T0, 1), ("a", "k", T0 + timedelta(seconds=5), 2), ("b", "k", T0, 3)]
    got = run(spark, S.first_submissions(stream(spark, tmp_path, rows, "owner_id string, request_key string, ts timestamp, pos int")), "subs")
    assert sorted((r.owner_id, r.request_key) for r in got) == [("a", "k"), ("b", "k")]


def test_fixed_window(spark, tmp_path):
    rows = [("u", i, T0 + timedelta(seconds=60 * i)) for i in range(20)] + [("v", 99, T0)]
    got = {r.pos: r.allowed for r in run(spark, S.fixed_window(stream(spark, tmp_path, rows, "key string, pos long, ts timestamp")), "limits")}
    assert [got[i] for i in range(20)] == [i < 12 or i >= 15 for i in range(20)] and got[99]


def test_queue_stream(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("q", 1, at(0), "submit", "j1", None, None), ("q", 2, at(1), "claim", None, "w1", None), ("q", 3, at(2), "finish", "j1", "w1", True), ("q", 4, at(3), "claim", None, "w1", None)]
    later = [("q", 5, at(9), "submit", "j1", None, None), ("q", 6, at(10), "cancel", "j1", None, None), ("q", 7, at(31 * 86400), "submit", "j2", None, None)]
    got = {r.pos: r.outcome for r in run(spark, S.queue(stream(spark, tmp_path, rows, "queue string, pos long, ts timestamp, op string, id string, attempt string, ok boolean")), "queue_out")}
    assert got == {1: "queued", 2: "claimed:j1", 3: "succeeded", 4: "idle"}
    (tmp_path / "later").mkdir()
    got = {r.pos: r.outcome for r in run(spark, S.queue(stream(spark, tmp_path / "later", rows + later, "queue string, pos long, ts timestamp, op string, id string, attempt string, ok boolean")), "queue_later")}
    assert {k: got[k] for k in (5, 6, 7)} == {5: "repeated", 6: "succeeded", 7: "queued"}


def test_leases_and_fences():
    jobs = {}
    do = lambda op, t, id=None, attempt=None, ok=True: S.advance(jobs, {"op": op, "t": t, "id": id, "attempt": attempt, "ok": ok})  # noqa: E731, A002
    assert [do("submit", 0, "a"), do("submit", 1, "b"), do("submit", 2, "a")] == ["queued", "queued", "repeated"]
    assert do("claim", 3, attempt="w1") == "claimed:a" and do("claim", 4, attempt="w2") == "busy"
    assert do("claim", 40, attempt="w2") == "claimed:a"  # the lease ran out
    assert do("finish", 41, "a", "w1") == "stale" and do("heartbeat", 60, "a", "w2") == "validating"
    assert do("cancel", 61, "a") == "cancel_requested" and do("finish", 62, "a", "w2") == "cancelled"
    assert do("claim", 70, attempt="w1") == "claimed:b" and do("claim", 110, attempt="w1") == "claimed:b"
    assert do("claim", 150, attempt="w1") == "idle" and jobs["b"]["state"] == "failed"  # two tries are all
    assert do("cancel", 151, "b") == "failed" and do("finish", 1, "zz", "w") == "unknown"
