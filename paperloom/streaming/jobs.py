"""Jobs as streams: submissions without repeats, rate limits and the queue's state machine.

Event time is the events' own time; late events are dropped after the watermark (a choice of this engine: the
state machines that these follow knew only the server's clock).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "1 hour"
LEASE, TRIES, KEPT = 30.0, 2, 30 * 86400.0  # KEPT: seconds for which a queue remembers a finished job
FINISHED = frozenset({"succeeded", "failed", "cancelled"})


def first_submissions(requests: DataFrame) -> DataFrame:
    """The first request (ts) of each owner and key; repeats within the watermark fall away."""
    return requests.withWatermark("ts", WATERMARK).dropDuplicatesWithinWatermark(["owner_id", "request_key"])


def quota_counts(jobs: DataFrame, width: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Jobs of each owner in sliding windows, without those that failed or were cancelled."""
    counted = jobs.where(~F.col("state").isin("failed", "cancelled")).withWatermark("ts", WATERMARK)
    return counted.groupBy(F.window("ts", width, slide), "owner_id").agg(F.count(F.lit(1)).alias("n"))


def allow_fixed(opened: float | None, n: int, t: float, most: int, seconds: float) -> tuple[float, int, bool]:
    """One attempt under a limit whose window the first attempt opens."""
    if opened is None or t >= opened + seconds:
        opened, n = t, 0
    return opened, n + 1, n + 1 <= most


def fixed_window(attempts: DataFrame, most: int = 12, seconds: int = 900) -> DataFrame:
    """key, pos and allowed of attempts (key, pos, ts): the state of a key is its window, which expires with the watermark."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "pos"])
        out = []
        for t, pos in zip(rows["ts"], rows["pos"], strict=True):
            opened, n, ok = allow_fixed(opened, n, t.timestamp(), most, seconds)
            out.append((key[0], pos, ok))
        state.update((opened, n))
        state.setTimeoutTimestamp(max(int((opened + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "pos", "allowed"])

    keyed = attempts.withWatermark("ts", WATERMARK).groupBy("key")
    return keyed.applyInPandasWithState(step, "key string, pos long, allowed boolean", "opened double, n long", "append", GroupStateTimeout.EventTimeTimeout)


def advance(jobs: dict[str, dict[str, Any]], e: dict[str, Any]) -> str:
    """One event (op, id, attempt, t, ok) on the jobs of a queue; the outcome tells what happened.

    submit queues a job. claim first looks after leases that ran out (again while there are tries left, else
    failed), then gives the oldest queued job to the attempt, if none runs. heartbeat and finish count only for the
    attempt that holds the job; a cancel request wins over success.
    """
    t, job = e["t"], jobs.get(e["id"] or "")
    if e["op"] == "submit":
        if job:
            return "repeated"
        jobs[e["id"]] = {"state": "queued", "created": t, "attempt": None, "lease": None, "tries": 0}
        return "queued"
    if e["op"] == "claim":
        for j in jobs.values():
            if j["state"] in ("running", "validating", "cancel_requested") and j["lease"] is not None and j["lease"] < t:
                j["state"] = "cancelled" if j["state"] == "cancel_requested" else "queued" if j["tries"] < TRIES else "failed"
                j["attempt"] = j["lease"] = None
        if any(j["state"] in ("running", "validating", "cancel_requested") for j in jobs.values()):
            return "busy"
        waiting = sorted((j["created"], i) for i, j in jobs.items() if j["state"] == "queued")
        if not waiting:
            return "idle"
        jobs[waiting[0][1]] |= {"state": "running", "attempt": e["attempt"], "lease": t + LEASE, "tries": jobs[waiting[0][1]]["tries"] + 1}
        return f"claimed:{waiting[0][1]}"
    if job is None:
        return "unknown"
    if e["op"] == "cancel":
        job["state"] = {"queued": "cancelled", "running": "cancel_requested", "validating": "cancel_requested"}.get(job["state"], job["state"])
        return job["state"]
    if job["attempt"] != e["attempt"] or job["state"] in FINISHED or job["state"] == "queued":
        return "stale"
    if e["op"] == "heartbeat":
        job["lease"] = t + LEASE
        job["state"] = "validating" if job["state"] == "running" else job["state"]
        return job["state"]
    job["state"] = "cancelled" if job["state"] == "cancel_requested" else "succeeded" if e["ok"] else "failed"
    job["attempt"] = job["lease"] = None
    return job["state"]


def queue(events: DataFrame) -> DataFrame:
    """queue, pos and outcome of queue events (queue, pos, ts, op, id, attempt, ok). A queue is one state: it runs one job at a time.

    Finished jobs are remembered for ``KEPT`` seconds, so a repeated submit starts none of them again and a cancel tells its state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        jobs = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["ts", "pos"])
        out = []
        for r in rows.to_dict("records"):
            now = r["ts"].timestamp()
            told = advance(jobs, {"op": r["op"], "id": r["id"], "attempt": r["attempt"], "ok": bool(r["ok"]), "t": now})
            if (job := jobs.get(r["id"] or "")) and job["state"] in FINISHED:
                job.setdefault("ended", now)
            out.append((key[0], r["pos"], told))
        latest = rows["ts"].max().timestamp()
        state.update((json.dumps({i: j for i, j in jobs.items() if j["state"] not in FINISHED or j.setdefault("ended", latest) >= latest - KEPT}),))
        yield pd.DataFrame(out, columns=["queue", "pos", "outcome"])

    return events.groupBy("queue").applyInPandasWithState(step, "queue string, pos long, outcome string", "jobs string", "append", GroupStateTimeout.NoTimeout)


def retained(jobs: DataFrame, days: int = 30) -> DataFrame:
    """Daily windows of jobs by state, which close when the retention has passed."""
    return jobs.withWatermark("ts", f"{days} days").groupBy(F.window("ts", "1 day"), "state").agg(F.count(F.lit(1)).alias("n"))
