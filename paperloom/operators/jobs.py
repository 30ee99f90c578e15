"""Jobs, quotas, sessions and rate limits as batch plans; streams have them in ``streaming.jobs``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACTIVE = ("queued", "running", "validating", "cancel_requested")
MOST_ACTIVE, MOST_QUEUED, MOST_DAILY, MOST_BYTES, MOST_REPORTS = 3, 20, 10, 500 * 1024 * 1024, 20
DAY, RETENTION_DAYS = 86400, 30


def authenticated(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that haven't expired, with their users."""
    return sessions.where(F.col("expires") > now).join(users, "user_id")


def listed(jobs: DataFrame, state: str = "all", limit: int = 50, offset: int = 0) -> DataFrame:
    """An owner's jobs, newest first; ``active`` stands for all unfinished states."""
    rows = jobs.where(~F.coalesce(F.col("deleted"), F.lit(False)))
    if state == "active":
        rows = rows.where(F.col("state").isin(*ACTIVE))
    elif state != "all":
        rows = rows.where(F.col("state") == state)
    return rows.orderBy(F.desc("created"), F.desc("id")).offset(offset).limit(limit)


def fifo_head(jobs: DataFrame) -> DataFrame:
    """The queued job that came first."""
    return jobs.where("state = 'queued'").agg(F.min_by("id", F.struct("created", "id")).alias("id"))


def expired(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Finished jobs older than the retention; unfinished ones survive."""
    return jobs.where(~F.col("state").isin(*ACTIVE) & (F.col("created") < now - F.expr(f"INTERVAL {days} DAYS")))


def usage(jobs: DataFrame, now: Column) -> DataFrame:
    """Per owner: active jobs, jobs of the last day that neither failed nor were cancelled (deleted ones too), bytes of what isn't deleted."""
    recent = (F.col("created") > now - F.expr(f"INTERVAL {DAY} SECONDS")) & ~F.col("state").isin("failed", "cancelled")
    kept = ~F.coalesce(F.col("deleted"), F.lit(False))
    return jobs.groupBy("owner_id").agg(
        F.count_if(F.col("state").isin(*ACTIVE) & kept).alias("active"),
        F.count_if(recent).alias("daily"),
        F.coalesce(F.sum(F.when(kept, F.coalesce("input_size", F.lit(0)) + F.coalesce("output_size", F.lit(0)))), F.lit(0)).cast("long").alias("bytes"),
    )


def admission(counts: DataFrame, queued: Column, size: Column) -> DataFrame:
    """Why a new job of this size is refused, or ``admitted``."""
    verdict = F.when(F.col("active") >= MOST_ACTIVE, "active").when(queued >= MOST_QUEUED, "queue").when(F.col("daily") >= MOST_DAILY, "daily").when(F.col("bytes") + size > MOST_BYTES, "storage").otherwise("admitted")
    return counts.withColumn("verdict", verdict)


def submissions(requests: DataFrame) -> DataFrame:
    """Idempotent submission of (owner_id, request_key, fingerprint, pos, deleted): the first of a key is accepted, the same content repeats it, other content or a deleted first one conflicts."""
    first = F.min_by(F.struct("pos", "fingerprint", F.coalesce("deleted", F.lit(False)).alias("deleted")), F.col("pos"))
    key = ["owner_id", "request_key"]
    heads = requests.groupBy(*key).agg(first.alias("_first"))
    same = (F.col("fingerprint") == F.col("_first.fingerprint")) & ~F.col("_first.deleted")
    outcome = F.when(F.col("pos") == F.col("_first.pos"), "accepted").when(same, "repeated").otherwise("conflict")
    return requests.join(heads, key).select(*requests.columns, F.col("_first.pos").alias("first_pos"), outcome.alias("outcome"))


def cancelled(state: Column) -> Column:
    """A state after a cancel request; finished jobs stay as they are."""
    return F.when(state == "queued", "cancelled").when(state.isin("running", "validating"), "cancel_requested").otherwise(state)


def fixed_window_verdicts(attempts: DataFrame, most: int = 12, seconds: int = 900) -> DataFrame:
    """Attempts (key, ts, pos) under a limit whose window the first attempt opens and later ones don't extend: an ordered fold per key."""
    start = F.struct(F.lit(None).cast("double").alias("opened"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<pos:bigint,allowed:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["opened"].isNull() | (x["t"] >= acc["opened"] + seconds)
        n = F.when(fresh, F.lit(1).cast("long")).otherwise(acc["n"] + 1)
        told = F.struct(x["pos"].alias("pos"), (n <= most).alias("allowed"))
        return F.struct(F.when(fresh, x["t"]).otherwise(acc["opened"]).alias("opened"), n.alias("n"), F.concat(acc["out"], F.array(told)).alias("out"))

    rows = attempts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("ts").cast("timestamp").cast("double").alias("t"), F.col("pos").cast("long").alias("pos")))).alias("s"))
    return rows.select("key", F.explode(F.aggregate("s", start, step)["out"]).alias("o")).select("key", "o.pos", "o.allowed")


def sliding_failures(attempts: DataFrame, seconds: int = 60, most: int = 5) -> DataFrame:
    """Failures of the last seconds since the last success, at each attempt (key, ts, failed), and whether it is refused."""
    order = W.partitionBy("key").orderBy("ts", "pos")
    era = F.sum((~F.col("failed")).cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - (~F.col("failed")).cast("long")
    marked = attempts.withColumn("_era", era).withColumn("_s", F.col("ts").cast("timestamp").cast("double"))
    recent = W.partitionBy("key", "_era").orderBy("_s").rangeBetween(-seconds, 0)
    failed = F.sum(F.col("failed").cast("long")).over(recent) - F.col("failed").cast("long")
    return marked.withColumn("recent_failures", failed).withColumn("refused", failed >= most).drop("_era", "_s")


def live_sessions(sessions: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return sessions.where(F.col("created") > now - F.expr(f"INTERVAL {hours} HOURS"))
