"""Job queries. Orders stand for jobs (customers own them), events for submissions, reports and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..registry import query, table

NOW = "2024-01-31 00:00:00"
_NOW = f"TIMESTAMP '{NOW}'"
_STATE = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'succeeded' ELSE 'cancelled' END"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def job_rows(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "succeeded").otherwise("cancelled")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("owner_id"), state.alias("state"), F.col("ts").alias("created"), (F.col("event_id") % 5 == 0).alias("deleted"), F.floor(F.col("value") * 1000).cast("long").alias("input_size"), F.lit(None).cast("long").alias("output_size"), "props")


_JOBS = f"SELECT event_id AS id, user_id AS owner_id, {_STATE} AS state, ts AS created, event_id % 5 = 0 AS deleted, CAST(floor(value * 1000) AS BIGINT) AS input_size, props FROM events"


@query("JOIN_1_authenticated", "SELECT o_orderkey AS session, c_custkey AS user_id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderdate > TIMESTAMP '1998-06-01'")
def authenticated(spark, d):
    sessions = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("expires"))
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return J.authenticated(sessions, users, F.lit("1998-06-01").cast("timestamp_ntz")).select("session", "user_id", "name")


@query("FLT_4_jobs_page", f"SELECT id, owner_id, state FROM ({_JOBS}) WHERE NOT deleted AND state IN ('queued', 'running') ORDER BY created DESC, id DESC LIMIT 50 OFFSET 50")
def jobs_page(spark, d):
    return J.listed(job_rows(spark, d), "active", 50, 50).select("id", "owner_id", "state")


@query("FLT_5_reports", f"SELECT id, created FROM ({_JOBS}) WHERE state = 'failed' ORDER BY created DESC, id DESC LIMIT 50")
def reports(spark, d):
    return J.listed(job_rows(spark, d).withColumn("deleted", F.lit(False)), "failed", 50).select("id", "created")


@query("FLT_6_fifo_head", f"SELECT id FROM ({_JOBS}) WHERE state = 'queued' ORDER BY created, id LIMIT 1")
def fifo(spark, d):
    return J.fifo_head(job_rows(spark, d))


@query("FLT_12_expired", f"SELECT id FROM ({_JOBS}) WHERE state NOT IN ('queued', 'running') AND created < {_NOW} - INTERVAL 20 DAYS")
def expired(spark, d):
    return J.expired(job_rows(spark, d), now(), 20).select("id")


_USAGE = f"SELECT owner_id, count(*) FILTER (state IN ('queued', 'running') AND NOT deleted) AS active, count(*) FILTER (created > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 86400 SECONDS AND state NOT IN ('failed', 'cancelled')) AS daily, CAST(coalesce(sum(CASE WHEN NOT deleted THEN input_size END), 0) AS BIGINT) AS bytes FROM ({_JOBS}) GROUP BY owner_id"


@query("AGG_1_usage", _USAGE)
def usage(spark, d):
    return J.usage(job_rows(spark, d), F.lit("2024-01-15").cast("timestamp_ntz"))


@query("AGG_2_admission", f"SELECT owner_id, CASE WHEN active >= 3 THEN 'active' WHEN daily >= 10 THEN 'daily' WHEN bytes + 1000000 > 524288000 THEN 'storage' ELSE 'admitted' END AS verdict FROM ({_USAGE})")
def admission(spark, d):
    return J.admission(usage(spark, d), F.lit(0), F.lit(1_000_000)).select("owner_id", "verdict")


@query("AGG_3_report_limit", f"SELECT owner_id, count(*) FILTER (created > {_NOW} - INTERVAL 10 DAYS) >= 20 AS refused FROM ({_JOBS}) GROUP BY owner_id")
def report_limit(spark, d):
    recent = F.col("created") > now() - F.expr("INTERVAL 10 DAYS")
    return job_rows(spark, d).groupBy("owner_id").agg((F.count_if(recent) >= J.MOST_REPORTS).alias("refused"))


@query("STM_1_submissions", f"WITH r AS (SELECT owner_id, json_extract(props, '$.k')::VARCHAR AS request_key, state AS fingerprint, id AS pos, deleted FROM ({_JOBS})), f AS (SELECT owner_id, request_key, min(pos) AS first_pos, arg_min(fingerprint, pos) AS fp, arg_min(deleted, pos) AS del FROM r GROUP BY owner_id, request_key) SELECT r.pos, f.first_pos, CASE WHEN r.pos = f.first_pos THEN 'accepted' WHEN r.fingerprint = f.fp AND NOT f.del THEN 'repeated' ELSE 'conflict' END AS outcome FROM r JOIN f USING (owner_id, request_key)")
def submissions(spark, d):
    r = job_rows(spark, d).select("owner_id", F.get_json_object("props", "$.k").alias("request_key"), F.col("state").alias("fingerprint"), F.col("id").alias("pos"), "deleted")
    return J.submissions(r).select("pos", "first_pos", "outcome")


@query("STM_5_cancelled", f"SELECT id, CASE WHEN state = 'queued' THEN 'cancelled' WHEN state = 'running' THEN 'cancel_requested' ELSE state END AS state FROM ({_JOBS})")
def cancelled(spark, d):
    return job_rows(spark, d).select("id", J.cancelled(F.col("state")).alias("state"))


@query("STM_6_fixed_window", "WITH RECURSIVE a AS (SELECT user_id AS key, event_id AS pos, epoch(CAST(ts AS TIMESTAMP)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT key, pos, i, t AS opened, 1 AS n FROM a WHERE i = 1 UNION ALL SELECT a.key, a.pos, a.i, CASE WHEN a.t >= opened + 86400 THEN a.t ELSE opened END, CASE WHEN a.t >= opened + 86400 THEN 1 ELSE n + 1 END FROM f JOIN a ON a.key = f.key AND a.i = f.i + 1) SELECT key, pos, n <= 2 AS allowed FROM f")
def fixed_window(spark, d):
    """A fold along each user's attempts; the tests hold it against a loop."""
    a = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("pos"))
    return J.fixed_window_verdicts(a, most=2, seconds=86400)


@query("STM_7_sliding_failures", "WITH a AS (SELECT user_id AS key, ts, event_id AS pos, event_type <> 'signup' AS failed FROM events), e AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, pos ROWS UNBOUNDED PRECEDING) - CASE WHEN failed THEN 0 ELSE 1 END AS era FROM a) SELECT key, pos, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER w - CASE WHEN failed THEN 1 ELSE 0 END AS BIGINT) AS recent_failures, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER w - CASE WHEN failed THEN 1 ELSE 0 END >= 5 AS refused FROM e WINDOW w AS (PARTITION BY key, era ORDER BY ts RANGE BETWEEN INTERVAL 604800 SECONDS PRECEDING AND CURRENT ROW)")
def sliding(spark, d):
    """Weeks stand for minutes, as the users' events are days apart."""
    a = table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("pos"), (F.col("event_type") != "signup").alias("failed"))
    return J.sliding_failures(a, seconds=604800).select("key", "pos", "recent_failures", "refused")


@query("STM_8_live_sessions", f"SELECT id FROM ({_JOBS}) WHERE created > {_NOW} - INTERVAL 24 HOURS")
def live(spark, d):
    return J.live_sessions(job_rows(spark, d), now()).select("id")


@query("STM_9_retention", f"SELECT id, deleted OR (state NOT IN ('queued', 'running') AND created < {_NOW} - INTERVAL 10 DAYS) AS deleted FROM ({_JOBS})")
def retention(spark, d):
    rows = job_rows(spark, d)
    old = J.expired(rows, now(), 10).select("id", F.lit(True).alias("_old"))
    return rows.join(old, "id", "left").select("id", (F.col("deleted") | F.coalesce("_old", F.lit(False))).alias("deleted"))


@query("DAT_2_recent", f"SELECT event_type, count(*) AS n FROM events WHERE ts > {_NOW} - INTERVAL 86400 SECONDS GROUP BY event_type")
def recent(spark, d):
    return table(spark, d, "events").where(F.col("ts") > now() - F.expr("INTERVAL 86400 SECONDS")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
