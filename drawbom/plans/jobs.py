"""Queries over job events (batch forms)."""

from pyspark.sql import functions as F

from drawbom.operators import jobs as jb
from drawbom.plans.registry import query
from drawbom.streaming import jobs as st

AS_OF_MS = 1_706_745_600_000          # 2024-02-01, just after the sample log
HOUR = 3_600_000
LAST = """last AS (SELECT job_id, ts_ms, owner_id, state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms DESC, event_id DESC) AS n FROM job_events) x WHERE n = 1)"""


def asked_of(job_events):
    return job_events.select("job_id", (F.col("owner_id") + F.when(F.col("job_id") % 10 == 0, 1).otherwise(0)).alias("owner_id")).distinct()


LATEST = "WITH " + LAST + """ SELECT job_id, ts_ms, owner_id, event_id, CASE WHEN job_id % 10 = 0 THEN 'not_found' WHEN state <> 'done' AND job_id IN (SELECT job_id FROM cancels) THEN 'canceled' ELSE state END AS state FROM last"""


@query("j1_latest_job_state", "job_events cancels", LATEST)
def j1(job_events, cancels):
    return jb.latest_job_state(job_events, cancels, asked_of(job_events))


@query("j2_list_jobs", "job_events", "WITH " + LAST + """ SELECT job_id, ts_ms, owner_id, state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY ts_ms DESC, job_id DESC) AS n FROM last) x WHERE n <= 5""")
def j2(job_events):
    return jb.list_jobs(job_events, 5)


@query("j3_cycle_times", "job_events", """WITH c AS (SELECT owner_id, job_id, min(ts_ms) FILTER (state = 'done') - min(ts_ms) AS cycle_ms FROM job_events GROUP BY owner_id, job_id)
  SELECT owner_id, count(*) AS jobs, CAST(quantile_cont(cycle_ms, 0.5) AS DOUBLE) AS p50_ms, CAST(round(quantile_cont(cycle_ms, 0.9), 3) AS DOUBLE) AS p90_ms FROM c WHERE cycle_ms IS NOT NULL GROUP BY owner_id""")
def j3(job_events):
    return jb.cycle_time_summary(job_events).withColumn("p90_ms", F.round("p90_ms", 3))


@query("j4_job_progress", "job_events", """SELECT event_id, job_id, state, CASE state WHEN 'queued' THEN 0 WHEN 'rendering' THEN 2 WHEN 'done' THEN 100 WHEN 'error' THEN 100 ELSE
    round(10.0 + CAST(sum(CASE WHEN state = 'parsing' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / sum(CASE WHEN state = 'parsing' THEN 1 ELSE 0 END) OVER (PARTITION BY job_id) * 80.0, 6) END AS progress FROM job_events""")
def j4(job_events):
    return jb.job_progress(job_events).select("event_id", "job_id", "state", "progress")


STUCK = f"""SELECT job_id, event_id, state, ts_ms + 900000 AS timeout_at_ms FROM (SELECT *, lead(ts_ms) OVER (PARTITION BY job_id ORDER BY ts_ms, event_id) AS nx FROM job_events) x
  WHERE state NOT IN ('done', 'error', 'canceled') AND coalesce(nx, {AS_OF_MS}) - ts_ms > 900000"""


@query("j5_stuck_jobs", "job_events", STUCK)
def j5(job_events):
    return jb.stuck_jobs(job_events, AS_OF_MS)


@query("j6_drop_canceled", "job_events cancels", """SELECT event_id, job_id, state FROM job_events WHERE state IN ('done', 'error', 'canceled') OR job_id NOT IN (SELECT job_id FROM cancels)""")
def j6(job_events, cancels):
    return jb.drop_canceled(job_events, cancels).select("event_id", "job_id", "state")


@query("j7_inflight_by_owner", "job_events", """WITH s AS (SELECT owner_id, job_id, min(ts_ms) AS s, coalesce(min(ts_ms) FILTER (state IN ('done', 'error', 'canceled')), max(ts_ms)) AS e FROM job_events GROUP BY owner_id, job_id),
  x AS (SELECT owner_id, job_id, s AS t, 1 AS d FROM s UNION ALL SELECT owner_id, job_id, e, -1 FROM s),
  l AS (SELECT owner_id, sum(d) OVER (PARTITION BY owner_id ORDER BY t, d DESC, job_id ROWS UNBOUNDED PRECEDING) AS load FROM x)
  SELECT owner_id, CAST(max(load) AS BIGINT) AS max_inflight, max(load) > 1 AS over_cap FROM l GROUP BY owner_id""")
def j7(job_events):
    return jb.inflight_by_owner(job_events)


COUNTS = f"""SELECT CAST(ts_ms // {HOUR} AS BIGINT) AS hour_no, state, count(*) AS events FROM job_events GROUP BY ALL"""


@query("j8_windowed_job_counts", "job_events", COUNTS)
def j8(job_events):
    out = jb.windowed_job_counts(job_events.withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.floor(F.unix_millis("window_start") / HOUR).cast("long").alias("hour_no"), "state", "events")


ONCE = "SELECT event_id, job_id, state FROM job_events"


@query("j9_dedupe_events", "job_events", ONCE)
def j9(job_events):
    return jb.dedupe_events(job_events.unionByName(job_events)).select("event_id", "job_id", "state")


def arriving(job_events):
    """The log as files of it hold it."""
    return job_events.select("event_id", F.timestamp_millis("ts_ms").alias("ts"), "owner_id", "job_id", "state")


@query("j1_latest_job_state_stream", "job_events cancels", LATEST)
def j1_stream(job_events, cancels):
    latest = st.replay(job_events.sparkSession, st.in_slices(arriving(job_events)), st.stream_latest_state, "update", ["job_id"])
    return jb.latest_job_state(latest.withColumn("ts_ms", F.unix_millis("ts")), cancels, asked_of(job_events))


@query("j5_stuck_jobs_stream", "job_events", STUCK)
def j5_stream(job_events):
    """A last event an hour (the allowed lateness) after the report's time lets the watermark reach it."""
    spark = job_events.sparkSession
    tick = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_millis(F.lit(AS_OF_MS + HOUR)).alias("ts"),
                                 F.lit(-1).cast("long").alias("owner_id"), F.lit(-1).cast("long").alias("job_id"), F.lit("done").alias("state"))
    return st.replay(spark, [*st.in_slices(arriving(job_events)), tick], st.stream_overdue_events, "append")


@query("j8_windowed_job_counts_stream", "job_events", COUNTS)
def j8_stream(job_events):
    out = st.replay(job_events.sparkSession, st.in_slices(arriving(job_events)), st.stream_job_counts, "update", ["window_start", "state"])
    return out.select(F.floor(F.unix_millis("window_start") / HOUR).cast("long").alias("hour_no"), "state", "events")


@query("j9_dedupe_events_stream", "job_events", ONCE)
def j9_stream(job_events):
    """Every event is delivered twice, in one slice."""
    events = arriving(job_events)
    return st.replay(job_events.sparkSession, st.in_slices(events.unionByName(events)), st.stream_dedupe, "append").select("event_id", "job_id", "state")
