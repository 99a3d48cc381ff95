"""Job events: latest state, progress, watchdog and load reports (batch)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.operators.spread import neighbours, running, top_per

TERMINAL = ["done", "error", "canceled"]
STATE_MARKS = {"queued": 0.0, "rendering": 2.0, "rendered": 9.0, "parsed": 92.0, "rules": 95.0, "done": 100.0, "error": 100.0}


def latest_job_state(events: DataFrame, cancels: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
    """Last snapshot per job. A cancel mark holds unless the job is done; with
    `requests(job_id, owner_id)` a foreign job reads not_found."""
    last = F.max_by(F.struct("owner_id", "state", "event_id"), F.struct("ts_ms", "event_id"))
    out = events.groupBy("job_id").agg(last.alias("_s"), F.max("ts_ms").alias("ts_ms")).select("job_id", "ts_ms", "_s.*")
    if cancels is not None:
        marks = cancels.select("job_id").distinct().withColumn("_c", F.lit(True))
        out = out.join(marks, "job_id", "left").withColumn(
            "state", F.when(F.col("_c") & (F.col("state") != "done"), "canceled").otherwise(F.col("state"))).drop("_c")
    if requests is not None:
        asked = requests.select("job_id", F.col("owner_id").alias("_asked"))
        out = out.join(asked, "job_id").withColumn(
            "state", F.when(F.col("_asked") == F.col("owner_id"), F.col("state")).otherwise("not_found")).drop("_asked")
    return out


def list_jobs(events: DataFrame, limit: int = 50) -> DataFrame:
    """Newest jobs per owner, `limit` of them."""
    return top_per(latest_job_state(events), ["owner_id"], [F.col("ts_ms").desc(), F.col("job_id").desc()], limit)


def cycle_times(events: DataFrame) -> DataFrame:
    """Milliseconds from the first event to the first done event per job."""
    done = F.min(F.when(F.col("state") == "done", F.col("ts_ms")))
    jobs = events.groupBy("owner_id", "job_id").agg((done - F.min("ts_ms")).alias("cycle_ms"))
    return jobs.filter("cycle_ms IS NOT NULL")


def cycle_time_summary(events: DataFrame, exact: bool = True) -> DataFrame:
    """Jobs, median and 90th percentile per owner. The exact form counts each value of an
    owner and finds ranks by running counts, so that no task holds an owner's values;
    `exact=False` keeps a bounded sketch per owner in one pass."""
    cycles = cycle_times(events)
    if not exact:
        pct = lambda p: F.percentile_approx("cycle_ms", p).cast("double")
        return cycles.groupBy("owner_id").agg(F.count("*").alias("jobs"), pct(0.5).alias("p50_ms"), pct(0.9).alias("p90_ms"))
    values = cycles.groupBy("owner_id", "cycle_ms").agg(F.count("*").alias("_n"))
    ranked = running(values, ["owner_id"], [F.col("cycle_ms")], {"_upto": ("sum", F.col("_n"), True)})
    jobs = values.groupBy("owner_id").agg(F.sum("_n").alias("jobs"))

    def at(rank):
        """The value at a rank from 0."""
        return F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col("cycle_ms")))

    def between(share: float):
        place = F.lit(share) * (F.col("jobs") - 1)
        low, part = at(F.floor(place)), F.max(place - F.floor(place))
        return low * (1 - part) + at(F.ceil(place)) * part
    return ranked.join(jobs, "owner_id").groupBy("owner_id", "jobs").agg(between(0.5).alias("p50_ms"), between(0.9).alias("p90_ms"))


def job_progress(events: DataFrame) -> DataFrame:
    """Progress after each event: fixed marks, and 10 to 90 over the parsed
    crops while parsing."""
    crop = F.when(F.col("state") == "parsing", 1).otherwise(0).cast("long")
    totals = events.groupBy("job_id").agg(F.sum(crop).alias("_total"))
    counted = running(events, ["job_id"], [F.col("ts_ms"), F.col("event_id")],
                      {"_done": ("sum", crop, True)}).join(totals, "job_id")
    marks = F.create_map(*[F.lit(x) for kv in STATE_MARKS.items() for x in kv])
    progress = F.when(F.col("state") == "parsing", 10.0 + F.col("_done") / F.col("_total") * 80.0).otherwise(
        F.try_element_at(marks, F.col("state")))
    return counted.withColumn("progress", F.round(progress, 6)).drop("_done", "_total")


def stuck_jobs(events: DataFrame, as_of_ms: int, timeout_ms: int = 900_000) -> DataFrame:
    """Unfinished events that nothing followed within the watchdog time."""
    near = neighbours(events, ["job_id"], [F.col("ts_ms"), F.col("event_id")],
                      F.col("ts_ms"), nxt="_next")
    late = F.coalesce("_next", F.lit(as_of_ms)) - F.col("ts_ms") > timeout_ms
    return (near.filter(~F.col("state").isin(*TERMINAL) & late)
            .select("job_id", "event_id", "state", (F.col("ts_ms") + timeout_ms).alias("timeout_at_ms")))


def drop_canceled(events: DataFrame, cancels: DataFrame) -> DataFrame:
    """Events without the queued or running ones of canceled jobs."""
    open_ = ~F.col("state").isin(*TERMINAL)
    return events.filter(~open_).unionByName(events.filter(open_).join(cancels.select("job_id").distinct(), "job_id", "left_anti"))


def inflight_by_owner(events: DataFrame, cap: int = 1) -> DataFrame:
    """Highest number of jobs of an owner in flight at once, and whether it
    exceeds the cap. A job runs from its first event to its first terminal
    event at or after it, else to its last event."""
    end = F.coalesce(F.min(F.when(F.col("state").isin(*TERMINAL), F.col("ts_ms"))), F.max("ts_ms"))
    spans = events.groupBy("owner_id", "job_id").agg(F.min("ts_ms").alias("s"), end.alias("e"))
    steps = spans.select("owner_id", "job_id", F.explode(F.array(
        F.struct(F.col("s").alias("t"), F.lit(1).cast("long").alias("d")),
        F.struct(F.col("e").alias("t"), F.lit(-1).cast("long").alias("d")))).alias("x")).select("owner_id", "job_id", "x.t", "x.d")
    load = running(steps, ["owner_id"], [F.col("t"), F.col("d").desc(), F.col("job_id")],
                   {"load": ("sum", F.col("d"), True)})
    return load.groupBy("owner_id").agg(F.max("load").alias("max_inflight"), (F.max("load") > cap).alias("over_cap"))


def windowed_job_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events per tumbling window and state; works on batches and streams."""
    w = F.window("ts", width)
    return (events.groupBy(w.alias("w"), "state").agg(F.count("*").alias("events"))
            .select(F.col("w.start").alias("window_start"), "state", "events"))


def dedupe_events(events: DataFrame) -> DataFrame:
    """Re-delivered status writes count once."""
    return events.dropDuplicates(["event_id"])
