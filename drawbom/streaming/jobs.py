"""Streaming forms of the job reports.

Events arrive with an event time `ts` (timestamp). Duplicates, windows and watchdog
timers are forgotten behind the watermark. The latest state of all jobs is not: it
holds one row per job ever seen, as its result does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from drawbom.operators.jobs import TERMINAL, windowed_job_counts
from drawbom.sources.files import shared_folder

EVENT_SCHEMA = "event_id bigint, ts timestamp, owner_id bigint, job_id bigint, state string"
LATENESS = "1 hour"


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_dedupe(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def stream_latest_state(events: DataFrame) -> DataFrame:
    """Latest snapshot per job, for update or complete mode."""
    last = F.max_by(F.struct("owner_id", "state", "event_id"), F.struct("ts", "event_id"))
    return (events.groupBy("job_id").agg(last.alias("s"), F.max("ts").alias("ts"))
            .select("job_id", "ts", "s.owner_id", "s.state", "s.event_id"))


def stream_job_counts(events: DataFrame, width: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    return windowed_job_counts(events.withWatermark("ts", lateness), width)


def stream_stuck_jobs(events: DataFrame, timeout_ms: int = 900_000, lateness: str = LATENESS) -> DataFrame:
    """An error row per job that stays unfinished past the watchdog time.

    The state of a job is its last event; an event-time timer fires once the
    watermark has passed the deadline without a newer event. The end of a job is
    remembered until the watermark has passed it, so that an older event which
    arrives later does not open the job again.
    """
    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, event_id, name, ms = state.get
            state.remove()
            if name not in TERMINAL:
                yield pd.DataFrame({"job_id": [key[0]], "event_id": [event_id], "state": [name], "timeout_at_ms": [ms + timeout_ms]})
            return
        last = state.get[:4] if state.exists else None
        for batch in batches:
            row = batch.sort_values(["ts_ms", "event_id"]).iloc[-1]
            new = (int(row["owner_id"]), int(row["event_id"]), row["state"], int(row["ts_ms"]))
            if last is None or (new[3], new[1]) > (last[3], last[1]):
                last = new
        state.update(last)
        due = last[3] if last[2] in TERMINAL else last[3] + timeout_ms
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        return
        yield

    timed = events.withWatermark("ts", lateness).withColumn("ts_ms", F.unix_millis("ts"))
    return timed.groupBy("job_id").applyInPandasWithState(
        watch, "job_id long, event_id long, state string, timeout_at_ms long", "owner_id long, event_id long, state string, ts_ms long",
        "append", GroupStateTimeout.EventTimeTimeout)


def stream_overdue_events(events: DataFrame, timeout_ms: int = 900_000, lateness: str = LATENESS) -> DataFrame:
    """A row per unfinished event that nothing followed within the watchdog time, as the batch
    `stuck_jobs` gives; a job that ended late is reported too.

    Events of a job that follow each other within the watchdog time form one session; of a
    session only the last event can be overdue, and it is once the watermark has passed the
    session. The session is a microsecond longer than the watchdog time, as an event that
    follows just at its end is in time. State holds open sessions, and no Python runs.
    """
    last = F.max_by(F.struct("event_id", "state"), F.struct("ts", "event_id"))
    sessions = events.withWatermark("ts", lateness).groupBy("job_id", F.session_window("ts", f"{timeout_ms} milliseconds 1 microsecond"))
    ended = sessions.agg(last.alias("s"), F.max("ts").alias("ts"))
    return ended.filter(~F.col("s.state").isin(*TERMINAL)).select("job_id", "s.event_id", "s.state", (F.unix_millis("ts") + timeout_ms).alias("timeout_at_ms"))


def in_slices(events: DataFrame, count: int = 4) -> Iterator[DataFrame]:
    """The events in `count` parts of about equal size by `ts`, oldest first, as they would arrive."""
    ms = F.unix_millis("ts")
    cuts = events.select(ms.alias("ms")).approxQuantile("ms", [i / count for i in range(1, count)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None]):
        after = F.lit(True) if low is None else ms > low
        yield events.filter(after if high is None else after & (ms <= high))


def replay(spark: SparkSession, slices: Iterable[DataFrame], report: Callable[[DataFrame], DataFrame], mode: str,
           keys: list[str] | None = None) -> DataFrame:
    """Append each slice to a folder of events and run `report` over what is new there, with
    an available-now trigger; return what it wrote.

    Every run restarts from the one checkpoint in the shared folder. A batch is written to
    a folder of its own number, so that a batch that is run again replaces its rows. In
    update mode the newest row of each of `keys` counts.
    """
    base = shared_folder(spark)

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/report/batch={number}")

    for rows in slices:
        rows.write.mode("append").parquet(f"{base}/events")
        out = report(read_events(spark, f"{base}/events"))
        run = (out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(keep)
               .trigger(availableNow=True).start())
        run.awaitTermination()
    written = spark.read.schema(StructType([*out.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/report")
    if keys is None:
        return written.drop("batch")
    rest = [c for c in out.columns if c not in keys]
    newest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in out.columns])
