"""Sources, sinks and streaming forms."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawbom.operators import jobs as jb, keyvalue as kv
from drawbom.sources import files as fl
from drawbom.streaming import jobs as st

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)


def test_tokens_from_detections(spark, tmp_path):
    det = {"pdf_id": 1, "page_id": 2, "pos": 0, "text": "LP-1", "conf": None, "box": [[-4, 3], [50, 2], [49, 20], [-2, 21]],
           "band_width": 40, "band_height": 100, "band_offset": 7}
    (tmp_path / "d.json").write_text(json.dumps(det) + "\n" + json.dumps({**det, "text": ""}))
    rows = fl.read_tokens(spark, str(tmp_path / "d.json")).collect()
    assert [tuple(r) for r in rows] == [(1, 2, 0, "LP-1", 0.0, 0, 9, 39, 28)]


def test_settings_with_comments(spark, tmp_path):
    (tmp_path / "c.jsonc").write_text('{\n // note\n "a": [1, 2,], /* x\n y */ "b": "http://u", "c": {"d": 5},\n}')
    got = {r.key: r.value for r in fl.read_jsonc_config(spark, str(tmp_path / "c.jsonc")).collect()}
    assert got == {"a": "[1,2]", "b": "http://u", "c": '{"d":5}'}


def test_patterns_of_settings(spark, tmp_path):
    (tmp_path / "c.jsonc").write_text('{"stop": ["A", "B"], "n": 5, "s": "x", /* c */ "labels": {"volts": ["\\\\bV\\\\b", "VOLT"], "amps": [], "none": null}}')
    got = sorted((r.field, r.ord, r.pattern) for r in fl.lexicon_patterns(fl.read_jsonc_config(spark, str(tmp_path / "c.jsonc"))).collect())
    assert got == [("stop", 1, "A"), ("stop", 2, "B"), ("volts", 1, r"\bV\b"), ("volts", 2, "VOLT")]


def test_a_changed_settings_file_changes_the_result(spark, tmp_path):
    tokens = spark.createDataFrame([(1, i, t, 0.9, 0, 0, 5, 5) for i, t in enumerate(["VOLTS", "TENSION", "http://x", None])],
                                   "page_id long, pos int, text string, conf double, x1 long, y1 long, x2 long, y2 long")
    path = str(tmp_path / "lexicon")

    def roles(labels):
        fl.write_settings(spark, {"labels": labels}, path)
        return sorted((r.text, r.role) for r in kv.label_candidates(tokens, kv.labels_of(fl.read_lexicon(spark, path))).collect())
    assert roles({"VOLTAGE": [r"\bVOLTS?\b"]}) == [("VOLTS", "VOLTAGE")]
    assert roles({"VOLTAGE": [r"\bVOLTS?\b", r"\bTENSION\b"], "LINK": ["HTTP://"]}) == [("TENSION", "VOLTAGE"), ("VOLTS", "VOLTAGE"), ("http://x", "LINK")]
    with pytest.raises(ValueError):
        fl.read_lexicon(spark, path, limit=2)


def test_crops_status_and_csv(spark, tmp_path):
    for job in ("jobA", "jobB"):
        (tmp_path / job / "pdf_images").mkdir(parents=True)
        (tmp_path / job / "pdf_images" / "p1.png").write_bytes(b"x")
        (tmp_path / job / "pdf_images" / "p1.txt").write_bytes(b"x")
    assert sorted((r.job, r.name) for r in fl.list_crops(spark, str(tmp_path)).collect()) == [("jobA", "p1.png"), ("jobB", "p1.png")]
    (tmp_path / "s" / "j1").mkdir(parents=True)
    (tmp_path / "s" / "j2").mkdir(parents=True)
    (tmp_path / "s" / "j1" / "status.json").write_text('{"job_id": 1,\n "owner_id": 5, "state": "done"}')
    (tmp_path / "s" / "j2" / "status.json").write_text('{"job_id": 2, broken')
    assert [(r.job_id, r.state) for r in fl.read_job_status(spark, str(tmp_path / "s")).collect()] == [(1, "done")]
    bom = spark.createDataFrame([("A\"1", "LP, 1", "Breaker", 3, True), ("B", "LP", "Note", 0, True), ("C", "LP", "SPD", 1, False)],
                                "product string, designation string, item_type string, qty long, include boolean")
    fl.write_bom_csv(bom, str(tmp_path / "bom"))
    text = "".join(f.read_text() for f in (tmp_path / "bom").glob("*.csv"))
    assert "Product,Designation,Quantity" in text and '"A""1","LP, 1",3' in text
    assert [tuple(r) for r in fl.read_bom_csv(spark, str(tmp_path / "bom")).collect()] == [('A"1', "LP, 1", 3)]


def event(i, minutes, job, state, owner=1):
    return (i, T0 + dt.timedelta(minutes=minutes), owner, job, state)


def write(spark, folder, n, rows):
    spark.createDataFrame(rows, st.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    return q


def test_streams_equal_batches(spark, tmp_path):
    rows = [event(1, 0, 1, "queued"), event(2, 5, 1, "parsing"), event(3, 3, 2, "queued"), event(4, 9, 1, "done"), event(2, 5, 1, "parsing")]
    write(spark, tmp_path / "e", 0, rows[:3])
    write(spark, tmp_path / "e", 1, rows[3:])
    events = lambda: st.read_events(spark, str(tmp_path / "e"), 1)
    q = run(st.stream_dedupe(events()), "deduped", "append")
    assert sorted(r.event_id for r in spark.table("deduped").collect()) == [1, 2, 3, 4]
    q.stop()
    q = run(st.stream_latest_state(events()), "latest", "complete")
    batch = jb.latest_job_state(spark.createDataFrame(rows, st.EVENT_SCHEMA).withColumn("ts_ms", F.unix_millis("ts")))
    assert {(r.job_id, r.state) for r in spark.table("latest").collect()} == {(r.job_id, r.state) for r in batch.collect()} == {(1, "done"), (2, "queued")}
    q.stop()


def test_late_rows_are_dropped_from_closed_windows(spark, tmp_path):
    write(spark, tmp_path / "e", 0, [event(1, 0, 1, "queued"), event(2, 10, 2, "queued")])
    q = run(st.stream_job_counts(st.read_events(spark, str(tmp_path / "e"))), "counts", "append")
    write(spark, tmp_path / "e", 1, [event(3, 300, 3, "queued")])
    q.processAllAvailable()
    write(spark, tmp_path / "e", 2, [event(4, 20, 4, "queued"), event(5, 600, 5, "queued")])
    q.processAllAvailable()
    q.stop()
    assert sorted((r.window_start, r.events) for r in spark.table("counts").collect()) == [(T0, 2), (T0 + dt.timedelta(hours=5), 1)]


def test_watchdog_fires_for_unfinished_jobs_only(spark, tmp_path):
    write(spark, tmp_path / "e", 0, [event(1, 0, 1, "queued"), event(2, 0, 2, "parsing"), event(3, 2, 2, "done")])
    q = run(st.stream_stuck_jobs(st.read_events(spark, str(tmp_path / "e"))), "stuck", "append")
    for i, minutes in enumerate((120, 240)):
        write(spark, tmp_path / "e", i, [event(10 + i, minutes, 90 + i, "done")])
        q.processAllAvailable()
    q.stop()
    assert [(r.job_id, r.event_id) for r in spark.table("stuck").collect()] == [(1, 1)]


def test_replayed_slices_equal_batches_however_events_arrive(spark):
    """Restarts between slices, events out of order within the lateness, one job with a third of all."""
    rnd = random.Random(4)
    states = ["queued", "parsing", "rendered", "done", "error"]
    rows = [event(i, rnd.randrange(3000) / 3, rnd.randrange(40) if i % 3 else 1, rnd.choice(states)) for i in range(900)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rnd.randrange(25)))
    parts = [spark.createDataFrame(rows[a:a + 300], st.EVENT_SCHEMA) for a in (0, 300, 600)]
    whole = spark.createDataFrame(rows, st.EVENT_SCHEMA).withColumn("ts_ms", F.unix_millis("ts"))
    end = T0 + dt.timedelta(days=2)
    tick = spark.createDataFrame([(-1, end + dt.timedelta(hours=1), 0, -1, "done")], st.EVENT_SCHEMA)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    as_of = tick.select(F.unix_millis("ts")).first()[0] - 3_600_000
    assert key(st.replay(spark, [*parts, tick], st.stream_overdue_events, "append")) == key(jb.stuck_jobs(whole, as_of)) != []
    latest = st.replay(spark, parts, st.stream_latest_state, "update", ["job_id"])
    assert key(latest.select("job_id", "state", "event_id")) == key(jb.latest_job_state(whole).select("job_id", "state", "event_id"))
    counts = st.replay(spark, parts, st.stream_job_counts, "update", ["window_start", "state"])
    assert key(counts) == key(jb.windowed_job_counts(whole))
    twice = [a.unionByName(b) for a, b in zip(parts, [parts[0], parts[0].filter("false"), parts[2]])]
    assert key(st.replay(spark, twice, st.stream_dedupe, "append")) == key(whole.drop("ts_ms"))


def test_replay_of_an_empty_log(spark):
    none = spark.createDataFrame([], st.EVENT_SCHEMA)
    assert st.replay(spark, st.in_slices(none), st.stream_overdue_events, "append").count() == 0
    assert st.replay(spark, st.in_slices(none), st.stream_job_counts, "update", ["window_start", "state"]).count() == 0


def test_exact_percentiles_by_running_counts(spark):
    rnd = random.Random(5)
    done = {o: [rnd.choice([0, 5, rnd.randrange(10_000)]) for _ in range(n)] for o, n in {1: 1, 2: 2, 3: 7, 4: 1500}.items()}
    rows, job = [], 0
    for owner, cycles in done.items():
        for ms in cycles:
            job += 1
            rows += [(2 * job, 1000, owner, job, "queued"), (2 * job + 1, 1000 + ms, owner, job, "done")]
    rows.append((0, 5, 9, 0, "queued"))
    events = spark.createDataFrame(rows, "event_id long, ts_ms long, owner_id long, job_id long, state string")
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.owner_id: (r.jobs, r.p50_ms, r.p90_ms) for r in jb.cycle_time_summary(events).collect()}
        assert got.keys() == done.keys()
        for owner, cycles in done.items():
            want = [len(cycles), np.percentile(cycles, 50), np.percentile(cycles, 90)]
            assert np.allclose(got[owner], want)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    plan = jb.cycle_time_summary(events)._jdf.queryExecution().toString().lower()
    assert "percentile" not in plan
