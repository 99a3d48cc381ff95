"""The parallel prefix scan and the nearest-label search: equal for any partitioning, one
exchange, hot keys in many tasks."""

import random

import pytest
from pyspark.sql import Window, functions as F

from drawbom.operators import jobs, keyvalue as kv, spread as sp

ROWS = "k long, o long, v long, d double, t string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 2, 3, None, 4, 5]), i, rng.choice([None, 1, 5, 7, 9]), rng.random(), rng.choice("abc")) for i in range(1500)]
    return spark.createDataFrame(data, ROWS)


def at(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.fixture(autouse=True)
def restored(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scans_equal_windows(spark, rows, parts):
    w = Window.partitionBy("k").orderBy("o")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    ahead, after = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(1, Window.unboundedFollowing)
    zero = lambda c: F.coalesce(c, F.lit(0))
    want = rows.select("*", zero(F.sum("v").over(so_far)), zero(F.sum("v").over(before)), F.max("v").over(before), F.min("d").over(so_far), F.last("v", True).over(before),
                       F.min("v").over(ahead), F.min("v").over(after), F.lag("t").over(w), F.lead("v").over(w), F.row_number().over(w).cast("long"))
    at(spark, parts)
    got = sp.scan(sp.ordered(rows, ["k"], [F.col("o")]), ["k"], {
        "a": ("sum", F.col("v"), True), "b": ("sum", F.col("v"), False), "c": ("max", F.col("v"), False), "e": ("min", F.col("d"), True), "f": ("last", F.col("v"), False),
        "g": ("min_ahead", F.col("v"), True), "h": ("min_ahead", F.col("v"), False)})
    got = sp.beside(got, ["k"], F.col("t"), prev="p")
    got = sp.scan(sp.beside(got, ["k"], F.col("v"), nxt="n"), ["k"], {"r": ("sum", F.lit(1).cast("long"), True)}).drop("_at")
    assert listed(got) == listed(want)


def test_scan_of_nothing(spark, rows):
    at(spark, 3)
    assert sp.numbered(rows.limit(0), ["k"], [F.col("o")], "n").count() == 0
    assert listed(sp.numbered(rows.select("o"), [], [F.col("o")], "n")) == sorted([(i, i + 1) for i in range(1500)], key=repr)


def test_one_scan_and_one_exchange(spark, rows, tmp_path):
    path = str(tmp_path / "rows")
    rows.write.parquet(path)
    at(spark, 5)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    cut = sp.ordered(spark.read.parquet(path), ["k"], [F.col("o")])
    files = cut.inputFiles()
    assert len(files) == 5
    two = sp.scan(sp.beside(cut, ["k"], F.col("v"), prev="p"), ["k"], {"s": ("sum", F.col("p"), True)})
    assert two.count() == 1500
    assert not any(word in plan(two) for word in ("RepartitionByExpression", "Window", "Join")) and two.inputFiles() == files and path not in plan(two)


def test_a_third_of_all_events_in_one_owner_minute(spark):
    """The stretches of a hot owner-minute are equal shares, and its load is right."""
    rows = [(1 if i % 3 == 0 else 2 + i % 50, i, 1000 + i % 60 if i % 3 == 0 else i * 977 % 10**7, i) for i in range(6000)]
    events = spark.createDataFrame(rows, "owner_id long, job_id long, ts_ms long, event_id long").withColumn("state", F.lit("queued"))
    done = events.withColumns({"ts_ms": F.col("ts_ms") + 5, "event_id": F.col("event_id") + 10**6, "state": F.lit("done")})
    at(spark, 12)
    got = {r["owner_id"]: r["max_inflight"] for r in jobs.inflight_by_owner(events.unionByName(done)).collect()}
    marks = sorted([(t, -1, o) for o, _, t, _ in rows] + [(t + 5, 1, o) for o, _, t, _ in rows])
    load, most = {}, {}
    for _, d, o in marks:
        load[o] = load.get(o, 0) - d
        most[o] = max(most.get(o, 0), load[o])
    assert got == most
    cut = sp.ordered(events, ["owner_id"], [F.col("ts_ms"), F.col("event_id")])
    sizes = [r["n"] for r in cut.groupBy(F.shiftright("_at", 33)).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 12 and max(sizes) < 3 * 6000 / 12


def nearest_by_hand(points, labels):
    out = {}
    for page, role, x, y in points:
        d = [((x - a) ** 2 + (y - b) ** 2) / 4 for p, r, a, b in labels if p == page and r == role]
        if d:
            out[page, role, x, y] = min(d)
    return out


@pytest.mark.parametrize("spread, seed", [(300, 1), (5000, 2), (60000, 3), (3_000_000, 4)])
def test_nearest_labels(spark, spread, seed):
    rng = random.Random(seed)
    place = lambda: (rng.randrange(4), rng.choice("AB"), rng.randrange(-spread, spread), rng.randrange(-spread, spread))
    points, labels = [place() for _ in range(400)], [place() for _ in range(40)]
    labels = [x for x in labels if x[:2] != (0, "A")]
    frame = lambda data: spark.createDataFrame(data, "page_id long, role string, cx long, cy long")
    got = {(r["page_id"], r["role"], r["cx"], r["cy"]): r["d2"] for r in kv.nearest_labels(frame(points), frame(labels)).collect()}
    assert got == nearest_by_hand(points, labels)


def test_hot_page_of_candidates_and_labels(spark):
    """A page with 10^5 candidates and 10^5 labels, those far from these in part."""
    side = 100_000
    points = spark.range(side).select(F.lit(1).cast("long").alias("page_id"), F.lit("A").alias("role"), (F.col("id") * 7919 % 12000).alias("cx"), (F.col("id") * 104729 % 18000).alias("cy"))
    labels = spark.range(side).select(F.lit(1).cast("long").alias("page_id"), F.lit("A").alias("role"), (6000 + F.col("id") * 15485863 % 12000).alias("cx"), (F.col("id") * 32452843 % 18000).alias("cy"))
    found = kv.nearest_labels(points, labels)
    assert found.count() == points.distinct().count()
    few = [tuple(r) for r in points.limit(5).collect()]
    want = nearest_by_hand(few, [tuple(r) for r in labels.collect()])
    got = {tuple(r)[:4]: r["d2"] for r in found.join(spark.createDataFrame(few, points.schema), ["page_id", "role", "cx", "cy"]).select("page_id", "role", "cx", "cy", "d2").collect()}
    assert got == want


def test_no_join_on_page_and_role(spark):
    one = spark.createDataFrame([(1, "A", 5, 5)], "page_id long, role string, cx long, cy long")
    plan = kv.nearest_labels(one, one)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert joins and all("gx" in j or "fx" in j or "lx" in j for j in joins)
