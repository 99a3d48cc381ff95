"""Keys on either side of the window limit give the same results."""

import random

import pytest
from pyspark.sql import functions as F

from drawbom.operators import folds, keyvalue as kv, layout as ly, spread as sp


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def rows(spark):
    rnd = random.Random(7)
    data = [(k, o, rnd.choice([None, 1, 5, 9]), rnd.choice([None, "a", "b"])) for k, n in (("big", 60), ("small", 9), (None, 7)) for o in range(n)]
    return spark.createDataFrame(data, "k string, o long, v long, t string")


def specs():
    return {"s": ("sum", F.col("v"), True), "e": ("sum", F.col("v"), False), "m": ("max", F.col("v"), False), "a": ("min_ahead", F.col("v"), True),
            "l": ("last", F.col("t"), False), "n": ("next", F.col("t"), False)}


@pytest.mark.parametrize("hot", [0, 8, 20, 1000])
def test_windows_and_scans_agree(spark, rows, monkeypatch, hot):
    want = listed(sp.scan(sp.ordered(rows, ["k"], [F.col("o")]), ["k"], specs()).drop(sp.PLACE))
    monkeypatch.setattr(sp, "HOT", hot)
    monkeypatch.setattr(sp, "STRETCH", 16)
    assert listed(sp.running(rows, ["k"], [F.col("o")], specs())) == want
    near = sp.neighbours(rows, ["k"], [F.col("o")], F.col("v"), prev="p", nxt="x")
    assert listed(near) == listed(sp.beside(sp.ordered(rows, ["k"], [F.col("o")]), ["k"], F.col("v"), prev="p", nxt="x").drop(sp.PLACE))


def test_small_keys_need_no_python(spark, rows):
    """Before, every ordered step went through two Python passes over stretches whose number stayed as the table grew."""
    plan = sp.running(rows, ["k"], [F.col("o")], specs())._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Window" in plan


def test_stretches_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(sp, "STRETCH", 50)
    cut = sp.ordered(spark.range(1000).select(F.lit(1).alias("k"), "id"), ["k"], [F.col("id")], 1000)
    assert cut.groupBy(F.shiftright(sp.PLACE, 33)).count().agg(F.count("*"), F.max("count")).first()[0] == 20


@pytest.mark.parametrize("hot", [0, 1000])
def test_layout_steps_on_both_sides(spark, monkeypatch, hot):
    rnd = random.Random(3)
    tokens = spark.createDataFrame(
        [(p, i, rnd.choice(["A", "A ", "B", "TRIP"]), rnd.random(), x := rnd.randrange(200), y := rnd.randrange(120), x + rnd.randrange(5, 60), y + rnd.randrange(8, 20)) for p in (1, 2) for i in range(70)],
        "page_id long, pos int, text string, conf double, x1 long, y1 long, x2 long, y2 long")
    steps = [ly.assign_lines, ly.dedup_tokens, lambda t: ly.dedup_adjacent(t, ["page_id"]), lambda t: ly.plumbline_columns(t, ["page_id"]), ly.cluster_by_row,
             lambda t: ly.split_wide_gaps(t, ["page_id"]), lambda t: folds.keep_apart(t.withColumn("x", F.col("x1")), ["page_id"], "x", 5)]
    want = [listed(s(tokens)) for s in steps]
    monkeypatch.setattr(sp, "HOT", hot)
    for step, rows in zip(steps, want):
        assert listed(step(tokens)) == rows


@pytest.mark.parametrize("pairs", [0, 40, 10 ** 9])
def test_nearest_labels_on_both_sides(spark, monkeypatch, pairs):
    """Small pages compare points and labels directly, large ones by rings; before, every page went by rings of 13 grids."""
    rnd = random.Random(5)
    place = lambda page, n: [(page, rnd.choice(["BUS", "MAIN"]), rnd.randrange(4000), rnd.randrange(4000)) for _ in range(n)]
    schema = "page_id long, role string, cx long, cy long"
    points, labels = place(1, 40) + place(2, 4) + [(3, "BUS", 1, 1)], place(1, 9) + place(2, 5)
    want = {p: min((p[2] - x) ** 2 + (p[3] - y) ** 2 for g, r, x, y in labels if (g, r) == p[:2]) / 4 for p in points if any(p[:2] == q[:2] for q in labels)}
    monkeypatch.setattr(kv, "PAIRS", pairs)
    got = kv.nearest_labels(spark.createDataFrame(points, schema), spark.createDataFrame(labels, schema))
    assert {tuple(r)[:4]: r.d2 for r in got.collect()} == want


def test_number_readings_are_evaluated_once(spark):
    """Before, the filters on readings held each pattern several times, and both branches read every text."""
    tokens = spark.createDataFrame([(1, 0, "225A", 0.9, 0, 0, 32, 14), (1, 1, "word", 0.9, 40, 0, 72, 14)], "page_id long, pos int, text string, conf double, x1 long, y1 long, x2 long, y2 long")
    out = kv.value_candidates(tokens, spark.createDataFrame([(1, 1080, 60)], "page_id long, width long, height long"))
    assert "KA" not in out.select("page_id", "role")._jdf.queryExecution().optimizedPlan().toString().replace("KAIC", "")
    assert sorted((r.pos, r.role) for r in out.collect()) == [(0, "BUS"), (0, "MAIN"), (0, "NAME"), (0, "VOLTAGE"), (1, "NAME")]
