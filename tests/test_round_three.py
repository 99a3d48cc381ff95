"""Steps that grew too slow on large tables: same results, and the costly step is gone."""

import datetime as dt
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from drawbom.functions import similarity as sim
from drawbom.operators import geometry as ge, jobs as jb, layout as ly, pages as pg, schedule as sc, spread as sp
from drawbom.plans.catalogue import CHECKS, PLANS
from drawbom.sources import derived as de, files as fl
from drawbom.streaming import jobs as st

from test_files_and_streams import T0, event
from test_registered import rows


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overdue_events_stream_without_python(spark, tmp_path):
    """Before, every job of every slice was a call of a Python function."""
    at = lambda i, ms, job, state: (i, T0 + dt.timedelta(milliseconds=ms), 1, job, state)
    rows = [at(1, 0, 1, "queued"), at(2, 900_000, 1, "parsing"), at(3, 1_800_001, 1, "done"), at(4, 0, 2, "done"), at(5, 10, 3, "queued"), at(6, 10, 3, "error")]
    events = spark.createDataFrame(rows, st.EVENT_SCHEMA)
    tick = spark.createDataFrame([event(-1, 300, -1, "done")], st.EVENT_SCHEMA)
    got = st.replay(spark, [events, tick], st.stream_overdue_events, "append").collect()
    whole = events.withColumn("ts_ms", F.unix_millis("ts"))
    want = jb.stuck_jobs(whole, int((T0 + dt.timedelta(hours=4)).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and [r.event_id for r in got] == [2]
    events.write.parquet(str(tmp_path / "e"))
    plan = st.stream_overdue_events(st.read_events(spark, str(tmp_path / "e")))._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan


TOKENS = "pdf_id long, page_id long, pos long, text string, conf double, x1 long, y1 long, x2 long, y2 long"


def test_phrases_by_chunks_equal_phrases_of_whole_pages(spark):
    """Runs of dashes longer than a chunk, cuts everywhere. Before, all tokens were ordered and copied around each cut."""
    rnd = random.Random(8)
    words = ["panel", "schedule", "one", "line", "riser", "diagram", "single-line", "-", "- -", "x", None]
    pages = {1: ["riser"] * 3 + ["-"] * 700 + ["diagram"], 2: ["-"] * 300 + ["panel"] + ["-"] * 300 + ["schedules"], 3: [rnd.choice(words) for _ in range(1500)],
             4: ["line"], 5: ["panel"] * 255 + ["single", "line", "diagram"] + ["x"] * 20}
    tokens = spark.createDataFrame([(1, p, i, w, 0.5, 0, 0, 8, 14) for p, ws in pages.items() for i, w in enumerate(ws)], TOKENS)
    want = {}
    for p, ws in pages.items():
        text = re.sub(r"\s+", " ", " ".join(w for w in ws if w is not None)).strip()
        for i, (b, pattern) in enumerate(pg.LABEL_PATTERNS):
            for m in re.findall(pattern, text, re.I):
                want[p, b, i, m.lower()] = want.get((p, b, i, m.lower()), 0) + 1
    got = pg.match_label_buckets(tokens)
    assert {tuple(r)[:4]: r.hits for r in got.collect()} == want
    assert "Generate" not in optimized(pg.page_chunks(tokens))


def test_confidence_and_likeness_of_distinct_texts(spark):
    """Before, every token met the phrases of its page, and every word of it all targets."""
    rows = [(1, 1, 0, "Panel", 0.5), (1, 1, 1, "schedule", 0.7), (1, 1, 2, "the AN", 0.9), (1, 1, 3, "zzz", 0.1), (1, 1, 4, "an", 80.0), (1, 2, 0, "zzz", 0.3), (1, 3, 0, "--", 0.3), (1, 4, 0, None, 0.3)]
    tokens = spark.createDataFrame([(*r, 0, 0, 8, 14) for r in rows], TOKENS)
    matches = spark.createDataFrame([(1, "panel schedule"), (2, "riser")], "page_id long, phrase string")
    got = {(r.page_id, r.phrase): r.conf for r in pg.match_confidence(tokens, matches).collect()}
    assert got == {(1, "panel schedule"): 2.9 / 4, (2, "riser"): 0.9}
    near = pg.fuzzy_vocab_hit(tokens)
    assert {r.page_id: (r.like_panel, r.like_schedule, r.like_riser) for r in near.collect()} == {1: (True, True, False), 2: (False, False, False)}
    assert "levenshtein" not in optimized(near) and "Generate" not in optimized(near)


BOXED = "page_id long, pos long, text string, conf double, x1 long, y1 long, x2 long, y2 long"


def test_adjacent_readings_are_shuffled_once(spark):
    """Before, the kept positions were joined to all candidates again."""
    rows = [(1, 0, "A", 0.5, 0, 0, 10, 9), (1, 1, "A", 0.6, 4, 0, 14, 9), (1, 2, "B", 0.9, 20, 0, 30, 9), (1, 3, "A", 0.1, 40, 0, 50, 9), (1, 4, "A", 0.9, 100, 0, 110, 9), (2, 0, None, 0.1, 0, 0, 5, 9)]
    out = ly.dedup_adjacent(spark.createDataFrame(rows, BOXED), ["page_id"])
    assert sorted(tuple(r)[:2] for r in out.collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    assert out.columns == [c.split()[0] for c in BOXED.split(", ")] and "Join" not in optimized(out)


def test_circuit_labels_by_one_pattern(spark):
    """Before, every text was rewritten three times to be compared."""
    rnd = random.Random(2)
    texts = ["CKT", "ckt.", "C1KT", "CCT 2", "CCKT", "A CKT", "C-K T", "CKT\n", "K", "", *("".join(rnd.choice("CKT1a .2") for _ in range(rnd.randrange(7))) for _ in range(300))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.upper("t").rlike(ly.CKT_ALONE).alias("a"), F.upper("t").rlike(ly.CKT_WITHIN).alias("w")).collect()
    word = lambda t: re.sub("[^A-Z]", "", t.upper().replace("1", "I"))
    assert all(r.a == (word(r.t) in ("CCT", "CKT")) and r.w == ("CCT" in word(r.t) or "CKT" in word(r.t)) for r in got)


def test_numbers_of_a_column_are_read_once(spark):
    """Before, the digit runs of all texts were read for sizes, positions and values each."""
    rows = [(1, 0, "20A", 0, 0, 9, 9), (1, 1, "x 5/100", 0, 0, 9, 9), (1, 2, "30", 0, 5, 9, 14), (1, 3, "7 15", 0, 30, 9, 39), (1, 4, "no", 0, 60, 9, 69)]
    out = sc.trip_values(spark.createDataFrame(rows, "page_id long, ord long, text string, x1 long, y1 long, x2 long, y2 long"), ["page_id"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 9, "20"), (1, 3, 69, "15")]
    assert "regexp_extract_all" not in optimized(out)


def test_likeness_of_a_pair_is_kept_from_batch_to_batch():
    """Before, each batch compared its pairs again."""
    before = sim._folded_ratio.cache_info().hits
    assert sim._folded_ratio("TR1P", "TRIP") == sim._folded_ratio("TR1P", "TRIP") == 1.0
    assert sim._folded_ratio.cache_info().hits > before


def test_suppression_counts_rows_of_its_input(spark, monkeypatch):
    """Before, the size of keys was taken from the folded boxes, which ran the fold twice."""
    boxes = spark.createDataFrame([(1, i, 10 * i, 0, 10 * i + 15, 9) for i in range(5)], "page_id long, box_id long, x1 long, y1 long, x2 long, y2 long")
    seen, real = [], sp.by_size
    monkeypatch.setattr(sp, "by_size", lambda df, keys, small, large, sizes=None: seen.append(sizes) or real(df, keys, small, large, sizes))
    assert ge.nms_keep_larger(boxes).count() == 5
    assert len(seen) == 2 and all(s is boxes for s in seen)


def test_a_folder_of_lines_has_few_files(spark, tmp_path):
    """Before, each of the eight tasks opened a file in each folder."""
    lines = spark.range(0, 800, 1, 8).selectExpr("id % 5 AS pdf_id", "id AS page_id", "id AS line_no", "id AS y_center", "id AS x_left", "id AS x_right", "id AS thickness")
    fl.write_lines(lines, str(tmp_path / "l"))
    assert len(list((tmp_path / "l").rglob("*.json"))) == 5
    assert fl.read_lines(spark, str(tmp_path / "l")).select(*lines.columns).exceptAll(lines).count() == 0 and fl.read_lines(spark, str(tmp_path / "l")).count() == 800


@pytest.fixture
def lineitem(spark, tmp_path):
    """2,000 rows of 300 pages, some of no page."""
    rnd = random.Random(4)
    items = [(rnd.choice([None, *range(300)]), rnd.randrange(900), rnd.randrange(90), rnd.randrange(7), float(rnd.randrange(1, 51)), float(i)) for i in range(2000)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    spark.createDataFrame(items, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_boxes_are_dealt_by_their_number(spark, lineitem, monkeypatch):
    """Before, a task sorted as many boxes as the session's partitions left it, so its memory grew with the table."""
    monkeypatch.setattr(de, "PART", 100, raising=False)
    parts = de.table(spark, lineitem, "boxes").groupBy(F.spark_partition_id().alias("part"), "page_id").count().collect()
    assert len({r.part for r in parts}) > 15 and len(parts) == len({r.page_id for r in parts})
    assert max(sum(r["count"] for r in parts if r.part == p) for p in {r.part for r in parts}) < 300


def test_parts_are_few_enough_to_be_written_straight():
    """Before, more than 200 parts made every writing task sort what it read, in up to 889 MB."""
    assert [de.parts_of(n, 8) for n in (0, 3_600_000, 36_000_000, 216_000_000, 2_000_000_000)] == [8, 15, 144, 200, 500]


@pytest.mark.parametrize("name", ["g1_plausible_boxes", "g4_to_page_fraction", "g17_filter_peripheral"])
def test_sizes_of_pages_need_no_join(spark, lineitem, name):
    """Before, boxes were joined with a table of all pages, for each kind of box anew, and those of no page were lost."""
    out, db = PLANS[name](spark, lineitem), duckdb.connect()
    db.cursor().execute(f"create view lineitem as select * from '{lineitem}/lineitem.parquet/*.parquet'").fetchall()
    assert "Join" not in optimized(out) and optimized(out).count("Window [") == 1
    assert rows(out.toArrow()) == rows(db.cursor().execute(CHECKS[name]).to_arrow_table())


def test_kinds_of_boxes_equal_the_two_filters(spark, lineitem):
    boxes = de.table(spark, lineitem, "boxes").filter("page_id IS NOT NULL")
    pages = boxes.select("page_id").distinct().select("page_id", (F.lit(300) + F.col("page_id")).alias("width"), F.lit(420).alias("height"))
    both = (ge.plausible_boxes(boxes, pages).withColumn("kind", F.lit("void"))
            .unionByName(ge.plausible_table_boxes(boxes, pages).withColumn("kind", F.lit("table"))))
    got = ge.plausible_kinds(boxes, pages)
    assert rows(got.toArrow()) == rows(both.toArrow()) and got.select("kind").distinct().count() == 2
