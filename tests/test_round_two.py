"""Cases that earlier versions got wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from drawbom.operators import geometry as ge, keyvalue as kv, pages as pg, spread as sp
from drawbom.operators.rules import placement as pl
from drawbom.sources import files as fl
from drawbom.sources.derived import table
from drawbom.streaming import jobs as st

from test_files_and_streams import event, run, write


def tokens_of(spark, words):
    return spark.createDataFrame([(1, 1, i, w, 0.9, 0, 0, 8, 14) for i, w in enumerate(words)], "pdf_id long, page_id long, pos long, text string, conf double, x1 long, y1 long, x2 long, y2 long")


@pytest.mark.parametrize("start", [0, 230, 240, 250, 255])
def test_a_phrase_over_many_dashes_is_found_anywhere(spark, start):
    words = ["x"] * start + ["panel", *["-"] * 39, "schedule"] + ["y"] * 300
    hits = pg.match_label_buckets(tokens_of(spark, words)).filter("phrase LIKE 'panel%'").collect()
    assert [r.hits for r in hits] == [1]


def test_labels_far_away_still_count(spark):
    cands = spark.createDataFrame([(1, "BUS", 0, 0, 0, 10, 10), (1, "BUS", 1, 0, 9000, 10, 9010), (2, "BUS", 2, 0, 0, 10, 10)], "page_id long, role string, pos long, x1 long, y1 long, x2 long, y2 long")
    labels = spark.createDataFrame([(1, "BUS", 0, 6000, 10, 6010)], "page_id long, role string, x1 long, y1 long, x2 long, y2 long")
    got = {r.pos: r.affinity for r in kv.label_affinity(cands, labels).collect()}
    assert 0 < got[0] == pytest.approx(2.718281828459045 ** (-6000 / 80), rel=1e-9)
    assert 0 < got[1] == pytest.approx(2.718281828459045 ** (-3000 / 80), rel=1e-9) and got[2] == 0


def test_every_child_of_a_crop_has_a_name(spark):
    boxes = spark.createDataFrame([(1, i, 0, 50 * i, 200, 50 * i + 40) for i in range(120)], "page_id long, box_id long, x1 long, y1 long, x2 long, y2 long")
    crops = spark.createDataFrame([(1, "crop1", 1000, 9000)], "page_id long, name string, width long, height long")
    names = {r.name for r in ge.split_multi_table_crops(crops, boxes).collect()}
    assert len(names) == 120 and {"crop1__tbl01", "crop1__tbl100", "crop1__tbl120"} <= names


def test_a_null_neighbour_is_not_skipped(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 10, None), (1, 11, "b")], "k long, x long, v string")
    got = {r.x: (r.p, r.n) for r in sp.neighbours(df, ["k"], [F.col("x")], F.col("v"), prev="p", nxt="n").collect()}
    assert got == {0: (None, None), 10: ("a", "b"), 11: (None, None)}


def named(spark, *words):
    rows = [(1, 1, i, w, 0.9, 100 * i, 0, 100 * i + 60, 14) for i, w in enumerate(words)]
    tokens = spark.createDataFrame(rows, "page_id long, line_no long, pos long, text string, conf double, x1 long, y1 long, x2 long, y2 long")
    return [(r.name, r.pass_no) for r in kv.extract_name(tokens, spark.createDataFrame([(1, 5000)], "page_id long, width long")).collect()]


def test_names_in_one_token(spark):
    assert named(spark, "PANEL: SCHEDULE", "PANEL: lp-2") == [("LP-2", 1)]
    assert named(spark, "Panel: Lp-1a") == [("LP-1A", 1)]
    assert named(spark, "PANEL", "SERVICE ENTRANCE", "Ø", "DP1")[0][0] == "DP1"


def test_names_by_pass(spark):
    assert named(spark, "BRANCH", "PANEL", ":", "LP", "2A", "VOLTAGE", "X9")[0] == ("LP 2A", 2)
    assert named(spark, "PANEL", ":", "VOLTS", "DP-7") == [("DP-7", 2)]
    assert named(spark, "PNL", "SIZE", "K2") == [("K2", 3)]
    assert named(spark, "12", "NOTES", "K2") == [("K2", 4)]
    assert named(spark, "SCHEDUIE", "480/277", "12") == []


def test_a_tall_centred_word_is_the_name_and_joins_the_candidates(spark):
    rows = [(1, 1, 0, "PANEL:", 0.9, 0, 0, 60, 14), (1, 1, 1, "AA", 0.9, 100, 0, 160, 14), (1, 2, 2, "C2B", 0.8, 480, 20, 520, 60)]
    tokens = spark.createDataFrame(rows, "page_id long, line_no long, pos long, text string, conf double, x1 long, y1 long, x2 long, y2 long")
    pages = spark.createDataFrame([(1, 1000)], "page_id long, width long")
    names = kv.extract_name(tokens, pages)
    assert [tuple(r) for r in names.collect()] == [(1, "C2B", 0, 480, 20, 520, 60, 0.8, 0.99, 0.45)]
    cands = kv.with_extracted_name(kv.value_candidates(tokens.drop("line_no"), pages), names)
    assert [(r.pos, r.text) for r in cands.filter("role = 'NAME' AND pos < 0").collect()] == [(-1, "C2B")]
    words = kv.extract_name(tokens.filter("pos < 2"), pages).first()
    assert (words["name"], words["x1"], words["x2"], words["conf"]) == ("AA", 100, 160, 0.9)


def test_series_rated_panels_take_the_lowest_rating(spark):
    from drawbom.sources.derived import table
    frames, pairs = (table(spark, "/root/testdata/sf0.001", n) for n in ("frames", "pair_rules"))
    panels = spark.createDataFrame([(1, "HCP", 240, 65, 84, True, True, False), (2, "HCP", 240, 65, 84, False, True, True)],
                                   "panel_id long, series string, voltage int, int_rating int, spaces int, series_rated boolean, spd boolean, allow_spd boolean")
    breakers = spark.createDataFrame([(p, 3, 100, 1, "") for p in (1, 2)], "panel_id long, poles int, amperage int, cnt int, special_features string")
    rows = pl.place_iline(panels, breakers, frames, pairs).collect()
    rating = {r.panel_id: r.rating for r in rows if r.kind == "breaker"}
    assert rating[1] < 65 <= rating[2]
    assert {r.panel_id for r in rows if "surge" in r.product or "SPD" in r.product} == {2}
    left = {r.panel_id: r.qty for r in rows if r.kind == "spaces left"}
    assert left[1] - left[2] == 9


def test_late_events_do_not_reopen_a_finished_job(spark, tmp_path):
    write(spark, tmp_path / "e", 0, [event(1, 30, 1, "done")])
    q = run(st.stream_stuck_jobs(st.read_events(spark, str(tmp_path / "e"))), "late", "append")
    for i, rows in enumerate([[event(2, 10, 1, "parsing")], [event(3, 240, 8, "done")], [event(4, 480, 9, "done")]]):
        write(spark, tmp_path / "e", i, rows)
        q.processAllAvailable()
    q.stop()
    assert spark.table("late").count() == 0


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf, Context
    with pytest.raises(ValueError):
        fl.shared_folder(Session)


def test_lines_of_one_rating_add_up_in_their_note():
    line = {"poles": 2, "amperage": 900, "frame": None, "trip": None, "width": None, "amps": None, "product": None, "pairs": None}
    got = pl.place_panel("HCJ", 84, False, [{**line, "special_features": "", "cnt": 3}, {**line, "special_features": "GFI", "cnt": 2}])
    assert ("note", "No compatible frame: 2P @ 900A", 5, None) in got


def test_unknown_panels_come_last_in_order(spark):
    from drawbom.operators import bom as bm
    rows = [(p, "Breaker", f"P{p}", 1, "", 10) for p in (9_000_000_000, 7, 1)]
    bom = spark.createDataFrame(rows, "panel_id long, item_type string, product string, qty long, notes string, section long")
    panels = spark.createDataFrame([(1, -1, 5)], "panel_id long, job_id long, ord long")
    assert [(r.panel_id, r.row_no) for r in bm.order_bom(bom, panels).orderBy("row_no").collect()] == [(1, 1), (7, 2), (9_000_000_000, 3)]


SMALL = "/root/testdata/sf0.001"


def by_page(df):
    pages = {}
    for r in df.collect():
        pages.setdefault(r.page_id, []).append(r)
    return pages


def test_backfill_reads_all_picks_and_the_classes_of_labels(spark):
    queries, cands = entry.queries(), by_page(table(spark, SMALL, "header_cands"))
    classes = {(r.page_id, r.ord): r.class_role for r in queries["l17_classify_bands"](spark, SMALL).collect()}
    want = []
    for page, labels in cands.items():
        have = set()
        for role in {r.role for r in labels}:
            best, buckets = [], set()
            for r in sorted((r for r in labels if r.role == role and r.sim >= 0.6), key=lambda r: (-round(0.9 * r.sim + 0.1 * r.conf, 9), r.ord)):
                bucket = round((r.x1 + r.x2) / 2 / 28)
                if bucket not in buckets:
                    buckets.add(bucket)
                    best.append((page, role, r.ord, "pick"))
            want += best[:2]
            have |= {role} if best else set()
        for r in labels:
            c = classes[page, r.ord]
            want += [(page, role, r.ord, "class") for role in {"combo": ["trip", "poles"], "unknown": []}.get(c, [c]) if role not in have]
    got = [(r.page_id, r.role, r.ord, r.origin) for r in queries["l25_backfill_classified"](spark, SMALL).collect()]
    assert sorted(got) == sorted(want)
    assert any(page % 2 and role == "poles" and origin == "pick" for page, role, _, origin in got)


def test_column_roles_follow_the_scores_of_their_words(spark):
    queries = entry.queries()
    want = []
    for page, cols in by_page(queries["l15_score_header_columns"](spark, SMALL)).items():
        hero = [c for c in cols if not c.has_notes and c.ckt == 0 and c.description == 0]
        mid = (min(c.x_left for c in hero) + max(c.x_right for c in hero)) / 2 if hero else 0
        side = lambda c: (c.x_left + c.x_right) / 2 < mid
        best = {(s, f): min(((-c[f], c.column) for c in hero if side(c) == s and c[f] > 0), default=(0, None))[1] for s in (True, False) for f in ("trip_rank", "poles_rank")}
        trips, poles = [best[s, "trip_rank"] for s in (True, False)], [best[s, "poles_rank"] for s in (True, False)]
        layout = "combined" if any(t is not None and t == p for t, p in zip(trips, poles)) else "separated" if trips != [None, None] and poles != [None, None] else "unknown"
        for c in cols:
            t, p = c.column == best[side(c), "trip_rank"], c.column == best[side(c), "poles_rank"]
            role = None if c.has_notes else "ckt" if c.ckt >= max(2, c.description) else "description" if c.description >= 2 else None
            if c in hero:
                role = ("combo" if t and p else None) if layout == "combined" else "trip" if t else "poles" if p else None
            want.append((page, c.column, role, layout))
    got = [(r.page_id, r.column, r.role, r.layout) for r in queries["l16_roles_of_scored_columns"](spark, SMALL).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len({r[2] for r in got}) > 3


def test_first_lines_of_a_page_come_from_its_top(spark):
    """Line numbers of the top strips are those of the whole page, and only they are read."""
    from drawbom.operators import layout as ly
    rows = [(p, i, f"t{i}", 90 * (i % 12), 20 * (i // 12) + (p + i) % 5, 90 * (i % 12) + 40, 20 * (i // 12) + (p + i) % 5 + 14) for p in (1, 2) for i in range(240)]
    tokens = spark.createDataFrame(rows, "page_id long, pos int, text string, x1 long, y1 long, x2 long, y2 long")
    top = ly.top_of_pages(tokens, 3)
    lines = lambda df: {(r.page_id, r.pos): r.line_no for r in ly.assign_lines(df).filter("line_no <= 3").collect()}
    assert top.count() == 72 and lines(top) == lines(tokens)


def test_main_mode_across_two_tokens(spark):
    rows = [(1, 0, "MAIN", 0, 0), (1, 1, "LUGS", 50, 0), (2, 0, "MAIN", 0, 0), (2, 1, "x", 50, 0), (2, 2, "LUGS", 90, 0), (3, 0, "MCB", 0, 0), (4, 0, "MAIN BREAKER", 0, 0), (4, 1, "MLO", 9, 9)]
    tokens = spark.createDataFrame(rows, "page_id long, pos int, text string, x1 long, y1 long")
    assert {r.page_id: r.mode for r in kv.main_mode(tokens).collect()} == {1: "MLO", 2: None, 3: "MCB", 4: None}
