"""Order-dependent operators against plain walks over small pages."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from drawbom.functions import similarity as sim
from drawbom.operators import geometry as ge, layout as ly, spread as sp
from drawbom.operators.folds import keep_apart
from drawbom.operators.rules.placement import place_panel

WORDS = ["TRIP", "POLES", "AMP", "CKT", "NAME", "TRIP"]


def page_tokens(seed, pages=6, n=60):
    rnd = random.Random(seed)
    out = []
    for page in range(pages):
        for pos in range(n):
            x, y = rnd.randrange(0, 500), rnd.randrange(0, 260)
            out.append((page, pos, rnd.choice(WORDS), round(rnd.random(), 2), x, y, x + rnd.randrange(5, 60), y + rnd.randrange(6, 30)))
    return out


SCHEMA = "page_id long, pos int, text string, conf double, x1 long, y1 long, x2 long, y2 long"


@pytest.fixture(scope="module")
def tokens():
    return page_tokens(3)


def by_page(rows):
    pages = defaultdict(list)
    for r in rows:
        pages[r[0]].append(r)
    return pages


def overlap(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    inter = w * h if w > 0 and h > 0 else 0
    area = lambda r: (r[6] - r[4]) * (r[7] - r[5])
    return inter / (area(a) + area(b) - inter)


def test_assign_lines(spark, tokens):
    want = set()
    for page, rows in by_page(tokens).items():
        lines = []
        for t in sorted(rows, key=lambda r: (r[5] + r[7], r[4], r[1])):
            c = t[5] + t[7]
            for line in lines:
                if abs(c - (line[0] + line[1])) <= 1.2 * max(1, min(line[1] - line[0], t[7] - t[5])):
                    line[0], line[1] = min(line[0], t[5]), max(line[1], t[7])
                    line[2].append(t[1])
                    break
            else:
                lines.append([t[5], t[7], [t[1]]])
        for k, line in enumerate(sorted(lines, key=lambda l: l[0]), 1):
            want |= {(page, p, k) for p in line[2]}
    got = {tuple(r) for r in ly.assign_lines(spark.createDataFrame(tokens, SCHEMA)).collect()}
    tops = lambda s: sorted(sorted(p for pg, p, k in s if (pg, k) == key) for key in {(pg, k) for pg, _, k in s})
    assert tops(got) == tops(want)


def test_dedup_tokens(spark, tokens):
    near = tokens + [(p, pos + 1000, t, round(1 - c, 2), x1 + 1, y1, x2 + 1, y2) for p, pos, t, c, x1, y1, x2, y2 in tokens]
    want = set()
    for page, rows in by_page(near).items():
        kept = []
        for t in sorted(rows, key=lambda r: (-r[3], -(r[6] - r[4]) * (r[7] - r[5]), r[1])):
            if not any(k[2] == t[2] and overlap(k, t) >= 0.8 for k in kept):
                kept.append(t)
        want |= {(page, t[1]) for t in kept}
    got = ly.dedup_tokens(spark.createDataFrame(near, SCHEMA)).select("page_id", "pos").collect()
    assert {tuple(r) for r in got} == want


def test_dedup_adjacent(spark, tokens):
    want = set()
    for page, rows in by_page(tokens).items():
        kept = []
        for t in sorted(rows, key=lambda r: (r[5], r[4], r[1])):
            if kept and kept[-1][2] == t[2] and abs((t[4] + t[6]) - (kept[-1][4] + kept[-1][6])) < 2 * 90:
                if t[3] > kept[-1][3]:
                    kept[-1] = t
            else:
                kept.append(t)
        want |= {(page, t[1]) for t in kept}
    got = ly.dedup_adjacent(spark.createDataFrame(tokens, SCHEMA), ["page_id"], dx=90).select("page_id", "pos").collect()
    assert {tuple(r) for r in got} == want


def test_plumbline_columns(spark, tokens):
    want = {}
    for page, rows in by_page(tokens).items():
        rows = sorted(rows, key=lambda r: (r[4] + r[6], r[4], r[6]))
        free, column = list(rows), 0
        for seed in rows:
            if seed not in free:
                continue
            column += 1
            taken = [t for t in free if 2 * (t[4] - 3) <= seed[4] + seed[6] <= 2 * (t[6] + 3)]
            want.update({(page, t[1]): column for t in taken})
            free = [t for t in free if t not in taken]
    got = ly.plumbline_columns(spark.createDataFrame(tokens, SCHEMA), ["page_id"]).select("page_id", "pos", "column").collect()
    assert {(r[0], r[1]): r[2] for r in got} == want


def test_cluster_by_row(spark, tokens):
    want = []
    for page, rows in by_page(tokens).items():
        cur = None
        for t in sorted(rows, key=lambda r: (r[5], r[4], r[1])):
            if cur:
                inter = max(0, min(cur[3], t[7]) - max(cur[2], t[5]))
                if t[4] - cur[1] <= 36 and inter / max(1, min(cur[3] - cur[2], t[7] - t[5])) >= 0.35:
                    y1, y2 = max(cur[2], t[5]), min(cur[3], t[7])
                    if y2 <= y1:
                        y1, y2 = min(cur[4], t[5]), max(cur[5], t[7])
                    cur[1], cur[2], cur[3] = max(cur[1], t[6]), y1, y2
                    cur[6].append(t[2])
                    continue
                want.append((page, cur[0], cur[2], " ".join(cur[6])))
            cur = [t[4], t[6], t[5], t[7], t[5], t[7], [t[2]]]
        want.append((page, cur[0], cur[2], " ".join(cur[6])))
    got = ly.cluster_by_row(spark.createDataFrame(tokens, SCHEMA)).select("page_id", "x1", "y1", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_split_header_rows(spark):
    rows = [(1, i, "A", 0.9, 0, y, 10, y + 10) for i, y in enumerate([10, 11, 12, 100, 104])] + [(2, 0, "A", 0.9, 0, 5, 10, 15)]
    got = {r.page_id: (r.threshold, r.top_mean) for r in ly.split_header_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == (pytest.approx(61.5), pytest.approx(16.0))
    assert got[2] == (11.0, 10.0)


def test_anchor_thinning_is_not_islands(spark):
    df = spark.createDataFrame([(1, x) for x in (0, 3, 6, 9, 20)], "page_id long, x long")
    assert sorted(r.x for r in keep_apart(df, ["page_id"], "x", 5).collect()) == [0, 6, 20]


def test_suppressed_boxes_overlap(spark):
    rnd = random.Random(5)
    rows = [(1, i, x, y, x + rnd.randrange(20, 90), y + rnd.randrange(20, 90)) for i in range(150) for x, y in [(rnd.randrange(300), rnd.randrange(300))]]
    kept = ge.nms_keep_larger(spark.createDataFrame(rows, "page_id long, box_id long, x1 long, y1 long, x2 long, y2 long")).collect()
    boxes = [(1, r.box_id, "", 0, r.x1, r.y1, r.x2, r.y2) for r in kept]
    assert all(overlap(a, b) <= 0.5 for i, a in enumerate(boxes) for b in boxes[:i])
    assert [(r.y1, r.x1) for r in sorted(kept, key=lambda r: r.seq)] == sorted((r.y1, r.x1) for r in kept)


def test_two_level_windows_with_one_hot_key(spark):
    df = spark.range(5000).select((F.col("id") % 7 == 0).cast("long").alias("k"), ((F.col("id") * 37) % 4999).alias("o"), (F.col("id") % 11).alias("v"), "id")
    order = [F.col("o"), F.col("id")]
    got = sp.running(df, ["k"], order, {"s": ("sum", F.col("v"), True), "m": ("max", F.col("v"), False)})
    got = sp.neighbours(got, ["k"], order, F.col("v"), prev="p", nxt="n")
    got = {r.id: (r.s, r.m, r.p, r.n) for r in got.collect()}
    rows = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.o, r.id)):
        rows[r.k].append(r)
    for group in rows.values():
        total, top = 0, None
        for i, r in enumerate(group):
            total += r.v
            before = group[i - 1].v if i else None
            after = group[i + 1].v if i + 1 < len(group) else None
            assert got[r.id] == (total, top, before, after)
            top = r.v if top is None else max(top, r.v)


def test_similarity_and_vocabulary(spark):
    words = ["TRLP", "SCHEDUIE", "P0LES", "xyz", "", "AMPS"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    vocab = ["TRIP", "POLES", "SCHEDULE", "AMPS"]
    got = df.select("w", sim.best_vocab_match(F.col("w"), vocab).alias("b"), sim.similarity(F.col("w"), F.lit("TRIP")).alias("s")).collect()
    for r in got:
        scores = [SequenceMatcher(None, sim.fold(r.w), sim.fold(v)).ratio() for v in vocab]
        assert r.b.score == pytest.approx(max(scores)) and r.b.word == vocab[scores.index(max(scores))]
        assert r.s == pytest.approx(scores[0])


def test_header_words_and_labels(spark):
    assert sim.header_word_facts("AMPS")[3] == 5 and sim.header_word_facts("TR1P")[3] == 4 and sim.header_word_facts("P")[4] == 1
    assert sim.header_word_facts("CKT")[1] and sim.header_word_facts("DESCRIPTI0N")[2] and sim.header_word_facts("NOTES")[0]
    assert sim.header_word_facts("123") == (False, False, False, 0, 0) or sim.header_word_facts("123")[3] == 0
    rows = [(1, 1, "TRIP", 0, 40), (1, 2, "POLES", 50, 90), (2, 1, "AMP, POLES", 0, 60)]
    got = {(r.page_id, r.ord): (r.class_role, r.likely_combined) for r in ly.classify_bands(
        spark.createDataFrame(rows, "page_id long, ord long, text string, x1 long, x2 long")).collect()}
    assert got == {(1, 1): ("trip", False), (1, 2): ("poles", False), (2, 1): ("combo", True)}


def test_placement_keeps_quantities_and_balances():
    line = lambda poles, amps, cnt, frame, width, pairs: {"poles": poles, "amperage": amps, "special_features": "", "cnt": cnt, "frame": frame,
                                                          "trip": "MAGNETIC", "width": width, "amps": amps, "product": f"{frame}{amps}-", "rating": 25, "pairs": pairs}
    rows = place_panel("HCJ", 27, False, [line(2, 100, 3, "H", 4.5, ["AB", "BC", "AC"]), line(3, 200, 1, "J", 4.5, ["AB"]), line(1, 20, 1, "H", 3.0, [])])
    parts = {p: n for kind, p, n, rating in rows if kind == "breaker" and rating == 25}
    assert sum(parts.values()) == 4
    assert {p: n for p, n in parts.items() if p.startswith("H")} == {"H100-1": 1, "H100-4": 1, "H100-2": 1}
    assert ("note", "I-Line breakers must be 2P or 3P only", 1, None) in rows and ("spaces left", "", 15, None) in rows
    full = place_panel("HCP", 3, False, [line(3, 400, 2, "L", 6.0, ["AB"])])
    assert sum("bottleneck" in p or "too many" in p for kind, p, _, _ in full if kind == "note") == 2
    assert sum(n for kind, _, n, _ in full if kind == "breaker") == 2
