"""Findings of round four: work by page on tokens kept by page needs no shuffle, and no fold
where a formula gives the same."""

import random

import pytest

import __spark_entry__ as entry
from drawbom.operators import keyvalue as kv, layout as ly, spread as sp
from drawbom.sources import derived

SF = "/root/testdata/sf0.001"
BOXES = "page_id long, pos int, text string, conf double, x1 long, y1 long, x2 long, y2 long"


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["l1_assign_lines", "l3_dedup_tokens", "l4_dedup_adjacent", "l5_plumbline_columns",
                                  "h2_value_candidates", "h3_clamp_to_header", "h4_label_affinity", "h11_name_fallback"])
def test_work_by_page_shuffles_no_tokens(spark, name):
    """Before, l3 shuffled 26 times the text, l4 14 and l5 11 times; h2 to h11 shuffled all tokens by their
    text once the readings of distinct texts were too many to be sent (F7, F9 to F15)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan


def test_buckets_follow_the_text():
    assert [derived.buckets_of(n, 8) for n in (0, derived.BUCKET, 20 * derived.BUCKET + 1)] == [8, 8, 21]


def lines_by_hand(rows):
    """First line whose centre is near enough, lines numbered from the top."""
    out = {}
    for page in {r[0] for r in rows}:
        lines, at = [], {}
        for _, pos, _, _, x1, y1, x2, y2 in sorted((r for r in rows if r[0] == page), key=lambda r: (r[5] + r[7], r[4], r[1])):
            near = [i for i, (a, b) in enumerate(lines) if abs(y1 + y2 - a - b) <= 1.2 * max(1, min(b - a, y2 - y1))]
            if near:
                lines[near[0]] = (min(lines[near[0]][0], y1), max(lines[near[0]][1], y2))
            else:
                lines.append((y1, y2))
            at[pos] = near[0] if near else len(lines) - 1
        order = sorted(range(len(lines)), key=lambda i: (lines[i][0], i))
        out |= {(page, pos): order.index(i) + 1 for pos, i in at.items()}
    return out


@pytest.mark.parametrize("heights, dy", [((14,), 3), ((14,), 9), ((6, 14, 40), 9), ((0, 1), 1)])
def test_lines_with_and_without_fold(spark, heights, dy):
    rnd = random.Random(len(heights) + dy)
    rows = [(p, i, "A", 0.5, rnd.randrange(300), y := 20 * rnd.randrange(9) + rnd.randrange(dy), 300, y + rnd.choice(heights)) for p in (1, 2, 3) for i in range(60)]
    got = {(r.page_id, r.pos): r.line_no for r in ly.assign_lines(spark.createDataFrame(rows, BOXES)).collect()}
    assert got == lines_by_hand(rows)


def test_rows_of_kept_readings_travel_whole(spark):
    rows = [(1, i, t, c, x, y, x + 20, y + 10) for i, (t, c, x, y) in enumerate(
        [("A", 0.5, 0, 0), ("A", 0.9, 1, 0), ("A", 0.9, 1, 0), ("B", 0.1, 0, 0), ("A", 0.2, 2, 1), ("A", 0.3, 60, 0), ("A", 0.4, 0, 50)])]
    assert listed(ly.dedup_tokens(spark.createDataFrame(rows, BOXES))) == [rows[i] for i in (1, 3, 4, 5, 6)]


def nearest(c, labels, role):
    d = [((c[2] + c[4] - x1 - x2) ** 2 + (c[3] + c[5] - y1 - y2) ** 2) / 4 for p, r, x1, y1, x2, y2 in labels if p == c[0] and r == role]
    return min(d) if d else None


@pytest.mark.parametrize("hot, block", [(10 ** 6, 10 ** 6), (10 ** 6, 7), (60, 10 ** 6), (0, 10 ** 6)])
def test_labels_near_candidates_on_both_sides(spark, monkeypatch, hot, block):
    """Before, candidates met labels in four joins on position, each with a shuffle of all candidates (F2 to F6, F8, F11)."""
    rnd = random.Random(hot + block)
    box = lambda: (x := rnd.randrange(900), y := rnd.randrange(600), x + rnd.randrange(5, 90), y + rnd.randrange(8, 20))
    cands = [(p, rnd.choice(["BUS", "NAME", "AIC"]), *box()) for p, n in ((1, 70), (2, 9), (3, 2)) for _ in range(n)]
    labels = [(p, rnd.choice(["BUS", "NAME", "WRONG"]), *box()) for p, n in ((1, 20), (2, 5), (4, 3)) for _ in range(n)]
    monkeypatch.setattr(sp, "HOT", hot)
    monkeypatch.setattr(kv, "BLOCK", block)
    schema = "page_id long, role string, x1 long, y1 long, x2 long, y2 long"
    got = listed(kv.near_labels(spark.createDataFrame(cands, schema), spark.createDataFrame(labels, schema)))
    ends = lambda c: min((l[4] for l in labels if l[:2] == c[:2] and min(c[5], l[5]) > max(c[3], l[3])), default=None)
    assert got == sorted(((*c, nearest(c, labels, c[1]), nearest(c, labels, "WRONG"), ends(c)) for c in cands), key=repr)


@pytest.mark.parametrize("hot", [0, 10 ** 6])
def test_plain_numbers_beside_labels_on_both_sides(spark, monkeypatch, hot):
    monkeypatch.setattr(sp, "HOT", hot)
    tokens = [(1, i, t, 0.9, x, y, x + 30, y + 14) for i, (t, x, y) in enumerate([("AIC", 0, 0), ("22", 40, 5), ("22", 200, 5), ("22", 40, 40), ("65KA", 300, 0)])]
    cands = kv.value_candidates(spark.createDataFrame(tokens, BOXES), spark.createDataFrame([(1, 1080, 60)], "page_id long, width long, height long"))
    assert sorted(r.pos for r in cands.filter("role = 'AIC'").collect()) == [1, 4]
