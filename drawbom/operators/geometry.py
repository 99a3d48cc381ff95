"""Lines, boxes and bands as tables of integer pixel coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.functions.electrical import snap_spaces
from drawbom.operators.folds import islands, keep_apart
from drawbom.operators.spread import along, first_per, neighbours, numbered, running

TILE_PX = 256


def area(b: str = "") -> Column:
    return (F.col(f"{b}x2") - F.col(f"{b}x1")) * (F.col(f"{b}y2") - F.col(f"{b}y1"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs; touching boxes give zero."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    inter = F.when((w > 0) & (h > 0), w * h).otherwise(0)
    size = lambda s: (s["x2"] - s["x1"]) * (s["y2"] - s["y1"])
    union = size(a) + size(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def with_page_size(boxes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Boxes with the `width` and `height` of their page; without `pages` they have them already."""
    return boxes if pages is None else boxes.join(pages.select("page_id", "width", "height"), "page_id")


def void_like(min_area_fr: float = 0.004, min_side: int = 90, max_fr: float = 0.95, max_area_fr: float = 0.30, border: int = 4,
              fr_range=(0.10, 0.60)) -> Column:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rel, wf, hf = w * h / (F.col("width") * F.col("height")), w / F.col("width"), h / F.col("height")
    return ((rel >= min_area_fr) & (rel < max_area_fr) & (w >= min_side) & (h >= min_side) & (wf < max_fr) & (hf < max_fr)
            & (F.col("x1") > border) & (F.col("y1") > border) & (F.col("x2") < F.col("width") - border) & (F.col("y2") < F.col("height") - border)
            & wf.between(*fr_range) & hf.between(*fr_range))


def table_like(rel_range=(0.02, 0.75), aspect=(0.4, 3.0), min_side: int = 80) -> Column:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rel = w * h / (F.col("width") * F.col("height"))
    return (w >= min_side) & (h >= min_side) & rel.between(*rel_range) & (w / h).between(*aspect)


def plausible_boxes(boxes: DataFrame, pages: DataFrame | None = None, **limits) -> DataFrame:
    """Boxes of table size that do not touch the page border."""
    return with_page_size(boxes, pages).filter(void_like(**limits)).select(*boxes.columns)


def plausible_table_boxes(boxes: DataFrame, pages: DataFrame | None = None, **limits) -> DataFrame:
    return with_page_size(boxes, pages).filter(table_like(**limits)).select(*boxes.columns)


def plausible_kinds(boxes: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """A row per box and `kind` it is plausible as, void or table, in one pass over the boxes."""
    void, table = F.array(F.lit("void")), F.array(F.lit("table"))
    kinds = F.when(void_like() & table_like(), F.concat(void, table)).when(void_like(), void).when(table_like(), table)
    return with_page_size(boxes, pages).select(F.explode(kinds).alias("kind"), *boxes.columns)


def distinct_boxes(boxes: DataFrame) -> DataFrame:
    """One row per geometry with its first id and number of copies."""
    return boxes.groupBy("page_id", "x1", "y1", "x2", "y2").agg(F.min("box_id").alias("box_id"), F.count("*").alias("copies"))


def iou_pairs(boxes: DataFrame, min_iou: float = 0.0, tile: int = TILE_PX) -> DataFrame:
    """Overlapping pairs of different geometries on a page, found per tile.

    Copies are merged first, and a pair is reported only by the tile that holds
    the corner of its intersection, so far-apart boxes never meet and no pair
    comes twice.
    """
    d = distinct_boxes(boxes)
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    tiled = (d.withColumn("tx", F.explode(span("x1", "x2"))).withColumn("ty", F.explode(span("y1", "y2"))))
    pick = lambda p: tiled.select("page_id", "tx", "ty", *[F.col(c).alias(f"{p}{c}") for c in ("box_id", "x1", "y1", "x2", "y2", "copies")])
    a, b = pick("a_"), pick("b_")
    box = lambda p: F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    home = ((F.floor(F.greatest("a_x1", "b_x1") / tile) == F.col("tx")) & (F.floor(F.greatest("a_y1", "b_y1") / tile) == F.col("ty")))
    meet = ((F.col("a_box_id") < F.col("b_box_id")) & (F.col("a_x1") < F.col("b_x2")) & (F.col("b_x1") < F.col("a_x2"))
            & (F.col("a_y1") < F.col("b_y2")) & (F.col("b_y1") < F.col("a_y2")))
    pairs = a.join(b, ["page_id", "tx", "ty"]).filter(meet & home)
    return (pairs.select("page_id", F.col("a_box_id").alias("box_a"), F.col("b_box_id").alias("box_b"), F.col("a_copies").alias("copies_a"),
                         F.col("b_copies").alias("copies_b"), iou(box("a_"), box("b_")).alias("iou")).filter(F.col("iou") > min_iou))


def box_islands(boxes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Groups of boxes separated by an empty horizontal strip of the page."""
    order = [F.col("y1"), F.col("box_id")]

    def starts(rows: DataFrame, run) -> DataFrame:
        below = run(rows, {"_top": ("max", F.col("y2"), False)})
        return below.withColumn("_s", F.when(F.col("_top").isNull() | (F.col("y1") >= F.col("_top")), 1).otherwise(0).cast("long"))
    return along(boxes, ["page_id"], order, starts, lambda rows, run: run(rows, {"island": ("sum", F.col("_s"), True)}), sizes=sizes).drop("_top", "_s")


def nms_keep_larger(boxes: DataFrame, thr: float = 0.5) -> DataFrame:
    """Greedy suppression: larger boxes first, a box stays while it overlaps no
    kept box by more than `thr`; then reading order.

    Copies are merged and pages cut into islands of overlapping boxes, so the
    fold only ever sees boxes that could suppress each other.
    """
    cut = box_islands(distinct_boxes(boxes), sizes=boxes)
    item = F.struct((-area()).alias("a"), "box_id", "x1", "y1", "x2", "y2")
    folded = cut.groupBy("page_id", "island").agg(F.array_sort(F.collect_list(item)).alias("bs"))

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(b, k) > thr), kept).otherwise(F.concat(kept, F.array(b)))

    empty = F.slice("bs", 1, 0)
    kept = folded.select("page_id", F.explode(F.aggregate("bs", empty, step)).alias("b"))
    rows = kept.select("page_id", "b.box_id", "b.x1", "b.y1", "b.x2", "b.y2")
    return numbered(rows, ["page_id"], [F.col("y1"), F.col("x1"), F.col("box_id")], "seq", sizes=boxes)


def to_page_fraction(boxes: DataFrame, pages: DataFrame | None = None, pad: int = 6) -> DataFrame:
    """Padded and clamped boxes as fractions of their page."""
    w, h = F.col("width"), F.col("height")
    lo = lambda c: F.greatest(F.lit(0), F.col(c) - pad)
    return with_page_size(boxes, pages).select(
        "page_id", "box_id", (lo("x1") / w).alias("fx1"), (lo("y1") / h).alias("fy1"),
        (F.least(w, F.col("x2") + pad) / w).alias("fx2"), (F.least(h, F.col("y2") + pad) / h).alias("fy2"))


def line_gaps(lines: DataFrame) -> DataFrame:
    """Distance to the previous and next ruled line of the page."""
    y = F.col("y_center")
    near = neighbours(lines, ["page_id"], [y, F.col("line_no")], y, prev="_p", nxt="_n")
    return near.withColumns({"prev_gap": y - F.col("_p"), "next_gap": F.col("_n") - y}).drop("_p", "_n")


def gap_lists(lines: DataFrame) -> DataFrame:
    """Sorted gaps between distinct line positions of a page. The list is as
    long as the page has pixel rows at most, however many lines it has."""
    ys = lines.groupBy("page_id", "y_center").agg(F.min("line_no").alias("line_no"))
    return (line_gaps(ys).filter("next_gap IS NOT NULL").groupBy("page_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("y_center", "next_gap"))), lambda g: g["next_gap"]).alias("gaps")))


def has_uniform_run(lines: DataFrame, run_len: int = 20, tol: int = 8) -> DataFrame:
    """Longest run of near-equal gaps per page and whether it is long enough.

    A gap joins the run while it is within `tol` of the running mean and inside
    a window that only shrinks; a gap that does not fit is skipped and the next
    one starts afresh.
    """
    fresh = lambda g, best: F.struct(g.cast("double").alias("total"), F.lit(1).alias("n"), (g - tol).cast("long").alias("lo"),
                                     (g + tol).cast("long").alias("hi"), F.greatest(best, F.lit(1)).alias("best"))

    def step(s: Column, g: Column) -> Column:
        mean = s["total"] / s["n"]
        fits = (F.abs(g - mean) <= tol) & g.between(s["lo"], s["hi"])
        grown = F.struct((s["total"] + g).alias("total"), (s["n"] + 1).alias("n"),
                         F.greatest(s["lo"], (mean - tol).cast("long")).alias("lo"), F.least(s["hi"], (mean + tol).cast("long")).alias("hi"),
                         F.greatest(s["best"], s["n"] + 1).alias("best"))
        empty = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), s["best"].alias("best"))
        return F.when(s["n"] == 0, fresh(g, s["best"])).when(fits, grown).otherwise(empty)

    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(0).alias("best"))
    longest = F.aggregate("gaps", zero, step)["best"]
    return gap_lists(lines).select("page_id", longest.alias("longest_run"), (longest >= run_len).alias("uniform"))


def keep_tables(crops: DataFrame, runs: DataFrame) -> DataFrame:
    return crops.join(runs.filter("uniform").select("page_id"), "page_id", "left_semi")


def merge_row_bands(rows: DataFrame, pages: DataFrame, tol: int = 3, min_cover: float = 0.60) -> DataFrame:
    """Well-covered pixel rows merged to bands with their midpoint."""
    covered = rows.join(pages.select("page_id", "width"), "page_id").filter(F.col("cover") >= F.col("width") * min_cover)
    cut = islands(covered.select("page_id", "y").distinct(), ["page_id"], "y", tol + 1)
    return (cut.groupBy("page_id", "island").agg(F.min("y").alias("y_top"), F.max("y").alias("y_bottom"))
            .withColumn("y_mid", F.floor((F.col("y_top") + F.col("y_bottom")) / 2)).select("page_id", "y_top", "y_bottom", "y_mid"))


def nearest_band(bands: DataFrame, refs: DataFrame, max_delta: int = 80, up_first: bool = True) -> DataFrame:
    """Nearest band at or above the reference line, else the nearest below."""
    y, ref = F.col("y_mid"), F.col("ref_y")
    near = bands.join(refs, "page_id").filter(y.between(ref - max_delta, ref + max_delta))
    out = near.groupBy("page_id").agg(F.max(F.when(y <= ref, y)).alias("above"), F.min(F.when(y > ref, y)).alias("below"))
    pick = F.coalesce("above", "below") if up_first else F.coalesce("below", "above")
    return refs.join(out.select("page_id", pick.alias("band_y")), "page_id", "left")


def next_band_below(bands: DataFrame, refs: DataFrame) -> DataFrame:
    """First band below both `token_y` and `header_y`."""
    cut = F.greatest("token_y", "header_y")
    out = bands.join(refs, "page_id").groupBy("page_id").agg(F.min(F.when(F.col("y_mid") > cut, F.col("y_mid"))).alias("band_y"))
    return refs.join(out, "page_id", "left")


def collapse_near(xs: DataFrame, pos: str, tol: int = 4) -> DataFrame:
    """Positions more than `tol` after the last kept one."""
    return keep_apart(xs, ["page_id"], pos, tol + 1)


def row_centers(borders: DataFrame, min_gap: int = 12, min_dy: int = 8) -> DataFrame:
    """Midpoints between borders at least `min_gap` apart, thinned to `min_dy`."""
    y = F.col("y")
    near = neighbours(borders.select("page_id", "y").distinct(), ["page_id"], [y], y, nxt="_n")
    mids = near.filter(F.col("_n") - y >= min_gap).select("page_id", F.floor((y + F.col("_n")) / 2).alias("center"))
    return keep_apart(mids, ["page_id"], "center", min_dy)


def with_gap(borders: DataFrame) -> DataFrame:
    y = F.col("y")
    return neighbours(borders, ["page_id"], [y], y, nxt="_n").withColumn("gap", F.col("_n") - y).drop("_n")


def median_gap(gapped: DataFrame, name: str = "med") -> DataFrame:
    """Exact median per page; gaps are pixels, so the counts per value that the
    aggregate merges before the shuffle stay few."""
    return gapped.groupBy("page_id").agg(F.percentile("gap", 0.5).alias(name))


def cut_tail_by_gap(borders: DataFrame) -> DataFrame:
    """Borders before the first gap that is far larger than the median, and a
    second, milder cut when at most three borders would be lost."""
    g = with_gap(borders.select("page_id", "y").distinct())
    first = g.join(median_gap(g), "page_id").filter((F.col("med") > 0) & (F.col("gap") > F.greatest(1.9 * F.col("med"), F.col("med") + 18)))
    stop = first.groupBy("page_id").agg(F.min("y").alias("stop"))
    tail = g.join(stop, "page_id", "left").filter(F.col("stop").isNull() | (F.col("y") <= F.col("stop")))
    tail = tail.withColumn("gap", F.when(F.coalesce(F.col("y") != F.col("stop"), F.lit(True)), F.col("gap"))).drop("stop")
    stats = tail.groupBy("page_id").agg(F.percentile("gap", 0.5).alias("med"), F.count("*").alias("n"))
    mild = (tail.join(stats, "page_id").filter((F.col("n") >= 3) & (F.col("med") > 0) & (F.col("gap") >= F.greatest(1.6 * F.col("med"), F.col("med") + 14)))
            .groupBy("page_id").agg(F.min("y").alias("stop2")))
    lost = tail.join(mild, "page_id").groupBy("page_id", "stop2").agg(F.sum(F.when(F.col("y") > F.col("stop2"), 1).otherwise(0)).alias("lost"))
    lost = lost.filter("lost <= 3").select("page_id", "stop2")
    return (tail.join(lost, "page_id", "left").filter(F.col("stop2").isNull() | (F.col("y") <= F.col("stop2"))).select("page_id", "y"))


def longest_cadence_run(lines: DataFrame, min_gap: int = 12, lo: float = 0.60, hi: float = 1.45, window: int = 5) -> DataFrame:
    """Longest run of gaps close to the median of the last five.

    Returns its length and the index of its last gap (from zero), the first
    such run when several are equally long.
    """
    def median(vals: Column) -> Column:
        s, n = F.array_sort(vals), F.size(vals)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2

    state = lambda i, n, last, best, end: F.struct(i.alias("i"), n.alias("n"), last.alias("last"), best.alias("best"), end.alias("end"))

    def step(s: Column, g: Column) -> Column:
        seen = F.concat(s["last"], F.array(g))
        seen = F.slice(seen, F.greatest(F.lit(1), F.size(seen) - window + 1), F.lit(window))
        med = median(seen)
        goes_on = (s["n"] > 0) & (g >= min_gap) & (g >= lo * med) & (g <= hi * med)
        n = F.when(goes_on, s["n"] + 1).when(g >= min_gap, 1).otherwise(0)
        last = F.when(goes_on, seen).when(g >= min_gap, F.array(g)).otherwise(F.slice(seen, 1, 0))
        better = n > s["best"]
        return state(s["i"] + 1, n, last, F.when(better, n).otherwise(s["best"]), F.when(better, s["i"]).otherwise(s["end"]))

    zero = state(F.lit(0), F.lit(0), F.slice("gaps", 1, 0), F.lit(0), F.lit(-1))
    return gap_lists(lines).withColumn("_r", F.aggregate("gaps", zero, step)).select(
        "page_id", F.col("_r.best").alias("run_len"), F.col("_r.end").alias("run_end"))


def insert_missing_border(borders: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds the border that must lie between header line and first border."""
    g = with_gap(borders.select("page_id", "y").distinct())
    page = g.groupBy("page_id").agg(F.percentile("gap", 0.5).alias("med"), F.min("y").alias("first"), F.count("*").alias("n"))
    head, med = F.col("header_y"), F.col("med")
    d0, want = F.col("first") - head, F.bround(head + med).cast("long")
    ok = ((F.col("n") >= 2) & (med > 0) & (d0 > F.greatest(1.8 * med, med + 16)) & (d0 < 3.2 * med)
          & (want < F.col("first") - 8) & (want > head + 6))
    added = page.join(refs, "page_id").filter(ok).select("page_id", want.alias("y"))
    return (borders.select("page_id", "y").withColumn("inserted", F.lit(False))
            .unionByName(added.withColumn("inserted", F.lit(True))))


def spaces_from_rows(borders: DataFrame, refs: DataFrame) -> DataFrame:
    """Circuit spaces per page: two per row, snapped to a real size, with the
    footer line moved by the rows gained or lost."""
    b = borders.select("page_id", "y").distinct()
    centers = row_centers(b).groupBy("page_id").agg(F.count("*").alias("rows"), F.max("center").alias("last_center"))
    page = with_gap(b).groupBy("page_id").agg(F.percentile("gap", 0.5).alias("med"), F.max("y").alias("footer"))
    df = page.join(centers, "page_id", "left").join(refs, "page_id")
    df = df.withColumns({"detected": (F.coalesce("rows", F.lit(0)) * 2).cast("int"), "footer": F.when(F.col("footer") > F.col("header_y") + 6, F.col("footer")),
                         "med": F.coalesce("med", F.lit(18.0))})
    target = snap_spaces(F.col("detected"))
    delta = ((target - F.col("detected")) / 2).cast("int")
    moved = F.least(F.col("height") - 5, F.greatest(F.col("header_y") + 8, F.col("footer") + F.bround(delta * F.col("med")).cast("long")))
    floor_y = F.col("last_center") + 0.5 * F.col("med")
    moved = F.when(F.col("last_center").isNotNull() & (moved < floor_y), floor_y.cast("long")).otherwise(moved)
    snap = F.col("footer").isNotNull() & (target != F.col("detected")) & (F.col("med") > 0)
    return df.select("page_id", "detected", F.when(snap, target).otherwise(F.col("detected")).alias("spaces"), snap.alias("snapped"),
                     F.when(snap, moved).otherwise(F.col("footer")).alias("footer_y"))


def filter_peripheral(values: DataFrame, pages: DataFrame | None = None, x_frac: float = 0.12, y_frac: float = 0.0) -> DataFrame:
    """Detections that stay clear of the crop edge."""
    mx, my = F.bround(F.col("width") * x_frac).cast("long"), F.bround(F.col("height") * y_frac).cast("long")
    ok = ((F.col("x1") >= mx) & (F.col("x2") <= F.col("width") - mx) & (F.col("y1") >= my) & (F.col("y2") <= F.col("height") - my))
    return with_page_size(values, pages).filter(ok).select(*values.columns)


def middle_medians(feats: DataFrame, features: list[str]) -> DataFrame:
    """Median of the middle half of each integer feature per page.

    The features become value counts, so a page with very many blobs is reduced
    before anything is ordered.
    """
    long = feats.select("page_id", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("long").alias("v")) for f in features])).alias("x"))
    counts = long.groupBy("page_id", "x.f", "x.v").agg(F.count("*").alias("c"))
    total = counts.groupBy("page_id", "f").agg(F.sum("c").alias("n"))
    cum = running(counts, ["page_id", "f"], [F.col("v")], {"upto": ("sum", F.col("c"), True)}).join(total, ["page_id", "f"])
    a = F.floor(0.25 * F.col("n"))
    m = F.greatest(a + 1, F.floor(0.75 * F.col("n"))) - a
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    med = cum.groupBy("page_id", "f").agg(((at(a + F.floor((m - 1) / 2)) + at(a + F.floor(m / 2))) / 2).alias("med"))
    return med.groupBy("page_id").agg(*[F.max(F.when(F.col("f") == f, F.col("med"))).alias(f"med_{f}") for f in features])


def robust_blob_filter(feats: DataFrame, h_min: float = 0.55, area_min: float = 0.50, ink_min: float = 0.45, aspect=(1.2, 6.0),
                       hx_soft: int = 830, ink_gate: int = 120) -> DataFrame:
    """Blobs that are not much smaller or lighter than the typical digit.

    Features are integers; `ink` and `hx` in thousandths.
    """
    med = middle_medians(feats, ["h", "area", "ink"])
    ar = F.col("h") / F.col("w")
    ok = ((F.col("h") >= F.greatest(F.lit(1.0), h_min * F.col("med_h"))) & (F.col("area") >= F.greatest(F.lit(4.0), area_min * F.col("med_area")))
          & (F.col("ink") >= ink_min * F.col("med_ink")) & ar.between(*aspect) & ~((F.col("hx") >= hx_soft) & (F.col("ink") <= ink_gate)))
    return feats.join(med, "page_id").filter(ok).select(*feats.columns)


def row_boxes(centers: DataFrame, refs: DataFrame) -> DataFrame:
    """Vertical extent of each row: halfway to its neighbours, the ends mirrored,
    inside header and footer."""
    c = F.col("center")
    near = neighbours(centers.select("page_id", "center").distinct(), ["page_id"], [c], c, prev="_p", nxt="_n").join(refs, "page_id")
    p, n = F.col("_p"), F.col("_n")
    up = F.coalesce(F.floor((p + c) / 2), (c - (n - c) / 2).cast("long"), F.greatest(F.lit(0), c - 10))
    down = F.coalesce(F.floor((c + n) / 2), (c + (c - p) / 2).cast("long"), F.least(F.col("height") - 1, c + 10))
    y1 = F.greatest(F.greatest(F.lit(0), F.col("header_y")) + 6, up + 1)
    y2 = F.least(F.least(F.col("height") - 1, F.col("footer_y") - 6), down - 1)
    return near.select("page_id", "center", y1.alias("y1"), y2.alias("y2")).filter(F.col("y2") - F.col("y1") >= 10)


def top_row_spans(centers: DataFrame, refs: DataFrame, frac: float = 0.70) -> DataFrame:
    """Two reading spans right under the header line."""
    gaps = with_gap(centers.select("page_id", F.col("center").alias("y")).distinct())
    med = refs.join(median_gap(gaps), "page_id", "left").withColumn(
        "med", F.when(F.col("med") > 0, F.col("med")).otherwise(F.greatest(F.lit(18.0), 0.032 * F.col("height"))))
    head, foot, h = F.col("header_y"), F.col("footer_y"), F.col("height")
    span = F.greatest(F.lit(6), (frac * F.col("med")).cast("long"))

    def clamp(a: Column, b: Column) -> Column:
        y1 = F.greatest(F.lit(0), F.least(h - 2, a))
        y2 = F.greatest(y1 + 1, F.least(h - 1, b))
        y1, y2 = F.greatest(y1, head + 2), F.least(y2, foot - 1)
        return F.when(y2 - y1 >= 6, F.struct(y1.alias("y1"), y2.alias("y2")))

    df = med.withColumn("_r1", clamp(head + 3, head + span))
    df = df.withColumn("_r2", F.when(F.col("_r1").isNotNull(), clamp(F.col("_r1.y2") + 1, F.col("_r1.y2") + 1 + span)))
    wide = clamp(head + 3, F.least(foot - 1, head + (1.4 * F.col("med")).cast("long")))
    spans = F.when(F.coalesce("_r1", "_r2").isNotNull(), F.array("_r1", "_r2")).otherwise(F.array(wide))
    return (df.select("page_id", F.posexplode(spans).alias("row", "s")).filter("s IS NOT NULL")
            .select("page_id", "row", "s.y1", "s.y2"))


def split_multi_table_crops(crops: DataFrame, boxes: DataFrame, pad: int = 6) -> DataFrame:
    """A crop with several table boxes becomes one padded child per box."""
    n = boxes.groupBy("page_id").agg(F.count("*").alias("n"))
    info = crops.join(n, "page_id", "left")
    single = info.filter(F.coalesce("n", F.lit(0)) <= 1).select(
        "page_id", F.col("name").alias("name"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("y1"), F.col("width").alias("x2"), F.col("height").alias("y2"))
    seq = numbered(boxes, ["page_id"], [F.col("y1"), F.col("x1"), F.col("box_id")], "seq")
    many = seq.join(info.filter("n > 1"), "page_id").select(
        "page_id", F.concat("name", F.lit("__tbl"), F.format_string("%02d", "seq")).alias("name"),
        F.greatest(F.lit(0), F.col("x1") - pad).alias("x1"), F.greatest(F.lit(0), F.col("y1") - pad).alias("y1"),
        F.least("width", F.col("x2") + pad).alias("x2"), F.least("height", F.col("y2") + pad).alias("y2"))
    return single.unionByName(many)


def nearest_line(segments: DataFrame, refs: DataFrame, search: int = 160, min_width: float = 0.25, max_thick: int = 6) -> DataFrame:
    """Segment nearest to the reference line, above before below at the same
    distance; if none is wide and thin enough, the strongest one in reach."""
    y, ref = F.col("y_center"), F.col("ref_y")
    w = F.col("x_right") - F.col("x_left") + 1
    near = segments.join(refs, "page_id").filter(F.abs(y - ref) <= search)
    good = (w >= F.bround(F.col("width") * min_width)) & (F.col("thickness") <= max_thick)
    out = near.groupBy("page_id").agg(
        F.min(F.when(good, F.struct(F.abs(y - ref).alias("d"), F.when(y <= ref, 0).otherwise(1).alias("side"), y.alias("y")))).alias("best"),
        F.min(F.struct((-w).alias("w"), y.alias("y"))).alias("strong"))
    return refs.join(out, "page_id", "left").select(*refs.columns, F.coalesce("best.y", "strong.y").alias("line_y"),
                                                    F.col("best").isNotNull().alias("clean"))
