"""Tokens to lines, columns and header roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.functions.similarity import header_facts, role_scores
from drawbom.functions.text import fix_header_typos, is_header_word, norm_header_text
from drawbom.operators.geometry import iou
from drawbom.operators.spread import along, any_of, by_size, first_per, held, near_by, neighbours, numbered, running, top_per

# Fixed values -------------------------------------------------------------
TRIP_RX = r"(?i)\b(TRIP|AMP|AMPS|BREAKER|BKR|SIZE|\(A\))\b"
POLES_RX = r"(?i)\b(POLES?|P|\(P\))\b"
CATEGORY_ALIASES = {
    "ckt": ["CKT", "CCT"],
    "description": ["CIRCUITDESCRIPTION", "DESCRIPTION", "LOADDESCRIPTION", "DESIGNATION", "LOADDESIGNATION", "NAME"],
    "trip": ["TRIP", "AMPS", "AMP", "BREAKER", "BKR", "SIZE"],
    "poles": ["POLES", "POLE"],
}
NOT_A_HEADER = ["LOADCLASSIFICATION", "CLASSIFICATION"]
FOOTER_VALUES = [17, 18, 29, 30, 41, 42, 53, 54, 65, 66, 71, 72, 83, 84]
FALLBACK_FRACTIONS = {"L_TRIP": (0.260, 0.300), "L_POLES": (0.305, 0.335), "R_POLES": (0.655, 0.690), "R_TRIP": (0.695, 0.735)}
CKT_WINDOWS = [(0.08, 0.48, 0.28), (0.10, 0.50, 0.32), (0.08, 0.52, 0.40), (0.12, 0.58, 0.45),
               (0.08, 0.52, 0.65), (0.10, 0.56, 0.80), (0.08, 0.60, 1.00)]
# CCT or CKT as all the letters of a text, or within them; a 1 is read as an I
CKT_ALONE = r"^[^A-Z1]*C[^A-Z1]*[CK][^A-Z1]*T[^A-Z1]*\z"
CKT_WITHIN = r"C[^A-Z1]*[CK][^A-Z1]*T"
# --------------------------------------------------------------------------


def strips(df: DataFrame, keys: list[str], order: list[Column], reach_end: Column, reach_start: Column, sizes: DataFrame | None = None) -> DataFrame:
    """Number stretches that no later row can reach back across.

    A cut lies before a row when everything earlier ends below what this and
    every later row can still touch: prefix maximum of `reach_end` under suffix
    minimum of `reach_start`.
    """
    def starts(rows: DataFrame, run) -> DataFrame:
        both = run(rows, {"_end": ("max", reach_end, False), "_from": ("min_ahead", reach_start, True)})
        return both.withColumn("_s", F.when(F.col("_end").isNull() | (F.col("_end") < F.col("_from")), 1).otherwise(0).cast("long"))
    cut = along(df, keys, order, starts, lambda rows, run: run(rows, {"strip": ("sum", F.col("_s"), True)}), sizes=sizes)
    return cut.drop("_end", "_from", "_s")


def top_of_pages(tokens: DataFrame, lines: int) -> DataFrame:
    """The tokens that can lie in the first `lines` lines of `assign_lines`, with all that can
    share a line with them.

    Each strip holds a line at least and lies above the next, so the first `lines` strips of a
    page hold them. Strips follow from distinct vertical extents, whose number the raster bounds.
    """
    cy2, h = F.col("y1") + F.col("y2"), F.col("y2") - F.col("y1")
    extents = tokens.select("page_id", "y1", "y2").distinct()
    cut = strips(extents, ["page_id"], [cy2, F.col("y1")], F.col("y2").cast("double"), cy2 / 2 - 0.6 * h, sizes=tokens)
    last = cut.filter(F.col("strip") <= lines).groupBy("page_id").agg(F.max(cy2).alias("_last"))
    return tokens.join(last, "page_id").filter(cy2 <= F.col("_last")).drop("_last")


def assign_lines(tokens: DataFrame) -> DataFrame:
    """Adds `line_no`: a token joins the first line whose centre is near enough,
    measured by the smaller height, and the line grows to hold it.

    Needs `pos`. Strips of the page that cannot interact are folded apart.
    """
    cy2, h = F.col("y1") + F.col("y2"), F.col("y2") - F.col("y1")
    t = tokens.select("page_id", "pos", "x1", "y1", "x2", "y2")
    cut = strips(t, ["page_id"], [cy2, F.col("x1"), F.col("pos")], F.col("y2").cast("double"), cy2 / 2 - 0.6 * h)
    item = F.struct(cy2.alias("c"), "x1", "pos", "y1", "y2")
    facts = {"_c": (F.min(cy2), F.max(cy2)), "_h": (F.min(h), F.max(h)), "_y": (F.min("y1"), F.max("y2"))}
    grouped = cut.groupBy("page_id", "strip").agg(F.sort_array(F.collect_list(item)).alias("ts"), *[F.struct(lo.alias("lo"), hi.alias("hi")).alias(n) for n, (lo, hi) in facts.items()])
    line = lambda y1, y2: F.struct(y1.alias("y1"), y2.alias("y2"))

    def step(s: Column, t: Column) -> Column:
        near = F.transform(s["lines"], lambda l: F.abs(t["c"] - (l["y1"] + l["y2"])) <= 1.2 * F.greatest(
            F.lit(1), F.least(l["y2"] - l["y1"], t["y2"] - t["y1"])))
        at = F.array_position(near, True)
        grown = F.transform(s["lines"], lambda l, i: F.when(i + 1 == at, line(F.least(l["y1"], t["y1"]), F.greatest(l["y2"], t["y2"]))).otherwise(l))
        return F.when(at > 0, F.struct(grown.alias("lines"), F.concat(s["at"], F.array(at)).alias("at"))).otherwise(
            F.struct(F.concat(s["lines"], F.array(line(t["y1"], t["y2"]))).alias("lines"),
                     F.concat(s["at"], F.array((F.size(s["lines"]) + 1).cast("long"))).alias("at")))

    start = F.struct(F.transform(F.slice("ts", 1, 0), lambda t: line(t["y1"], t["y2"])).alias("lines"),
                     F.transform(F.slice("ts", 1, 0), lambda t: t["pos"].cast("long")).alias("at"))
    # boxes of one height are one line where no two centres are farther apart than one box reaches
    single = (F.col("_h.lo") == F.col("_h.hi")) & (F.col("_c.hi") - F.col("_c.lo") <= 1.2 * F.greatest(F.lit(1), F.col("_h.lo")))
    alone = F.struct(F.array(line(F.col("_y.lo"), F.col("_y.hi"))).alias("lines"), F.transform("ts", lambda t: F.lit(1).cast("long")).alias("at"))
    folded = grouped.withColumn("_f", F.when(single, alone).otherwise(F.aggregate("ts", start, step)))
    tops = F.transform("_f.at", lambda at: F.get(F.col("_f.lines"), (at - 1).cast("int"))["y1"])
    placed = folded.select("page_id", "strip", F.explode(F.arrays_zip(F.col("ts.pos").alias("pos"), F.col("_f.at").alias("at"), tops.alias("top"))).alias("z"))

    def starts(rows: DataFrame, run) -> DataFrame:
        return near_by(F.struct("strip", "at"), prev="_p")(rows, run).withColumn("_s", F.when(F.col("_p") == F.struct("strip", "at"), 0).otherwise(1).cast("long"))
    lines = along(placed.select("page_id", "strip", "z.*"), ["page_id"], [F.col("top"), F.col("strip"), F.col("at"), F.col("pos")],
                  starts, lambda rows, run: run(rows, {"line_no": ("sum", F.col("_s"), True)}), sizes=tokens)
    return lines.select("page_id", "pos", "line_no")


def first_lines(tokens: DataFrame, n: int = 15) -> DataFrame:
    """Tokens of the first `n` lines of each page; needs `line_no`."""
    lines = top_per(tokens.select("page_id", "line_no").distinct(), ["page_id"], [F.col("line_no")], n)
    return tokens.join(lines, ["page_id", "line_no"], "left_semi")


def dedup_tokens(tokens: DataFrame, thr: float = 0.80) -> DataFrame:
    """Near copies of a text at one place: the most confident one stays, then
    the larger one. Exact copies are merged before anything is folded. Rows travel
    whole, so each needs a `pos` of its own on its page."""
    t = tokens.withColumn("_norm", norm_header_text(F.col("text")))
    best = first_per(t, ["page_id", "_norm", "x1", "y1", "x2", "y2"], [F.col("conf").desc(), F.col("pos")])
    keys = ["page_id", "_norm"]

    def starts(rows: DataFrame, run) -> DataFrame:
        # in the order of upper edges no later row reaches above this one
        return run(rows, {"_end": ("max", F.col("y2"), False)}).withColumn("_s", F.when(F.col("_end").isNull() | (F.col("_end") < F.col("y1")), 1).otherwise(0).cast("long"))
    cut = along(best, keys, [F.col("y1"), F.col("pos")], starts, lambda rows, run: run(rows, {"strip": ("sum", F.col("_s"), True)}), sizes=tokens)
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    places = ["pos", "x1", "y1", "x2", "y2"]
    item = F.struct((-F.col("conf")).alias("_c"), (-size).alias("_a"), *places, *[c for c in tokens.columns if c not in ["page_id", *places]])
    folded = cut.groupBy(*keys, "strip").agg(F.sort_array(F.collect_list(item)).alias("bs"))
    near = lambda a, b: iou(a, b) >= thr

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: near(k, b)), kept).otherwise(F.concat(kept, F.array(b)))

    one, two = F.get("bs", F.lit(0)), F.get("bs", F.lit(1))
    kept = folded.select("page_id", F.explode(F.when(F.size("bs") == 1, F.col("bs")).when(F.size("bs") == 2, F.when(near(one, two), F.array(one)).otherwise(F.col("bs")))
                                              .otherwise(F.aggregate("bs", F.slice("bs", 1, 0), step))).alias("k"))
    return kept.select(*[F.col(c if c == "page_id" else f"k.{c}") for c in tokens.columns])


def dedup_adjacent(cands: DataFrame, keys: list[str], dx: int = 18) -> DataFrame:
    """Of neighbouring candidates with one text and nearly one centre, the more
    confident stays. Only unbroken runs of one text are folded; rows travel whole, so
    the candidates are shuffled once. Needs a `pos` of its own for each candidate of a key."""
    order = [F.col("y1"), F.col("x1"), F.col("pos")]

    def starts(rows: DataFrame, run) -> DataFrame:
        near = near_by(F.col("text"), prev="_pt")(rows, run)
        return near.withColumn("_s", F.when(F.col("_pt").isNull() | (F.col("_pt") != F.col("text")), 1).otherwise(0).cast("long"))
    runs = along(cands, keys, order, starts, lambda rows, run: run(rows, {"run": ("sum", F.col("_s"), True)}), sizes=cands)
    rest = [c for c in cands.columns if c not in [*keys, "y1", "x1", "pos"]]
    item = F.struct("y1", "x1", "pos", (F.col("x1") + F.col("x2")).alias("xc2"), *rest)
    folded = runs.groupBy(*keys, "run").agg(F.sort_array(F.collect_list(item)).alias("cs"))
    near = lambda c, last: F.abs(c["xc2"] - last["xc2"]) < 2 * dx

    def step(acc: Column, c: Column) -> Column:
        last = F.element_at(acc, -1)
        close = near(c, last)
        return (F.when(~close, F.concat(acc, F.array(c)))
                .when(c["conf"] > last["conf"], F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(c))).otherwise(acc))

    later = F.slice("cs", F.lit(2), F.greatest(F.size("cs") - 1, F.lit(0)))
    one, two = F.get("cs", F.lit(0)), F.get("cs", F.lit(1))
    pair = F.when(~near(two, one), F.col("cs")).when(two["conf"] > one["conf"], F.array(two)).otherwise(F.array(one))
    kept = folded.select(*keys, F.explode(F.when(F.size("cs") == 1, F.col("cs")).when(F.size("cs") == 2, pair)
                                          .otherwise(F.aggregate(later, F.slice("cs", 1, 1), step))).alias("k"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"k.{c}") for c in cands.columns])


def plumbline_columns(tokens: DataFrame, keys: list[str], eps: int = 3) -> DataFrame:
    """Adds `column`: left to right, a free token drops a line through its
    centre and takes every free token that line crosses.

    A token therefore belongs to the first seed whose centre it spans. Distinct
    horizontal extents decide that, so a fold never exceeds the page width. Tokens
    travel whole with their strip; those of very large keys meet their extents again.
    """
    c2 = F.col("x1") + F.col("x2")
    order = [c2, F.col("x1"), F.col("x2")]
    extent = lambda t: F.struct((t["x1"] + t["x2"]).alias("c2"), t["x1"].alias("x1"), t["x2"].alias("x2"))

    def stripped(rows: DataFrame) -> DataFrame:
        return strips(rows, keys, order, c2 / 2, (F.col("x1") - eps).cast("double"), sizes=tokens)

    def step(s: Column, t: Column) -> Column:
        at = F.array_position(F.transform(s["seeds"], lambda c: c.between(2 * (t["x1"] - eps), 2 * (t["x2"] + eps))), True)
        return F.when(at > 0, F.struct(s["seeds"].alias("seeds"), F.concat(s["at"], F.array(F.get(s["seeds"], (at - 1).cast("int")))).alias("at"))).otherwise(
            F.struct(F.concat(s["seeds"], F.array(t["c2"])).alias("seeds"), F.concat(s["at"], F.array(t["c2"])).alias("at")))

    none = F.transform(F.slice("xs", 1, 0), lambda t: t["c2"])
    one, two = F.get("xs", F.lit(0)), F.get("xs", F.lit(1))
    pair = F.array(one["c2"], F.when(one["c2"].between(2 * (two["x1"] - eps), 2 * (two["x2"] + eps)), one["c2"]).otherwise(two["c2"]))
    seeds = (F.when(F.size("xs") == 1, F.array(one["c2"])).when(F.size("xs") == 2, pair)
             .otherwise(F.aggregate("xs", F.struct(none.alias("seeds"), none.alias("at")), step)["at"]))

    def numbered_seeds(placed: DataFrame) -> DataFrame:
        def starts(rows: DataFrame, run) -> DataFrame:
            return near_by(F.col("seed"), prev="_p")(rows, run).withColumn("_s", F.when(F.col("_p") == F.col("seed"), 0).otherwise(1).cast("long"))
        return along(placed, keys, [F.col("seed"), F.col("x1"), F.col("x2")], starts, lambda rows, run: run(rows, {"column": ("sum", F.col("_s"), True)}), sizes=tokens)

    def whole(part: DataFrame) -> DataFrame:
        ts = stripped(part).groupBy(*keys, "strip").agg(F.collect_list(F.struct(*[c for c in part.columns if c not in keys])).alias("ts"))
        xs = ts.withColumn("xs", F.sort_array(F.array_distinct(F.transform("ts", extent)))).withColumn("_at", seeds)
        met = F.transform("ts", lambda t: F.struct(t.alias("t"), F.get("_at", (F.array_position("xs", extent(t)) - 1).cast("int")).alias("seed")))
        placed = xs.select(*keys, F.explode(met).alias("z")).select(*keys, "z.t.*", "z.seed")
        return numbered_seeds(placed).select(*part.columns, "column")

    def by_extent(part: DataFrame, _: int) -> DataFrame:
        grouped = stripped(part.select(*keys, "x1", "x2").distinct()).groupBy(*keys, "strip").agg(F.sort_array(F.collect_list(F.struct(c2.alias("c2"), "x1", "x2"))).alias("xs"))
        placed = grouped.select(*keys, F.explode(F.arrays_zip(F.col("xs.x1").alias("x1"), F.col("xs.x2").alias("x2"), seeds.alias("seed"))).alias("z")).select(*keys, "z.*")
        return part.join(numbered_seeds(placed).select(*keys, "x1", "x2", "column"), [*keys, "x1", "x2"]).select(*part.columns, "column")
    return by_size(tokens, keys, whole, by_extent)


def band_list(bands: DataFrame) -> DataFrame:
    """Bands of a page as one sorted list. Distinct pixel extents, so the list
    is bounded by the page width."""
    return bands.select("page_id", "a", "b").distinct().groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.struct("a", "b"))).alias("bands"))


def band_at(bands: Column, x: Column) -> Column:
    """Index from one of the first band holding x, else of the nearest centre."""
    holds = F.array_position(F.transform(bands, lambda s: x.between(s["a"], s["b"])), True)
    near = F.array_min(F.transform(bands, lambda s, i: F.struct(F.abs((s["a"] + s["b"]) / 2 - x).alias("d"), (i + 1).alias("i"))))["i"]
    return F.when(F.size(bands) > 0, F.when(holds > 0, holds.cast("int")).otherwise(near))


def assign_band(tokens: DataFrame, bands: DataFrame) -> DataFrame:
    x = (F.col("x1") + F.col("x2")) / 2
    return tokens.join(band_list(bands), "page_id").withColumn("band", band_at(F.col("bands"), x)).drop("bands")


def split_wide_gaps(tokens: DataFrame, keys: list[str], mult: float = 2.6, min_px: int = 32) -> DataFrame:
    """Adds `segment`: a group breaks where the gap is far wider than its words."""
    width = F.greatest(F.lit(1), F.col("x2") - F.col("x1"))
    upper = F.expr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -_w)")
    med = tokens.withColumn("_w", width).groupBy(*keys).agg(upper.alias("_m"))
    wide = F.col("x1") - F.col("_px") > F.greatest(F.lit(min_px), F.bround(mult * F.col("_m")).cast("long"))

    def starts(rows: DataFrame, run) -> DataFrame:
        return near_by(F.col("x2"), prev="_px")(rows, run).withColumn("_s", F.when(F.col("_px").isNull() | wide, 1).otherwise(0).cast("long"))
    cut = along(tokens.join(med, keys), keys, [F.col("x1"), F.col("pos")], starts, lambda rows, run: run(rows, {"segment": ("sum", F.col("_s"), True)}), sizes=tokens)
    return cut.drop("_px", "_m", "_s")


def cluster_by_row(tokens: DataFrame, x_gap: int = 36, y_overlap: float = 0.35) -> DataFrame:
    """Header words merged to labels: a word joins the open label when it starts
    near its end and overlaps its row; the row narrows to what all share."""
    order = [F.col("y1"), F.col("x1"), F.col("pos")]
    cut = strips(tokens.select("page_id", "pos", "text", "conf", "x1", "y1", "x2", "y2"), ["page_id"], order,
                 F.col("y2") - 0.5, F.col("y1").cast("double"))
    item = F.struct("y1", "x1", "pos", "x2", "y2", "text", "conf")
    grouped = cut.groupBy("page_id", "strip").agg(F.array_sort(F.collect_list(item)).alias("ts"))
    open_ = lambda t: F.struct(t["x1"].alias("x1"), t["y1"].alias("y1"), t["x2"].alias("x2"), t["y2"].alias("y2"), t["y1"].alias("fy1"), t["y2"].alias("fy2"),
                               t["text"].alias("text"), t["conf"].alias("conf"), F.lit(1).alias("words"))

    def step(acc: Column, t: Column) -> Column:
        c = F.element_at(acc, -1)
        inter = F.greatest(F.lit(0), F.least(c["y2"], t["y2"]) - F.greatest(c["y1"], t["y1"]))
        share = inter / F.greatest(F.lit(1), F.least(c["y2"] - c["y1"], t["y2"] - t["y1"]))
        y1, y2 = F.greatest(c["y1"], t["y1"]), F.least(c["y2"], t["y2"])
        gone = y2 <= y1
        grown = F.struct(c["x1"].alias("x1"), F.when(gone, F.least(c["fy1"], t["y1"])).otherwise(y1).alias("y1"), F.greatest(c["x2"], t["x2"]).alias("x2"),
                         F.when(gone, F.greatest(c["fy2"], t["y2"])).otherwise(y2).alias("y2"), c["fy1"].alias("fy1"), c["fy2"].alias("fy2"),
                         F.concat_ws(" ", c["text"], t["text"]).alias("text"), F.greatest(c["conf"], t["conf"]).alias("conf"), (c["words"] + 1).alias("words"))
        return F.when((t["x1"] - c["x2"] <= x_gap) & (share >= y_overlap), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(
            F.concat(acc, F.array(open_(t))))

    rest = F.slice("ts", F.lit(2), F.greatest(F.size("ts") - 1, F.lit(0)))
    folded = F.aggregate(rest, F.transform(F.slice("ts", 1, 1), open_), step)
    return grouped.select("page_id", F.explode(folded).alias("c")).select("page_id", "c.x1", "c.y1", "c.x2", "c.y2", "c.text", "c.conf", "c.words")


def split_header_rows(tokens: DataFrame, rounds: int = 12) -> DataFrame:
    """Threshold between header row and the rest: two means on the vertical
    centre. Each page arrives as counts per distinct centre, whose number the
    raster height bounds."""
    counts = tokens.groupBy("page_id", ((F.col("y1") + F.col("y2")) / 2).alias("y")).agg(F.count("*").alias("n"))
    pages = counts.groupBy("page_id").agg(F.collect_list(F.struct("y", "n")).alias("ys"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    means = lambda c1, c2, done: F.struct(c1.alias("c1"), c2.alias("c2"), done.alias("done"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("s1", "n1", "s2", "n2")])

    def halves(s: Column) -> Column:
        """Sums and counts of the centres nearer to the first mean, and of the others."""
        def add(acc: Column, t: Column) -> Column:
            first = (F.abs(t["y"] - s["c1"]) <= F.abs(t["y"] - s["c2"])).cast("double")
            return F.struct((acc["s1"] + first * t["y"] * t["n"]).alias("s1"), (acc["n1"] + first * t["n"]).alias("n1"),
                            (acc["s2"] + (1 - first) * t["y"] * t["n"]).alias("s2"), (acc["n2"] + (1 - first) * t["n"]).alias("n2"))
        return F.aggregate("ys", zero, add)

    def step(s: Column, _: Column) -> Column:
        def move(h: Column) -> Column:
            m1, m2 = F.try_divide(h["s1"], h["n1"]), F.try_divide(h["s2"], h["n2"])
            still = (F.abs(m1 - s["c1"]) < 0.5) & (F.abs(m2 - s["c2"]) < 0.5)
            return F.when((h["n1"] > 0) & (h["n2"] > 0), means(m1, m2, still)).otherwise(means(s["c1"], s["c2"], F.lit(True)))
        return F.when(s["done"], s).otherwise(F.transform(F.array(halves(s)), move)[0])

    span = F.col("hi") - F.col("lo")
    start = means(F.col("lo") + 0.25 * span, F.col("lo") + 0.75 * span, F.lit(False))
    split = pages.withColumn("m", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    return split.select("page_id", F.when(span > 0, 0.5 * (F.col("m.c1") + F.col("m.c2"))).otherwise(F.col("lo") + 1).alias("threshold"),
                        F.when(span > 0, F.least("m.c1", "m.c2")).otherwise(F.col("lo")).alias("top_mean"))


def header_y_by_band(tokens: DataFrame, pages: DataFrame, band: int = 16, max_rel: float = 0.65) -> DataFrame:
    """Top of the horizontal band with most header words, first band on ties."""
    cy = F.floor((F.col("y1") + F.col("y2")) / 2)
    per = (tokens.groupBy("page_id", F.floor(cy / band).alias("bin")).agg(
        F.sum(is_header_word(F.col("text")).cast("int")).alias("score"), F.min("pos").alias("seen"), F.min("y1").alias("top")))
    best = per.filter("score > 0").groupBy("page_id").agg(F.max_by("top", F.struct("score", -F.col("seen"))).alias("header_y"))
    ok = F.col("header_y") <= F.floor(max_rel * F.col("height"))
    return best.join(pages.select("page_id", "height"), "page_id").filter(ok).select("page_id", "header_y")


def rule_below(bins: DataFrame, lines: DataFrame, y: str, up: int = 6, down: int = 28, step: int = 14) -> DataFrame:
    """Rows that have a ruled line in [y-up, y+down), met per small cell."""
    cells = F.sequence(F.floor((F.col(y) - up) / step), F.floor((F.col(y) + down - 1) / step))
    want = bins.withColumn("_c", F.explode(cells))
    have = lines.select("page_id", "y_center").distinct().withColumn("_c", F.floor(F.col("y_center") / step))
    hit = want.join(have, ["page_id", "_c"]).filter((F.col("y_center") >= F.col(y) - up) & (F.col("y_center") < F.col(y) + down))
    return bins.join(hit.select("page_id", y).distinct(), ["page_id", y], "left_semi")


def header_y_by_categories(tokens: DataFrame, pages: DataFrame, lines: DataFrame, bin_px: int = 14, min_score: int = 3) -> DataFrame:
    """Header line from the number of distinct header categories in a bin."""
    n = F.regexp_replace(F.translate(F.upper("text"), "10", "IO"), "[^A-Z0-9]", "")
    t = tokens.join(pages.select("page_id", "width", "height"), "page_id").filter(
        F.col("y1").between(F.floor(0.08 * F.col("height")), F.floor(0.65 * F.col("height"))))
    has = {c: n.rlike("|".join(a)) | ((n == "P") if c == "poles" else F.lit(False)) for c, a in CATEGORY_ALIASES.items()}
    left = (F.col("x1") + F.col("x2")) / 2 < F.col("width") * 0.5
    any_cat = has["ckt"] | has["description"] | has["trip"] | has["poles"]
    per = t.groupBy("page_id", (F.floor(F.col("y1") / bin_px) * bin_px).alias("bin")).agg(
        *[F.bool_or(h).alias(c) for c, h in has.items()], F.bool_or(any_cat & left).alias("l"), F.bool_or(any_cat & ~left).alias("r"),
        F.bool_or(n.rlike("|".join(NOT_A_HEADER))).alias("bad"))
    cats = sum((F.col(c).cast("int") for c in CATEGORY_ALIASES), F.lit(0))
    score = cats + (F.col("l") & F.col("r")).cast("int") + (cats >= 2).cast("int")
    good = per.filter(~F.col("bad")).select("page_id", "bin", score.alias("score")).filter(F.col("score") >= min_score)
    return (rule_below(good, lines, "bin").groupBy("page_id")
            .agg(F.max(F.struct("score", (-F.col("bin")).alias("b"))).alias("m")).select("page_id", (-F.col("m.b")).alias("header_y"), "m.score"))


def split_glued(tokens: DataFrame) -> DataFrame:
    """Glued labels as words, their box sliced evenly."""
    by_delim = F.split("text", r"[ \t_/:-]+")
    by_class = F.regexp_extract_all("text", F.lit(r"[A-Za-z]+|\([A-Za-z]+\)|[0-9]+|[^\sA-Za-z0-9]+"), F.lit(0))
    parts = F.when(F.size(by_delim) > 1, by_delim).when(F.size(by_class) > 1, by_class).otherwise(F.array("text"))
    df = tokens.withColumn("_n", F.size(parts)).select("*", F.posexplode(parts).alias("part", "word"))
    step = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.col("x2") - F.col("x1") + 1) / F.col("_n")))
    a = F.col("x1") + F.col("part") * step
    return df.select("page_id", "pos", "part", "word", a.alias("x1"),
                     F.when(F.col("part") == F.col("_n") - 1, F.col("x2")).otherwise(a + step - 1).alias("x2"))


def explode_multi_role(tokens: DataFrame) -> DataFrame:
    """A token naming both trip and poles becomes one row for each."""
    both = F.col("text").rlike(TRIP_RX) & F.col("text").rlike(POLES_RX)
    names = F.when(both, F.array(F.lit("TRIP"), F.lit("POLES"))).otherwise(F.array("text"))
    return tokens.select(*[c for c in tokens.columns if c != "text"], F.explode(names).alias("text"))


def score_header_columns(words: DataFrame, min_conf: float = 0.50) -> DataFrame:
    """Signals per column from its words: `page_id, column, x1, x2, text, conf`.

    Words of long phrases only count as notes.
    """
    pieces = F.filter(F.split(F.trim("text"), r"[\s/,;-]+"), lambda w: F.trim(w) != "")
    conf = words.withColumn("_p", F.when(F.col("conf") >= min_conf, pieces))
    w = conf.select("page_id", "column", "x1", "x2", (F.size("_p") >= 3).alias("_s"), F.explode_outer("_p").alias("_w"))
    w = w.withColumn("_f", header_facts(F.col("_w")))
    short = ~F.coalesce("_s", F.lit(False))
    rank = lambda f: F.coalesce(F.max(F.when(short, F.col(f"_f.{f}"))), F.lit(0))
    points = lambda f: F.sum(F.when(short & F.col(f"_f.{f}"), 3).otherwise(0)).cast("int")
    return w.groupBy("page_id", "column").agg(
        F.min("x1").alias("x_left"), F.max("x2").alias("x_right"), F.bool_or("_f.notes").alias("has_notes"), points("ckt").alias("ckt"),
        points("description").alias("description"), rank("trip").alias("trip_rank"), rank("poles").alias("poles_rank"))


def assign_column_roles(scores: DataFrame) -> DataFrame:
    """Role per column and layout per page.

    Circuit and description columns first; of the rest, the best trip and the
    best poles column of each half, combined where they are the same column.
    """
    base = scores.withColumns({
        "role": F.when(F.col("has_notes"), None).when((F.col("ckt") >= F.col("description")) & (F.col("ckt") >= 2), "ckt")
        .when(F.col("description") >= 2, "description"),
        "hero": ~F.col("has_notes") & (F.col("ckt") == 0) & (F.col("description") == 0)})
    span = base.filter("hero").groupBy("page_id").agg(((F.min("x_left") + F.max("x_right")) / 2).alias("mid"))
    base = base.join(span, "page_id", "left").withColumn("side", F.when((F.col("x_left") + F.col("x_right")) / 2 < F.col("mid"), "left").otherwise("right"))
    best = lambda r: F.min(F.when(F.col("hero") & (F.col(r) > 0), F.struct((-F.col(r)).alias("r"), F.col("column").alias("c"))))
    sides = base.filter("mid IS NOT NULL").groupBy("page_id", "side").agg(best("trip_rank").alias("t"), best("poles_rank").alias("p"))
    sides = sides.select("page_id", "side", F.col("t.c").alias("trip_col"), F.col("p.c").alias("poles_col"))
    page = sides.groupBy("page_id").agg(F.bool_or(F.coalesce(F.col("trip_col") == F.col("poles_col"), F.lit(False))).alias("combo"),
                                        F.count("trip_col").alias("nt"), F.count("poles_col").alias("np"))
    layout = F.when(F.col("combo"), "combined").when((F.col("nt") > 0) & (F.col("np") > 0), "separated").otherwise("unknown")
    page = page.select("page_id", layout.alias("layout"))
    df = base.join(sides, ["page_id", "side"], "left").join(page, "page_id", "left").withColumn("layout", F.coalesce("layout", F.lit("unknown")))
    is_t, is_p = F.col("column") == F.col("trip_col"), F.col("column") == F.col("poles_col")
    hero_role = (F.when(F.col("layout") == "combined", F.when(is_t & is_p, "combo"))
                 .when(is_t, "trip").when(is_p, "poles"))
    return df.select("page_id", "column", F.coalesce("role", F.when(F.col("hero"), hero_role)).alias("role"), "layout")


def classify_bands(labels: DataFrame, accept: float = 0.60) -> DataFrame:
    """Role and flags of each header label, and the layout hint of its page."""
    label = fix_header_typos(F.col("text"))
    df = labels.withColumn("_l", label).withColumn("_s", role_scores(F.col("_l")))
    trip, poles = F.col("_l").rlike(TRIP_RX), F.col("_l").rlike(POLES_RX)
    combo = trip & poles
    top = F.array_max(F.array(*[F.struct(F.col(f"_s.{r}").alias("s"), F.lit(-i).alias("o"), F.lit(r).alias("r"))
                                for i, r in enumerate(("ckt", "description", "trip", "poles"))]))
    role = F.when(combo, "combo").when(top["s"] >= accept, top["r"]).otherwise("unknown")
    out = df.select(*labels.columns, role.alias("class_role"), trip.alias("has_trip"), poles.alias("has_poles"), F.round(top["s"], 6).alias("similarity"))
    hint = out.groupBy("page_id").agg(F.bool_or(F.col("class_role") == "combo").alias("c"), F.bool_or(F.col("class_role") == "trip").alias("t"),
                                      F.bool_or(F.col("class_role") == "poles").alias("p"))
    return out.join(hint.select("page_id", (F.col("c") | (F.col("t") != F.col("p"))).alias("likely_combined")), "page_id")


def pick_headers(scored: DataFrame, bucket: int = 28, k: int = 2, accept: float = 0.60, w_sim: float = 0.90, w_conf: float = 0.10) -> DataFrame:
    """The `k` best columns per role, one per horizontal bucket."""
    blend = F.round(w_sim * F.col("sim") + w_conf * F.col("conf"), 9)
    df = scored.filter(F.col("sim") >= accept).withColumns({
        "score": blend, "bucket": F.bround((F.col("x1") + F.col("x2")) / 2 / bucket).cast("int")})
    order = [F.col("score").desc(), F.col("ord")]
    return top_per(first_per(df, ["page_id", "role", "bucket"], order), ["page_id", "role"], order, k)


def is_combined_side(picks: DataFrame, pages: DataFrame, max_dx: float = 14.0) -> DataFrame:
    """Whether trip and poles of a page half share one column.

    Nearest trip and poles picks are neighbours in x, so no pairs are formed.
    """
    x = (F.col("x1") + F.col("x2")) / 2
    df = picks.filter(F.col("role").isin("trip", "poles")).join(pages.select("page_id", "width"), "page_id").withColumns({
        "x": x, "side": F.when(x < F.col("width") / 2, "L").otherwise("R")})
    t = F.upper("text")
    dual = t.rlike(r"TRIP|AMP|\(A\)") & t.rlike(r"POLE| P | P\)")
    order = [F.col("x"), F.col("role"), F.col("ord")]
    last = lambda r: ("last", F.when(F.col("role") == r, F.col("x")), True)
    near = running(df, ["page_id", "side"], order, {"_t": last("trip"), "_p": last("poles")})
    dx = F.abs(F.col("_t") - F.col("_p"))
    return near.groupBy("page_id", "side").agg(F.bool_or(dual | F.coalesce(dx <= max_dx, F.lit(False))).alias("combined"))


def column_bands(vlines: DataFrame, pages: DataFrame) -> DataFrame:
    """Bands between vertical lines and the page edges, padded inwards."""
    w = F.col("width")
    edges = (vlines.select("page_id", "x").unionByName(pages.select("page_id", F.lit(0).cast("long").alias("x")))
             .unionByName(pages.select("page_id", (w - 1).alias("x"))))
    near = neighbours(edges.distinct(), ["page_id"], [F.col("x")], F.col("x"), nxt="_n").filter("_n IS NOT NULL")
    df = near.join(pages.select("page_id", "width"), "page_id")
    pad = F.greatest(F.lit(2), F.floor(0.002 * w))
    a, b = F.greatest(F.lit(0), F.col("x") + pad), F.least(w - 1, F.col("_n") - pad)
    m = F.greatest(F.lit(0), F.least(w - 2, F.floor((F.col("x") + F.col("_n")) / 2)))
    return df.select("page_id", F.when(b <= a, F.greatest(F.lit(0), m - 1)).otherwise(a).alias("a"), F.when(b <= a, F.least(w - 1, m + 1)).otherwise(b).alias("b"))


def ckt_column_spans(tokens: DataFrame, vlines: DataFrame) -> DataFrame:
    """Column around each circuit label: nearest line left and right of it."""
    labels = tokens.filter(F.upper("text").rlike(CKT_ALONE)).select("page_id", "pos", "x1", "x2")
    lines = vlines.select("page_id", "x").distinct().groupBy("page_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    df = labels.join(lines, "page_id").select(
        "page_id", "pos", F.array_max(F.filter("xs", lambda v: v <= F.col("x1"))).alias("x_left"), F.array_min(F.filter("xs", lambda v: v >= F.col("x2"))).alias("x_right"))
    return df.filter(F.col("x_right") > F.col("x_left"))


def footer_token(tokens: DataFrame, structural: DataFrame) -> DataFrame:
    """Lowest last-circuit number of a page, else its structural footer."""
    n = F.nullif(F.regexp_extract("text", "([0-9]+)", 1), F.lit("")).try_cast("int")
    best = tokens.withColumn("_n", n).filter(F.col("_n").isin(*FOOTER_VALUES)).groupBy("page_id").agg(F.max(F.struct("_n", "y2")).alias("m"))
    return structural.join(best, "page_id", "left").select(
        "page_id", F.col("m._n").alias("token_value"), F.coalesce("m.y2", "footer_y").alias("footer_y"), F.col("m").isNotNull().alias("by_token"))


def header_y_by_ckt(tokens: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Topmost circuit label that has a rule below it.

    Windows grow to the right; a label counts alone or inside its 14-pixel line
    of the window. A last pass over the left half needs no rule. Texts are judged
    before anything moves, and all windows are read off one row per line of a page.
    """
    up = F.upper("text")
    judged = tokens.select("page_id", "y1", "y2", "x2", up.rlike(CKT_ALONE).alias("alone"), up.rlike(CKT_WITHIN).alias("within"),
                           F.contains(up, F.lit("HEADER")).alias("bad"))
    t = judged.join(pages.select("page_id", "width", "height"), "page_id")
    h, w = F.col("height"), F.col("width")
    inside = lambda y1f, y2f, x2f: ((F.col("y1") >= F.floor(h * y1f)) & (F.col("y2") <= F.floor(h * y2f)) & (F.col("x2") <= F.floor(w * x2f)))
    bin_ = F.floor(F.floor((F.col("y1") + F.col("y2")) / 2) / 14)
    facts = [F.struct(F.min(F.when(win, F.col("y1"))).alias("top"), F.bool_or(win & F.col("within")).alias("has"), F.bool_or(win & F.col("bad")).alias("bad"))
             for win in (inside(*w) for w in CKT_WINDOWS)]
    seen = any_of([inside(*win) for win in CKT_WINDOWS])
    left = (F.col("x2") <= F.floor(0.48 * w)) & (F.col("y1") >= F.floor(0.08 * h)) & (F.col("y2") <= F.floor(0.68 * h))
    line = t.groupBy("page_id", bin_.alias("bin")).agg(*[f.alias(f"w{i}") for i, f in enumerate(facts)])
    wins = F.array(*[F.col(f"w{i}") for i in range(len(facts))])
    grouped = line.select("page_id", F.explode(F.filter(wins, lambda x: x["has"] & ~x["bad"])).alias("x")).select("page_id", F.col("x.top").alias("y"))
    labels = judged.filter("alone").join(pages.select("page_id", "width", "height"), "page_id")
    alone = labels.filter(seen).select("page_id", F.col("y1").alias("y"))
    ruled = rule_below(held(alone.unionByName(grouped).distinct()), lines, "y")
    free = labels.filter(left).select("page_id", F.col("y1").alias("y"))
    hits = ruled.select("page_id", "y").unionByName(free).join(pages.select("page_id", "height"), "page_id")
    return hits.filter(F.col("y") <= F.floor(0.65 * F.col("height"))).groupBy("page_id").agg(F.min("y").alias("header_y"))


def map_columns(picks: DataFrame, bands: DataFrame, pages: DataFrame, max_dx: float = 0.10, pad: int = 8, min_width: int = 24) -> DataFrame:
    """Pixel columns of trip and poles per page half.

    A combined half takes the span of its header. Otherwise each header takes
    its grid band when that is near; a missing one takes the neighbouring band;
    two that fall into one band of the left half split it between their centres;
    what is still missing comes from fixed page fractions.
    """
    w = F.col("width")
    side = is_combined_side(picks, pages)
    x = (F.col("x1") + F.col("x2")) / 2
    mine = picks.filter(F.col("role").isin("trip", "poles")).join(pages.select("page_id", "width"), "page_id").withColumns({
        "x": x, "side": F.when(x < w / 2, "L").otherwise("R")})
    first = lambda r: F.min(F.when(F.col("role") == r, F.struct("x", "ord", "x1", "x2")))
    heads = mine.groupBy("page_id", "side").agg(first("trip").alias("t"), first("poles").alias("p"))
    halves = pages.select("page_id", "width", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("side"))
    df = (halves.join(heads, ["page_id", "side"], "left").join(side, ["page_id", "side"], "left").join(band_list(bands), "page_id", "left")
          .withColumns({"combined": F.coalesce("combined", F.lit(False)), "bands": F.coalesce("bands", F.array().cast("array<struct<a:bigint,b:bigint>>"))}))
    band = lambda i: F.get("bands", (i - 1).cast("int"))

    def near(h: str) -> Column:
        i = band_at(F.col("bands"), F.col(f"{h}.x"))
        return F.when(F.abs((band(i)["a"] + band(i)["b"]) / 2 - F.col(f"{h}.x")) <= max_dx * w, i)

    step = F.when(F.col("side") == "L", -1).otherwise(1)
    df = df.withColumns({"_ti": near("t"), "_pi": near("p")})
    inside = lambda i: F.when((i >= 1) & (i <= F.size("bands")), i)
    df = df.withColumns({"_tj": F.coalesce("_ti", inside(F.col("_pi") + step)), "_pj": F.coalesce("_pi", inside(F.col("_ti") - step))})
    shared = (F.col("side") == "L") & (F.col("_tj") == F.col("_pj"))
    cut = F.floor((F.col("t.x") + F.col("p.x")) / 2)
    tb, pb = band(F.col("_tj")), band(F.col("_pj"))
    trip_left = F.col("t.x") <= F.col("p.x")
    trip = F.when(shared & trip_left, F.struct(tb["a"].alias("a"), cut.alias("b"))).when(shared, F.struct(cut.alias("a"), tb["b"].alias("b"))).otherwise(tb)
    pole = F.when(shared & trip_left, F.struct(cut.alias("a"), pb["b"].alias("b"))).when(shared, F.struct(pb["a"].alias("a"), cut.alias("b"))).otherwise(pb)
    frac = lambda k: F.struct(F.floor(w * FALLBACK_FRACTIONS[k][0]).alias("a"), F.floor(w * FALLBACK_FRACTIONS[k][1]).alias("b"))
    by_side = lambda r: F.when(F.col("side") == "L", frac(f"L_{r}")).otherwise(frac(f"R_{r}"))
    head = F.coalesce("t", "p")
    a, b = F.greatest(F.lit(0), head["x1"] - pad), F.least(w, head["x2"] + pad)
    c = F.floor((a + b) / 2)
    span = F.when(b - a < min_width, F.struct(F.greatest(F.lit(0), c - min_width // 2).alias("a"), F.least(w, c + min_width // 2).alias("b"))).otherwise(
        F.struct(a.alias("a"), b.alias("b")))
    item = lambda r, s: F.struct(F.lit(r).alias("role"), s["a"].alias("a"), s["b"].alias("b"))
    cols = F.when(F.col("combined"), F.array(item("combo", span))).otherwise(
        F.array(item("trip", F.coalesce(trip, by_side("TRIP"))), item("poles", F.coalesce(pole, by_side("POLES")))))
    return df.select("page_id", "side", F.explode(cols).alias("c")).select("page_id", "side", "c.role", "c.a", "c.b")


def backfill_picks(picks: DataFrame, classified: DataFrame) -> DataFrame:
    """Roles without a pick take the classified labels; a combined label counts
    for both trip and poles."""
    roles = F.when(F.col("class_role") == "combo", F.array(F.lit("trip"), F.lit("poles"))).when(
        F.col("class_role") != "unknown", F.array("class_role"))
    extra = classified.select("page_id", "ord", "text", "x1", "x2", F.explode(roles).alias("role"))
    have = picks.select("page_id", "role").distinct()
    cols = ["page_id", "role", "ord", "text", "x1", "x2"]
    return (picks.select(*cols, F.lit("pick").alias("origin"))
            .unionByName(extra.join(have, ["page_id", "role"], "left_anti").select(*cols, F.lit("class").alias("origin"))))
