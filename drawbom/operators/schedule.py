"""Breaker extraction from schedule columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.operators.folds import keep_apart
from drawbom.operators.spread import first_per, held

# Voting weights and margins.
WEIGHTS = {"ocr": 2.0, "template": 1.25, "ink": 1.25}
MARGIN_BOTH, MARGIN_ONE, MARGIN_RELAX, WEAK_OCR = 0.60, 0.75, 0.10, 0.55


def trip_values(dets: DataFrame, keys: list[str], min_dy: int = 10, flat_ratio: float = 3.0) -> DataFrame:
    """Numbers of a trip column, top to bottom.

    Detections without digits and flat boxes are ignored; of detections closer
    than `min_dy` to the last kept one only the first stays; the longest digit
    run of a text is its value. Needs `ord, text, x1, y1, x2, y2`. The first detection of
    each position is found once and written; positions are thinned from these.
    """
    runs = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    w, h = F.col("x2") - F.col("x1") + 1, F.col("y2") - F.col("y1") + 1
    flat = (h <= 2) & (w >= flat_ratio * h)
    longest = F.array_max(F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r"))))["r"]
    rows = dets.filter(F.col("text").rlike("[0-9]") & ~flat).select(*keys, "ord", "text", (F.col("y1") + F.col("y2")).alias("y2x"))
    firsts = held(first_per(rows, [*keys, "y2x"], [F.col("ord")]).withColumn("value", longest))
    kept = keep_apart(firsts, keys, "y2x", 2 * min_dy)
    return firsts.join(kept, [*keys, "y2x"], "left_semi").select(*keys, "ord", "y2x", "value")


def vote_digit(probs: DataFrame) -> DataFrame:
    """Final pole digit from three weighted sources.

    The text reading stands unless another digit wins by a margin and at least
    one of the other sources, not abstaining, prefers that digit.
    """
    digits, sources = (1, 2, 3), list(WEIGHTS)
    cell = lambda s, d: F.sum(F.when((F.col("source") == s) & (F.col("digit") == d), F.col("p")).otherwise(0.0))
    voting = lambda s: ~F.bool_or((F.col("source") == s) & F.col("abstain"))
    table = probs.groupBy("panel_id", "i").agg(
        *[cell(s, d).alias(f"{s}{d}") for s in sources for d in digits],
        *[voting(s).alias(f"{s}_votes") for s in sources[1:]])
    best = lambda cols: F.array_max(F.array(*[F.struct(c.alias("s"), F.lit(-d).alias("d")) for d, c in zip(digits, cols)]))
    total = [F.round(WEIGHTS["ocr"] * F.col(f"ocr{d}") + sum(
        (F.when(F.col(f"{s}_votes"), WEIGHTS[s]).otherwise(0.0) * F.col(f"{s}{d}") for s in sources[1:]), F.lit(0.0)), 6) for d in digits]
    prefers = lambda s: -best([F.col(f"{s}{d}") for d in digits])["d"]
    table = table.withColumns({"_hat": best(total), "_ocr": best([F.col(f"ocr{d}") for d in digits]),
                               "_tpl": prefers("template"), "_ink": prefers("ink")})
    table = table.withColumns({"_hat_d": -F.col("_hat.d"), "_ocr_d": -F.col("_ocr.d"), "_s": F.array(*total)})
    agree = sum((F.when(F.col(f"{s}_votes") & (F.col(c) == F.col("_hat_d")), 1).otherwise(0)
                 for s, c in (("template", "_tpl"), ("ink", "_ink"))), F.lit(0))
    margin = F.round(F.col("_hat.s") - F.element_at("_s", F.col("_ocr_d")), 6)
    delta = F.when(agree >= 2, MARGIN_BOTH).when(agree == 1, MARGIN_ONE)
    delta = F.round(F.when(F.col("_ocr.s") < WEAK_OCR, F.greatest(F.lit(0.0), delta - F.when(delta.isNotNull(), MARGIN_RELAX))).otherwise(delta), 6)
    override = F.coalesce((F.col("_hat_d") != F.col("_ocr_d")) & delta.isNotNull() & (margin >= delta), F.lit(False))
    return table.select("panel_id", "i", F.when(override, F.col("_hat_d")).otherwise(F.col("_ocr_d")).alias("digit"),
                        override.alias("override"), margin.alias("margin"))


def pair_by_index(trips: DataFrame, poles: DataFrame, on: list[str] | None = None) -> DataFrame:
    """i-th trip with i-th pole of a side; a missing reading drops the pair.

    `on` may name a row band instead of the index, for tables with gaps.
    """
    keys = on or ["panel_id", "side", "i"]
    return trips.filter("amps IS NOT NULL").join(poles.filter("poles IS NOT NULL"), keys).select(*keys, "poles", "amps")


def prefer_combo_side(separated: DataFrame, combo: DataFrame) -> DataFrame:
    """A side read as one combined column replaces its separate readings."""
    sides = combo.select("panel_id", "side").distinct()
    return separated.join(sides, ["panel_id", "side"], "left_anti").unionByName(combo)


def count_breakers(pairs: DataFrame) -> DataFrame:
    return (pairs.groupBy("panel_id", "poles", "amps").agg(F.count("*").alias("cnt"))
            .select("panel_id", "poles", F.col("amps").alias("amperage"), "cnt"))


def union_chunks(top: DataFrame, bottom: DataFrame) -> DataFrame:
    """Two scanned halves of a long schedule as one, in reading order."""
    n = top.groupBy("panel_id", "side").agg(F.max("i").alias("_n"))
    below = bottom.join(n, ["panel_id", "side"], "left").withColumn("i", F.col("i") + F.coalesce("_n", F.lit(0))).drop("_n")
    return top.withColumn("chunk", F.lit(1)).unionByName(below.withColumn("chunk", F.lit(2)))
