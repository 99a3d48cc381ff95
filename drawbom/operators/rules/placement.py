"""Placing branch breakers in an I-Line interior.

Spark prepares one buildable frame, rating and part per breaker line; only the
choice of side and phase pair depends on what was placed before. Lines are
merged by poles, amps and features first, so a panel's group is bounded by the
rating ladders and not by the number of readings.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from drawbom.operators.rules.parts import PHASE_SUFFIX, interrupting_letter, mccb_part
from drawbom.operators.rules.search import snap_ka
from drawbom.operators.rules.sizing import SPACE_INCHES, allowed_pairs, next_size, rating_voltage
from drawbom.operators.spread import first_per
from drawbom.sources.catalogs import ELECTRONIC

# Fixed values -------------------------------------------------------------
SERIES_FRAMES = {"HCJ": ["Q", "H", "J"], "HCP": ["Q", "H", "J", "LL", "L", "M", "P"], "HCR-U": ["Q", "H", "J", "LL", "L", "M", "P", "R"]}
ELECTRONIC_ONLY = ["M", "P", "R"]
MAGNETIC_ONLY = ["Q", "LL"]
NARROW_FRAMES = ["H", "J"]
SPD_INCHES = 13.5
MAX_SPACES = 108
OVERFLOW = "too many breakers detected. user review required."
# --------------------------------------------------------------------------


def buildable_lines(panels: DataFrame, breakers: DataFrame, frames: DataFrame, pair_rules: DataFrame) -> DataFrame:
    """First frame and trip of each line that gives a part, with its pairs.

    Needs series, voltage, int_rating on the panels; a line without any frame
    keeps a null part. Series-rated panels (`series_rated`) take the lowest rating of
    the frame, others the one at or above the panel's. An internal surge device
    (`spd`) counts unless `allow_spd` is false.
    """
    flag = lambda c, default: F.coalesce(c, F.lit(default)) if c in panels.columns else F.lit(default)
    p = panels.select("panel_id", "series", "voltage", "int_rating", "spaces", (flag("spd", False) & flag("allow_spd", True)).alias("spd"), flag("series_rated", False).alias("series_rated"))
    rows = breakers.groupBy("panel_id", "poles", "amperage", "special_features").agg(F.sum("cnt").cast("long").alias("cnt")).join(p, "panel_id")
    sizes = (frames.groupBy("ord", "frame", "poles", "width", "max_volts").agg(F.array_sort(F.collect_set("rating")).alias("ratings")))
    series = F.create_map(*[x for s, fs in SERIES_FRAMES.items() for x in (F.lit(s), F.array(*[F.lit(f) for f in fs]))])
    electronic = F.create_map(*[x for f, a in ELECTRONIC.items() for x in (F.lit(f), F.array(*[F.lit(n) for n in a]))])
    v = rating_voltage(F.col("voltage"))
    trips = F.when(F.col("frame").isin(*ELECTRONIC_ONLY), F.array(F.lit("ELECTRONIC"))).when(
        F.col("frame").isin(*MAGNETIC_ONLY), F.array(F.lit("MAGNETIC"))).otherwise(F.array(F.lit("MAGNETIC"), F.lit("ELECTRONIC")))
    tried = (rows.join(sizes, "poles").filter(F.array_contains(series[F.col("series")], F.col("frame")) & (F.col("max_volts") >= v))
             .select("*", F.posexplode(trips).alias("t", "trip")))
    ladder = F.when(F.col("trip") == "ELECTRONIC", F.try_element_at(electronic, F.col("frame"))).otherwise(F.col("ratings"))
    lowest = snap_ka(F.col("frame"), v, F.lit(0))
    lowest = F.when(lowest > 0, lowest).otherwise(F.col("int_rating"))
    tried = tried.withColumns({"amps": next_size(ladder, F.col("amperage")), "ka": F.when(F.col("series_rated"), lowest).otherwise(snap_ka(F.col("frame"), v, F.col("int_rating")))})
    letter = F.substring("frame", 1, 1)
    part = lambda ka: mccb_part(letter, F.lit("ILINE"), F.col("poles"), F.col("amps"), v, ka, F.col("trip"), F.lit(False), F.lit(""))["product"]
    next_ka = snap_ka(F.col("frame"), v, F.col("ka") + 1)
    tried = tried.withColumns({
        "product": F.coalesce(part(F.col("ka")), part(next_ka)), "rating": F.when(part(F.col("ka")).isNotNull(), F.col("ka")).otherwise(next_ka),
        "letter": interrupting_letter(F.lit("HJ"), v, F.col("ka"))}).filter("product IS NOT NULL")
    key = ["panel_id", "poles", "amperage", "special_features"]
    best = first_per(tried, key, [F.col("ord"), F.col("t")]).select(*key, "frame", "trip", "width", "amps", "product", "rating", "letter")
    best = allowed_pairs(best, pair_rules.filter(F.col("frame").isin(*NARROW_FRAMES))).select(*key, "frame", "trip", "width", "amps", "product", "rating", "pairs")
    return rows.join(best, key, "left")


def place_iline(panels: DataFrame, breakers: DataFrame, frames: DataFrame, pair_rules: DataFrame) -> DataFrame:
    """Parts, blanks, notes and spaces left per panel: `panel_id, kind, product, qty,
    rating`; the rating in kA belongs to the breakers.

    Every requested unit is placed. Narrow frames prefer the narrow side, then
    the wide side with an extension; what fits nowhere is forced onto the
    emptier side and its missing inches are noted. Two-pole units take the pair
    that keeps the phases most even. Left-over inches become blanks.
    """
    line = F.struct("poles", "amperage", "special_features", "cnt", "frame", "trip", "width", "amps", "product", "rating", "pairs")
    grouped = (buildable_lines(panels, breakers, frames, pair_rules).groupBy("panel_id", "series", "spaces", "spd")
               .agg(F.array_sort(F.collect_list(line)).alias("lines")))

    def place_batches(batches):
        for batch in batches:
            rows = [(p, *r) for p, series, spaces, spd, lines in batch.itertuples(index=False) for r in place_panel(series, spaces, spd, lines)]
            yield pd.DataFrame(rows, columns=["panel_id", "kind", "product", "qty", "rating"]).astype({"rating": "Int32"})

    return grouped.mapInPandas(place_batches, "panel_id long, kind string, product string, qty long, rating int")


def place_panel(series: str, spaces, spd: bool, lines: list[dict]) -> list[tuple]:
    """Rows of one panel, its lines taken in order."""
    two_widths = series != "HCJ"
    width = {"left": "narrow", "right": "wide" if two_widths else "narrow"}
    half = min(MAX_SPACES, int(spaces or 0)) * SPACE_INCHES / 2
    room = {"left": half, "right": half}
    load, parts, ratings, notes, deficit, extensions = dict.fromkeys("ABC", 0.0), {}, {}, {}, 0.0, 0

    def take_side(frame: str, inches: float) -> str:
        nonlocal deficit
        fits = [s for s in room if room[s] >= inches]
        if two_widths and frame in NARROW_FRAMES:
            fits = [s for s in fits if width[s] == "narrow"] or fits
        elif two_widths:
            fits = [s for s in fits if width[s] == "wide"]
        side = max(fits or room, key=room.get)
        if not fits:
            deficit = max(deficit, inches - room[side])
        return side

    if spd:
        short = deficit
        side = take_side("J", SPD_INCHES)
        extensions += deficit == short and two_widths and width[side] == "wide"
        room[side] = max(0.0, room[side] - SPD_INCHES)
        notes["I-LINE cannot be service-entrance rated when an internal SPD is installed."] = 1
    for line in lines:
        if line["poles"] not in (2, 3):
            notes["I-Line breakers must be 2P or 3P only"] = 1
            continue
        if line["product"] is None:
            missing = f"No compatible frame: {line['poles']}P @ {line['amperage']}A"
            notes[missing] = notes.get(missing, 0) + int(line["cnt"])
            continue
        for _ in range(int(line["cnt"])):
            side = take_side(line["frame"], line["width"])
            room[side] -= line["width"]
            extensions += two_widths and width[side] == "wide" and line["frame"] in NARROW_FRAMES
            product = line["product"]
            if line["poles"] == 2 and line["trip"] == "MAGNETIC":
                pair = min(line["pairs"], key=lambda p: spread(load, p, line["amps"]))
                product += PHASE_SUFFIX[f"2{pair}"]
                for k in pair:
                    load[k] += line["amps"]
            parts[product] = parts.get(product, 0) + 1
            ratings[product] = line["rating"]
    blanks = {"HLN1BL": 0, "HLW1BL": 0, "HLW4EBL": int(extensions)}
    for side, left in room.items():
        blanks["HLN1BL" if width[side] == "narrow" else "HLW1BL"] += math.ceil(max(0.0, left) / SPACE_INCHES)
    if deficit > 0:
        notes[f"Side-capacity bottleneck detected. Consider increasing by ~{math.ceil(2 * deficit / SPACE_INCHES)} spaces."] = 1
        notes[OVERFLOW] = 1
    left = max(0, round((room["left"] + room["right"]) / SPACE_INCHES))
    return ([("breaker", k, n, ratings[k]) for k, n in parts.items()] + [("blank", k, n, None) for k, n in blanks.items() if n]
            + [("note", k, n, None) for k, n in notes.items()] + [("spaces left", "", left, None)])


def spread(load: dict, pair: str, amps: float) -> float:
    """Unevenness of the phases once the pair carries the amps as well."""
    after = [load[k] + (amps if k in pair else 0.0) for k in load]
    return max(after) - min(after)
