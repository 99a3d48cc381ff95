"""Part numbers of moulded-case breakers, interiors and accessories.

An impossible request never raises: it gives a null part and a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.operators.rules.sizing import ladder_arrays, next_size
from drawbom.sources.catalogs import EFRAME, H_AMPS, J_AMPS, LL_AMPS, Q_AMPS

# Fixed values -------------------------------------------------------------
LETTERS = {
    "B": {240: {25: "D", 65: "G", 100: "J"}, 480: {18: "D", 35: "G", 65: "J"}, 600: {14: "D", 18: "G", 25: "J", 65: "K"}},
    "HJ": {240: {25: "D", 65: "G", 100: "J", 125: "L", 200: "R"}, 480: {18: "D", 35: "G", 65: "J", 100: "L", 200: "R"},
           600: {14: "D", 18: "G", 25: "J", 50: "L", 100: "R"}},
    "Q": {240: {10: "B", 25: "D", 65: "G", 100: "J"}},
    "LM": {240: {42: "A", 65: "H"}, 480: {30: "A", 35: "H"}, 600: {22: "A", 25: "H"}},
    "LE": {240: {65: "G", 100: "J", 125: "L", 200: "R"}, 480: {35: "G", 65: "J", 100: "L", 200: "R"},
           600: {18: "G", 25: "J", 50: "L", 100: "R"}},
    "M": {240: {65: "G", 100: "J"}, 480: {35: "G", 65: "J"}, 600: {18: "G", 25: "J"}},
    "P": {240: {65: "G", 100: "J"}, 480: {35: "G", 65: "J", 50: "K", 100: "L"}, 600: {18: "G", 25: "J", 50: "K"}},
    "R": {240: {65: "G", 100: "J", 125: "L"}, 480: {35: "G", 65: "J", 100: "L"}, 600: {18: "G", 25: "J", 50: "L", 65: "K"}},
}
MCCB_AMPS = {"B": EFRAME, "BK": [15, 20, 25, 30], "HM": H_AMPS, "JM": J_AMPS, "HE": [60, 100, 150], "JE": [250], "Q": Q_AMPS,
             "LM": LL_AMPS, "LE": [250, 400, 600], "LEG": [400, 600], "M": [400, 600], "P": [250, 400, 600, 800, 1000, 1200],
             "R": [600, 800, 1000, 1200, 1600, 2000, 2500, 3000], "RI": [1000, 1200]}
PHASE_SUFFIX = {"1A": "1", "1B": "3", "1C": "5", "2AB": "1", "2AC": "2", "2BA": "3", "2BC": "4", "2CA": "5", "2CB": "6"}
NOT_MADE = ["HDA261256", "HLA261001", "HLA261005"]
SPD_KA = [80, 100, 120, 160, 200, 240]
NF_OUTDOOR_TRIM = {30: 62, 42: 68, 54: 74, 66: 86}
ILINE_SPD = {208: {120: "HL2IMA12C", 160: "HL2IMA16C", 240: "HL2IMA24C"}, 240: {240: "HL6IMA24C"},
             480: {120: "HL4IMA12C", 160: "HL4IMA16C", 240: "HL4IMA24C"}, 600: {160: "HR8IMA16C", 240: "HR8IMA24C"}}
BARRIER_KITS = {"HCJ": {"H": "ILBFMHCJHULC", "J": "ILBFMHCJHULC"},
                "HCP": {"H": "ILBFMHCPHJULC", "J": "ILBFMHCPHJULC", "L": "ILBFMHCPLULC", "M": "ILBFMHCPMPULC", "P": "ILBFMHCPMPULC"},
                "HCR-U": {"L": "ILBFMHCRLULC", "M": "ILBFMHCRMULC", "P": "ILBFMHCRPULC", "R": "ILBFMHCRRULC"}}
# --------------------------------------------------------------------------


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def mccb_kind(frame: Column, trip: Column) -> Column:
    return (F.when(frame.isin("H", "J"), "HJ").when(frame == "L", F.when(trip == "MAGNETIC", "LM").otherwise("LE"))
            .otherwise(frame))


def interrupting_letter(kind: Column, volts: Column, ka: Column) -> Column:
    table = _map({f"{k}|{v}|{a}": x for k, by in LETTERS.items() for v, m in by.items() for a, x in m.items()})
    v = F.when((kind == "Q") & (volts <= 240), 240).otherwise(volts)
    return F.try_element_at(table, F.concat_ws("|", kind, v.cast("string"), ka.cast("string")))


def mccb_part(frame: Column, termination: Column, poles: Column, amps: Column, volts: Column, ka: Column, trip: Column,
              grounding: Column, phasing: Column) -> Column:
    """Struct of part number and reason; exactly one of them is set."""
    kind = mccb_kind(frame, trip)
    letter = interrupting_letter(kind, volts, ka)
    letter = F.when((frame == "B") & (letter == "K") & (poles == 3), None).otherwise(letter)
    lug = termination == "LUG"
    electronic_only, t_electronic = frame.isin("M", "P", "R"), trip == "ELECTRONIC"
    pole_ok = (F.when(frame == "B", poles.isin(1, 2, 3)).when(frame.isin("Q", "M"), poles.isin(2, 3))
               .when(frame.isin("H", "J") & ~t_electronic, poles.isin(2, 3)).otherwise(poles == 3))
    amp_key = (F.when((frame == "B") & (letter == "K"), "BK").when(frame.isin("H", "J"), F.concat(frame, F.when(t_electronic, "E").otherwise("M")))
               .when((kind == "LE") & grounding, "LEG").when((frame == "R") & ~lug, "RI").otherwise(kind))
    ladders = F.create_map(*[x for k, a in MCCB_AMPS.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in a]))])
    amp_ok = F.coalesce(F.array_contains(F.try_element_at(ladders, amp_key), amps), F.lit(False))
    term = (F.when(lug, F.when(frame == "R", "F").otherwise("L")).when(frame == "L", "").otherwise("A"))
    code = F.when(frame == "Q", "2").when((frame == "P") & (letter == "L") & (volts == 480), "4").otherwise("6")
    rating = (F.when(frame == "M", F.when(amps == 400, "400").otherwise("800"))
              .when(frame.isin("P", "R"), F.lpad(F.floor(amps / 10).cast("string"), 3, "0"))
              .otherwise(F.lpad(amps.cast("string"), 3, "0")))
    ground = F.when(grounding, "U44").otherwise("U31")
    tail = (F.when((frame.isin("H", "J") | (kind == "LE")) & t_electronic, F.concat(ground, F.lit("X")))
            .when((frame == "P") & (grounding | amps.isin(250, 400)), F.concat(ground, F.lit("A")))
            .when(frame == "R", F.concat(F.when(lug, "").otherwise("C"),
                                         F.when(grounding | ~lug | amps.isin(600, 800, 1000, 3000), F.concat(ground, F.lit("A"))).otherwise("")))
            .otherwise(""))
    suffix = F.when(~lug & (trip == "MAGNETIC"), F.coalesce(
        F.try_element_at(_map(PHASE_SUFFIX), F.concat(poles.cast("string"), phasing)), F.lit(""))).otherwise("")
    part = F.concat(frame, letter, term, poles.cast("string"), code, rating, tail, suffix)
    reason = (F.when(electronic_only & ~t_electronic, "trip").when((frame == "M") & grounding, "grounding")
              .when(~pole_ok, "poles").when(letter.isNull(), "interrupting rating")
              .when((frame == "H") & ~t_electronic & (letter == "R"), "interrupting rating")
              .when(~amp_ok, "amperage").when((kind != "LM") & part.isin(*NOT_MADE), "not made"))
    return F.struct(F.when(reason.isNull(), part).alias("product"), reason.alias("error"))


def mccb_enclosure(product: Column, poles: Column, style: Column) -> Column:
    """Enclosure for a lug breaker by its first letters and the mounting style."""
    p = F.substring(product, 1, 3)
    j250 = (p.isin("HJL", "HLL", "JDL", "JGL", "JJL", "JLL")) | ((p == "HGL") & (poles != 2))
    base = (F.when(p.isin("BDL", "BGL", "BJL", "BKL"), "B125").when(p.isin("HDL", "HGL") & (poles == 2), "H150")
            .when(j250, "J250").when(p.isin("LDL", "LJL"), "L600AWK").when(p.isin("LGL", "LLL", "LRL"), "L600AWKMC")
            .when(p.isin("QDL", "QGL", "QJL", "QBL"), "Q23225N").when(p.isin("LAL", "LHL"), "LA400")
            .when(p.isin("MGL", "MJL") | (p.isin("PGL", "PJL", "PKL", "PLL") & (poles == 2)), "M800")
            .when(p.isin("PGL", "PJL", "PKL", "PLL"), "P1200"))
    no_flush = base.isin("L600AWK", "L600AWKMC", "Q23225N", "M800", "P1200")
    wall_only = base.isin("L600AWK", "L600AWKMC")
    return (F.when((style == "FLUSH") & ~no_flush, F.concat(base, F.lit("F")))
            .when((style == "SURFACE") & ~wall_only, F.concat(base, F.lit("S")))
            .when(style == "NEMA3R", F.when(wall_only, base).otherwise(
                F.concat(base, F.when(base.isin("B125", "Q23225N"), "RB").otherwise("R")))))


def mccb_part_number(requests: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("frame", "termination", "poles", "amps", "volts", "ka", "trip", "grounding", "phasing")]
    return (requests.withColumn("_p", mccb_part(*cols)).withColumns({"product": F.col("_p.product"), "error": F.col("_p.error")})
            .drop("_p").withColumn("enclosure_product", mccb_enclosure(F.col("product"), F.col("poles"), F.col("style"))))


def _items(items: dict[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("item_type"), v.alias("product")) for k, v in items.items()])


def neutral_sizes(neutrals: DataFrame) -> DataFrame:
    """Neutral ladders, one row of arrays per family; catalogs only."""
    part = lambda size: F.array_sort(F.collect_list(F.when(F.col("size") == size, F.struct("amps", "product"))))
    return neutrals.groupBy("family").agg(part("100%").alias("n100"), part("200%").alias("n200"))


def _neutral(col: str, amps: Column) -> Column:
    return F.get(F.filter(col, lambda n: n["amps"] >= amps), F.lit(0))["product"]


def _trim(box: Column, amps: Column) -> Column:
    style = F.when(F.col("trim") == "FLUSH", "F").otherwise("S")
    return F.concat(F.lit("NC"), box, F.when(amps >= 400, "V").otherwise(""), style)


NO_SE = "Panel not suitable for service entrance."


def nq_parts() -> Column:
    """Interior, box, trim and accessories of a matched NQ panel."""
    amps, box = F.col("matched_amps"), F.col("box").cast("string")
    copper = F.col("material") == "COPPER"
    low = F.col("matched_spaces").isin(30, 42)
    lugs = F.when(F.col("feed_thru") & (amps <= 225), F.when(low, "NQFTL2L").otherwise("NQFTL2H")).when(
        F.col("feed_thru") & (amps == 400), F.when(low, "NQFTL4L").otherwise("NQFTL4H"))
    spd = F.when(F.col("spd_ka").isin(*SPD_KA), F.concat(
        F.lit("SSP0"), F.when(F.col("voltage") == 120, "1").otherwise("2"), F.lit("SBA"),
        F.lpad((F.col("spd_ka") / 10).cast("int").cast("string"), 2, "0"), F.lit("D")))
    return _items({
        "Interior": F.concat("interior", F.when(copper, "C").otherwise("")), "Box": F.concat(F.lit("MH"), box, F.lit("BE")),
        "Trim": F.when(F.col("enclosure") == "NEMA3R", F.concat(F.lit("MH"), box, F.lit("WP"))).otherwise(_trim(box, amps)),
        "Ground Bar Kit": F.when(copper, "PK27GTACU").otherwise("PK27GTA"),
        "Neutral (100%)": _neutral("n100", amps), "Neutral (200%)": _neutral("n200", amps),
        "Feed-Thru Lugs": lugs, "SPD": spd, "Note": F.lit(NO_SE)})


def nf_parts() -> Column:
    amps, box = F.col("matched_amps"), F.col("box").cast("string")
    spaces, copper, outdoor = F.col("matched_spaces"), F.col("material") == "COPPER", F.col("enclosure") == "NEMA3R"
    interior = F.concat("interior", F.when(copper & ~F.col("interior").endswith("C"), "C").otherwise(""))
    wide = F.coalesce(F.try_element_at(_map(NF_OUTDOOR_TRIM), spaces).cast("string"), box)
    impossible = outdoor & (amps == 600) & (spaces == 84)
    trim = (F.when(outdoor & (amps == 600), F.concat(F.lit("MH"), wide, F.lit("WP"))).when(outdoor, F.concat(F.lit("MH"), box, F.lit("WP")))
            .otherwise(F.concat(_trim(box, amps), F.when(amps == 600, "3PNF").otherwise(""))))
    ground = (F.when(copper, "PK27GTACU").when((amps == 125) & (spaces == 18), "PK12GTA").when((amps == 125) & (spaces == 30), "PK18GTA")
              .when((amps == 125) & spaces.isin(42, 54), "PK23GTA").when(amps.isin(250, 400, 600), "PK27GTA"))
    lugs = F.when(F.col("feed_thru"), F.when(amps <= 125, "NF125FTL").when(amps <= 250, "NF250FTL").when(amps <= 400, "NF400FTL"))
    ok = lambda c: F.when(~impossible, c)
    return _items({
        "Interior": ok(interior), "Box": ok(F.concat(F.lit("MH"), box, F.lit("BE"))), "Trim": ok(trim), "Ground Bar Kit": ok(ground),
        "Neutral (100%)": ok(_neutral("n100", amps)), "Neutral (200%)": ok(_neutral("n200", amps)), "Feed-Thru Lugs": ok(lugs),
        "Note": F.when(impossible, "no outdoor trim for this size").otherwise(NO_SE)})


def iline_parts() -> Column:
    amps, outdoor = F.col("matched_amps"), F.col("enclosure") == "NEMA3R"
    copper = F.col("matched_material") == "COPPER"
    kits = _map({f"{s}|{l}": k for s, by in BARRIER_KITS.items() for l, k in by.items()})
    first = _map({s: next(iter(by.values())) for s, by in BARRIER_KITS.items()})
    kit = F.when(F.col("has_main"), F.coalesce(
        F.try_element_at(kits, F.concat_ws("|", "series", F.substring("main_frame", 1, 1))), F.try_element_at(first, F.col("series"))))
    spds = _map({f"{v}|{k}": p for v, by in ILINE_SPD.items() for k, p in by.items()})
    return _items({
        "Interior": F.concat("interior", F.when((F.col("series") == "HCJ") & copper, "CU").otherwise("")),
        "Box": F.concat("box", F.when(outdoor, "WP").otherwise("DB")),
        "Trim": F.when(outdoor, "Included with NEMA3R").otherwise(F.concat("box", F.when(F.col("trim") == "FLUSH", "TF").otherwise("TS"))),
        "SPD": F.try_element_at(spds, F.concat_ws("|", F.col("voltage").cast("string"), F.col("spd_ka").cast("string"))),
        "Neutral": _neutral("n100", amps), "Ground Bar Kit": F.when(copper, "PK32GTACU").otherwise("PK32DGTA"),
        "Service Entrance Kit": kit, "Note": F.when(kit.isNull(), NO_SE)})


def panel_parts(panels: DataFrame, neutrals: DataFrame) -> DataFrame:
    """Parts of matched panels of every family, one row per part.

    Needs family, series, interior, box, matched_amps, matched_spaces, material,
    matched_material, enclosure, trim, voltage, feed_thru, spd_ka, has_main,
    main_frame (null for main-lug panels). One pass: the family picks the item
    list inside the row.
    """
    items = (F.when(F.col("family") == "NQ", nq_parts()).when(F.col("family") == "NF", nf_parts())
             .when(F.col("family") == "I-LINE", iline_parts()))
    return (panels.join(neutral_sizes(neutrals), "family", "left").select("panel_id", F.explode(items).alias("i"))
            .select("panel_id", "i.item_type", "i.product").filter("product IS NOT NULL"))


def external_spd(requests: DataFrame, spd_parts: DataFrame) -> DataFrame:
    """Exact lookup by service and kA; a miss is reported, not raised."""
    out = requests.join(spd_parts, ["service", "ka"], "left")
    return out.withColumn("error", F.when(F.col("product").isNull(), "no surge device for this service and rating"))


def neutral(requests: DataFrame, neutrals: DataFrame) -> DataFrame:
    """Smallest neutral of `family, size` for the amps, null when none is made."""
    sizes = neutrals.groupBy("family", "size").agg(F.array_sort(F.collect_list(F.struct("amps", "product"))).alias("opts"))
    return (requests.withColumnRenamed("amps", "wanted_amps").join(sizes, ["family", "size"], "left")
            .withColumn("product", _neutral("opts", F.col("wanted_amps"))).drop("opts"))


def iline_blank_packs(pieces: DataFrame, blank_packs: DataFrame) -> DataFrame:
    """`panel_id, wide, narrow, extension` piece counts to packs per product."""
    long = pieces.select("panel_id", F.expr("stack(3, 'HLW1BL', wide, 'HLN1BL', narrow, 'HLW4EBL', extension) AS (product, pieces)"))
    packs = F.ceil(F.col("pieces") / F.col("pack_size")).cast("long")
    return (long.filter("pieces > 0").join(blank_packs, "product")
            .select("panel_id", "product", F.col("pieces").cast("long").alias("pieces"), packs.alias("packs"),
                    (packs * F.col("pack_size") * F.col("spaces_each")).alias("covers")))
