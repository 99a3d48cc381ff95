"""Catalog search: interiors for a panel, main breakers, load centres.

Panels ask for few different things. Each distinct request is searched once, its
parts (voltage and size; enclosure, metal and trim) once per distinct part, against the
catalog rows of the part's key; the least row by cost wins. Answers are joined back to
the panels by equality, so no catalog travels with a panel.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.operators.rules.parts import mccb_part
from drawbom.operators.rules.sizing import rating_voltage
from drawbom.operators.spread import held
from drawbom.sources.catalogs import ELECTRONIC, H_AMPS, INTERRUPTING, J_AMPS, LL_AMPS, LOADCENTER_SPACES, Q_AMPS

FAMILY_COST = {"NQ": 0, "NF": 1, "I-LINE": 2}
SERIES_RANK = {"HCJ": 0, "HCP": 1, "HCR-U": 2}
MAX_ILINE_SPACES = 108


def last_wins(catalog: DataFrame, keys: list[str], ord_col: str = "ord") -> DataFrame:
    """Catalog rows with repeated keys reduced to the last one."""
    rest = [c for c in catalog.columns if c not in keys]
    best = catalog.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ord_col)).alias("_row"))
    return best.select(*keys, "_row.*").select(*catalog.columns)


PANEL_KEY = ["family", "main", "min_amps", "max_amps", "spaces", "phase", "voltage"]


def per_request(panels: DataFrame, request: list[str], search) -> DataFrame:
    """`search` over the distinct requests of the panels, once each, joined back to them.

    Requests repeat: there are no more than the catalog tells apart, however many panels."""
    rows = held(panels)
    found = search(held(rows.select(*request).distinct()))
    new = [c for c in found.columns if c not in request]
    answers = found.select(*[F.col(c).alias(f"_q_{c}") for c in request], *new)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_q_{c}")) for c in request])
    return rows.join(answers, same, "left").select(*[F.col(c) for c in panels.columns if c not in new], *new)


def best_row(requests: DataFrame, catalog: DataFrame, on: Column, needs: list[str], fits: Column, order: list[Column], keep: list[str], name: str) -> DataFrame:
    """Adds `name`, the least row by `order` among the catalog rows (columns `o_*`) that meet
    `on` and `fits`. Only what the search `needs` of a request tells searches apart, so
    few are made and each meets the rows of its key."""
    asked = requests.select(*needs).distinct()
    row = F.struct(*[c.alias(f"r{i}") for i, c in enumerate(order)], *[F.col(f"o_{k}").alias(k) for k in keep])
    met = asked.join(catalog, on & fits).groupBy(*needs).agg(F.min(row).alias(name)).withColumnsRenamed({c: f"_n_{c}" for c in needs})
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in needs])
    return requests.join(met, same, "left").drop(*[f"_n_{c}" for c in needs])


def row_columns(catalog: DataFrame) -> DataFrame:
    return catalog.withColumnsRenamed({c: f"o_{c}" for c in catalog.columns})


class Row:
    """A catalog row as `o["column"]`, in the form the rules below take."""

    def __getitem__(self, name: str) -> Column:
        return F.col(f"o_{name}")


def phase_of(volts: Column) -> Column:
    return F.when(volts == 120, "1PHASE").otherwise("3PHASE")


def series_rank(o: Column) -> Column:
    return F.when(o["series"] == "HCJ", 0).when(o["series"] == "HCP", 1).otherwise(2)


def first_rank(amps: Column) -> Column:
    return F.when(amps <= 250, 0).when(amps <= 800, 1).otherwise(2)


def default_series(amps: Column, spaces: Column) -> Column:
    return F.when((amps > 800) | (spaces > 99), "HCR-U").when(amps > 250, "HCP").otherwise("HCJ")


def metal_ok(o: Column, material: Column) -> Column:
    """Copper wants copper; aluminium must be aluminium in the small series."""
    must_be_al = (o["series"] == "HCJ") | ((o["series"] == "HCP") & (o["amps"] <= 600))
    return (F.when(material == "COPPER", o["material"] == "COPPER")
            .when(material == "ALUMINUM", ~must_be_al | (o["material"] == "ALUMINUM")).otherwise(True))


def trim_ok(o: Column, enclosure: Column, trim: Column) -> Column:
    return (enclosure == "NEMA3R") | trim.isNull() | o["trim"].isNull() | (o["trim"] == trim)


def snap_iline_spaces(requests: DataFrame, heavy: DataFrame, main: str, material: str, wanted: Column, out: str) -> DataFrame:
    """Adds `out`: the next real interior size of the `series`, else its largest, at most 108."""
    o, most = Row(), F.lit(MAX_ILINE_SPACES)
    df = requests.withColumn("_want", F.least(most, F.greatest(F.lit(0), wanted)))
    fits = (o["main"] == main) & (o["series"] == F.col("series")) & metal_ok(o, F.col(material)) & trim_ok(o, F.col("enclosure"), F.col("trim"))
    here = o["enclosure"] == F.col("enclosure")
    df = best_row(df, heavy, here, ["enclosure", "series", material, "trim", "_want"], fits & (o["spaces"] >= F.col("_want")), [o["spaces"]], ["spaces"], "_up")
    df = best_row(df, heavy, here, ["enclosure", "series", material, "trim"], fits, [-o["spaces"]], ["spaces"], "_top")
    return df.withColumn(out, F.least(most, F.coalesce("_up.spaces", "_top.spaces", "_want"))).drop("_want", "_up", "_top")


def times_one_and_half(c: Column) -> Column:
    return F.least(F.lit(MAX_ILINE_SPACES), F.ceil(c * 1.5).cast("int"))


REQUEST = ["bus_amps", "spaces", "frame_spaces", "voltage", "enclosure", "material", "trim", "allow_nq", "allow_nf"]


def search_lug_panel(panels: DataFrame, panel_catalog: DataFrame, iline_catalog: DataFrame) -> DataFrame:
    """Main-lug interior per panel.

    Needs the REQUEST columns. Order: family cost, series, excess amps, excess spaces;
    then large 208 V NQ interiors whatever the screen said; then a default.
    """
    o = Row()
    light = row_columns(last_wins(panel_catalog.filter(F.col("main") == "MAIN LUG"), PANEL_KEY))
    heavy = row_columns(iline_catalog.filter(F.col("main") == "MAIN LUG"))

    def search(df: DataFrame) -> DataFrame:
        v, amps, spaces = F.col("voltage"), F.col("bus_amps"), F.col("spaces")
        df = df.withColumns({"_volts": F.when(v == 240, 208).otherwise(v), "_wide": F.greatest(spaces, F.col("frame_spaces")), "_phase": phase_of(v)})
        here, room = o["voltage"] == F.col("_volts"), (o["max_amps"] >= amps) & (o["spaces"] >= spaces)
        needs, tight = ["_volts", "_phase", "bus_amps", "spaces"], [o["max_amps"], o["spaces"], o["ord"]]
        kept = ["family", "max_amps", "spaces", "interior", "box"]
        for name, nq in (("_nq", o["family"] == "NQ"), ("_nf", o["family"] != "NQ")):
            df = best_row(df, light, here & (o["phase"] == F.col("_phase")), needs, room & nq, tight, kept, name)
        df = best_row(df, light, here, ["_volts", "bus_amps", "spaces"], room & (o["family"] == "NQ"), [o["ord"]], kept, "_first")
        fits = ((series_rank(o) >= first_rank(amps)) & metal_ok(o, F.col("material")) & ((F.col("enclosure") == "NEMA3R") | (o["trim"] == F.col("trim")))
                & (o["amps"] >= amps) & (o["spaces"] >= F.col("_wide")))
        df = best_row(df, heavy, o["enclosure"] == F.col("enclosure"), ["enclosure", "material", "trim", "bus_amps", "_wide"], fits,
                      [series_rank(o), o["amps"], o["spaces"], o["ord"]], ["series", "amps", "spaces", "material", "interior", "box"], "_iline")
        plain = lambda c: F.struct(F.col(f"{c}.family"), F.lit(None).cast("string").alias("series"), F.col(f"{c}.max_amps").alias("amps"), F.col(f"{c}.spaces"),
                                   F.col("material"), F.col(f"{c}.interior"), F.col(f"{c}.box").cast("string").alias("box"))
        iline = F.struct(F.lit("I-LINE").alias("family"), F.col("_iline.series"), F.col("_iline.amps"), F.col("_iline.spaces"), F.col("_iline.material"),
                         F.col("_iline.interior"), F.col("_iline.box").cast("string").alias("box"))
        df = df.withColumns({"_best": F.when(F.col("allow_nq") & F.col("_nq").isNotNull(), plain("_nq")).when(F.col("allow_nf") & F.col("_nf").isNotNull(), plain("_nf"))
                             .when(F.col("_iline").isNotNull(), iline), "_chance": F.when((F.col("_volts") == 208) & (spaces >= 84), F.col("_first"))})
        hit, late = F.col("_best").isNotNull(), F.col("_chance").isNotNull()
        fallback = default_series(amps, spaces)
        df = df.withColumns({
            "family": F.when(hit, F.col("_best.family")).when(late, "NQ").otherwise("I-LINE"), "series": F.when(hit, F.col("_best.series")).when(~late, fallback),
            "matched_material": F.when(hit, F.col("_best.material")).when(late | (fallback != "HCR-U"), F.col("material")).otherwise("COPPER")})
        df = snap_iline_spaces(df, heavy, "MAIN LUG", "matched_material", times_one_and_half(spaces), "_snapped")
        df = df.withColumns({
            "matched_amps": F.when(hit, F.col("_best.amps")).when(late, F.col("_chance.max_amps")).otherwise(amps),
            "matched_spaces": F.when(F.col("family") == "I-LINE", F.col("_snapped")).when(hit, F.col("_best.spaces")).otherwise(F.col("_chance.spaces")),
            "interior": F.when(hit, F.col("_best.interior")).otherwise(F.col("_chance.interior")),
            "box": F.when(hit, F.col("_best.box")).otherwise(F.col("_chance.box").cast("string")),
            "tier": F.when(hit, "match").when(late, "last chance").otherwise("default")})
        return df.select(*REQUEST, "family", "series", "matched_material", "matched_amps", "matched_spaces", "interior", "box", "tier")
    return per_request(panels, REQUEST, search)


def search_breaker_panel(panels: DataFrame, panel_catalog: DataFrame, iline_catalog: DataFrame) -> DataFrame:
    """Main-breaker interior per panel: family cost, then smallest range, then
    excess spaces; carries frames and kits of the row for the main breaker."""
    o = Row()
    light = row_columns(last_wins(panel_catalog.filter(F.col("main") == "MAIN BREAKER"), PANEL_KEY))
    heavy = row_columns(iline_catalog.filter(F.col("main") == "MAIN BREAKER"))
    keep = ["family", "max_amps", "spaces", "interior", "box", "frames", "kit", "kit_q"]

    def search(df: DataFrame) -> DataFrame:
        v, amps = F.col("voltage"), F.col("bus_amps")
        df = df.withColumn("want", F.greatest(F.col("spaces"), F.col("frame_spaces")))
        here = (o["voltage"] == v) & (o["phase"] == phase_of(v))
        fits, needs = amps.between(o["min_amps"], o["max_amps"]) & (o["spaces"] >= F.col("want")), ["voltage", "bus_amps", "want"]
        for name, family, order in (("_nq", o["family"] == "NQ", [o["max_amps"], o["spaces"], o["ord"]]), ("_nf", o["family"] != "NQ", [o["max_amps"], o["spaces"], o["ord"]]),
                                    ("_first", o["family"] == "NQ", [o["ord"]])):
            df = best_row(df, light, here, needs, fits & family, order, keep, name)
        row = lambda c: F.struct(*[F.col(f"{c}.{k}") for k in keep])
        df = df.withColumns({"_best": F.when(F.col("allow_nq") & F.col("_nq").isNotNull(), row("_nq")).when(F.col("allow_nf") & F.col("_nf").isNotNull(), row("_nf")),
                             "_chance": F.when((v == 208) & (F.col("want") >= 84) & F.col("_first").isNotNull(), row("_first"))})
        hit, late = F.col("_best").isNotNull(), F.col("_chance").isNotNull()
        either = lambda c: F.when(hit, F.col(f"_best.{c}")).when(late, F.col(f"_chance.{c}"))
        df = df.withColumns({"family": F.coalesce(either("family"), F.lit("I-LINE")), "series": F.when(~hit & ~late, default_series(amps, F.col("want")))})
        df = snap_iline_spaces(df, heavy, "MAIN BREAKER", "material", times_one_and_half(F.col("spaces")), "_snapped")
        df = df.withColumns({"matched_amps": F.coalesce(either("max_amps"), amps), "matched_spaces": F.coalesce(either("spaces"), F.col("_snapped")),
                             **{c: either(c) for c in ("interior", "box", "frames", "kit", "kit_q")},
                             "tier": F.when(hit, "match").when(late, "last chance").otherwise("default")})
        return df.select(*REQUEST, "family", "series", "matched_amps", "matched_spaces", "interior", "box", "frames", "kit", "kit_q", "tier")
    return per_request(panels, REQUEST, search)


ILINE_REQUEST = ["bus_amps", "spaces", "enclosure", "material", "trim"]


def nearest_iline_bucket(panels: DataFrame, iline_catalog: DataFrame, main: str) -> DataFrame:
    """Closest I-Line row: series in order with the metal rule, then the widest
    series without it, then a default that always builds."""
    o, heavy = Row(), row_columns(iline_catalog.filter(F.col("main") == main))

    def search(df: DataFrame) -> DataFrame:
        amps, spaces = F.col("bus_amps"), F.col("spaces")
        here = o["enclosure"] == F.col("enclosure")
        room = (o["amps"] >= amps) & (o["spaces"] >= spaces) & trim_ok(o, F.col("enclosure"), F.col("trim"))
        keep, tail = ["amps", "spaces", "material", "series"], [o["amps"], o["spaces"], o["material"], o["series"]]
        df = best_row(df, heavy, here, ILINE_REQUEST, room & (series_rank(o) >= first_rank(amps)) & metal_ok(o, F.col("material")), [series_rank(o), *tail], keep, "_ranked")
        df = best_row(df, heavy, here, ["bus_amps", "spaces", "enclosure", "trim"], room & (o["series"] == "HCR-U"), tail, keep, "_widest")
        best = lambda c, other: F.coalesce(f"_ranked.{c}", f"_widest.{c}", other)
        return df.select(*ILINE_REQUEST, best("series", F.lit("HCR-U")).alias("bucket_series"), best("amps", F.greatest(amps, F.lit(1200))).alias("bucket_amps"),
                         best("spaces", F.greatest(spaces, F.lit(60))).alias("bucket_spaces"), best("material", F.lit("ALUMINUM")).alias("bucket_material"))
    return per_request(panels, ILINE_REQUEST, search)


def tightest_iline_breaker(panels: DataFrame, iline_catalog: DataFrame) -> DataFrame:
    """Main-breaker I-Line row of the series that the bus size calls for."""
    o, heavy = Row(), row_columns(iline_catalog.filter(F.col("main") == "MAIN BREAKER"))

    def search(df: DataFrame) -> DataFrame:
        amps, spaces = F.col("bus_amps"), F.col("spaces")
        series = F.when(amps < 250, "HCJ").when((amps > 250) & (amps <= 800), "HCP").when(amps > 800, "HCR-U")
        fits = ((o["series"] == series) & (o["material"] == F.col("material")) & (F.col("trim").isNull() | F.coalesce(o["trim"] == F.col("trim"), F.lit(False)))
                & (o["amps"] >= amps) & (o["spaces"] >= spaces))
        df = best_row(df, heavy, o["enclosure"] == F.col("enclosure"), ILINE_REQUEST, fits, [o["amps"], o["spaces"], o["ord"]], ["series", "amps", "spaces"], "_b")
        return df.select(*ILINE_REQUEST, *[F.col(f"_b.{c}").alias(f"tight_{c}") for c in ("series", "amps", "spaces")])
    return per_request(panels, ILINE_REQUEST, search)


def snap_ka(frame: Column, volts: Column, wanted: Column) -> Column:
    """Rating at or above the wanted one, else the highest; as asked where the
    frame has no ratings at this voltage."""
    table = F.create_map(*[x for f, by in INTERRUPTING.items() for v, ks in by.items()
                           for x in (F.lit(f"{f}|{v}"), F.array(*[F.lit(k) for k in sorted(ks)]))])
    ks = F.try_element_at(table, F.concat(frame, F.lit("|"), volts.cast("string")))
    return F.coalesce(F.array_min(F.filter(ks, lambda k: k >= wanted)), F.array_max(ks), wanted)


MAIN_LADDERS = {"H": H_AMPS, "J": J_AMPS, "Q": Q_AMPS, "LL": LL_AMPS, "L": ELECTRONIC["L"], "M": ELECTRONIC["M"],
                "P": ELECTRONIC["P"], "R": [600, 800, 1000, 1200, 1600, 2000, 2500, 3000]}


def size_main_breaker(panels: DataFrame) -> DataFrame:
    """Main breaker part and kit from the frames of the matched interior.

    `frames` lists frame letters in order; the first frame whose ladder, rating
    and poles give a valid part is taken. All candidates are tried in the row.
    """
    v = F.when(F.col("voltage") == 120, 240).otherwise(rating_voltage(F.col("voltage")))
    ladders = F.create_map(*[x for f, a in MAIN_LADDERS.items() for x in (F.lit(f), F.array(*[F.lit(n) for n in a]))])

    def attempt(frame: Column) -> Column:
        ka = snap_ka(frame, v, F.col("int_rating"))
        trip = F.when(frame.isin("LL", "H", "J"), "MAGNETIC").otherwise("ELECTRONIC")
        poles = F.when((F.col("voltage") == 120) & (frame == "Q"), 2).otherwise(3)
        amps = F.array_min(F.filter(F.try_element_at(ladders, frame), lambda a: a >= F.col("main_amps")))
        part = lambda k: mccb_part(F.substring(frame, 1, 1), F.lit("LUG"), poles, amps, v, k,
                                   F.when(frame == "Q", "MAGNETIC").otherwise(trip), F.lit(False), F.lit(""))["product"]
        return F.struct(F.coalesce(part(ka), part(snap_ka(frame, v, ka + 1))).alias("product"), frame.alias("frame"))

    tried = F.filter(F.transform(F.split("frames", ","), attempt), lambda t: t["product"].isNotNull())
    return panels.withColumn("_m", F.get(tried, F.lit(0))).withColumns({
        "main_product": F.col("_m.product"), "main_frame": F.col("_m.frame"),
        "main_kit": F.when(F.coalesce(F.col("_m.frame"), F.get(F.split("frames", ","), F.lit(0))) == "Q", F.col("kit_q")).otherwise(F.col("kit")),
        "main_error": F.when(F.col("frames").isNotNull() & F.col("_m").isNull(), "no valid main breaker"),
    }).drop("_m")


def loadcenter_first(panels: DataFrame, loadcenters: DataFrame) -> DataFrame:
    """Load centre for 120 V panels without surge device, null otherwise.

    Both families are exact lookups on all eleven attributes; the metal of the
    bus decides which is tried first.
    """
    snapped = F.coalesce(*[F.when(F.col("spaces") <= s, s) for s in LOADCENTER_SPACES], F.lit(LOADCENTER_SPACES[-1]))
    wanted = panels.withColumns({
        "_candidate": (F.col("voltage") == 120) & ~F.coalesce("spd", F.lit(False)) & (F.col("bus_amps") > 0),
        "_spaces": snapped, "_main": F.when(F.col("main_amps").isNotNull(), "M").otherwise("L"),
        "_enclosure": F.when(F.col("enclosure") == "NEMA3R", "NEMA3R").otherwise("NEMA1"),
        "_style": F.initcap("trim"),
        "_first": F.when(F.col("material") == "COPPER", "QO").otherwise("HOM"),
        "_second": F.when(F.col("material") == "COPPER", "HOM").otherwise("QO")})

    def lookup(df: DataFrame, family: str, tag: str) -> DataFrame:
        c = loadcenters.select(*[F.col(x).alias(f"{tag}_{x}") for x in loadcenters.columns])
        on = {"family": F.col(family), "enclosure": F.col("_enclosure"), "phasing": F.lit("1PHASE"), "main": F.col("_main"),
              "amps": F.col("bus_amps"), "spaces": F.col("_spaces"), "plug_on": F.col("plug_on"), "cover_style": F.col("_style"),
              "value_pack": F.lit(False), "application": F.lit("Standard"), "quik_grip": F.lit(False)}
        cond = reduce(lambda a, b: a & b, [F.col(f"{tag}_{k}") == x for k, x in on.items()])
        return df.join(c, cond & F.col("_candidate"), "left")

    both = lookup(lookup(wanted, "_first", "a"), "_second", "b")
    return both.select(*panels.columns, F.coalesce("a_product", "b_product").alias("product"),
                       F.when(F.col("a_product").isNotNull(), F.col("a_family")).otherwise(F.col("b_family")).alias("family"),
                       F.when(F.col("a_product").isNotNull(), F.col("a_cover")).otherwise(F.col("b_cover")).alias("cover"),
                       F.when(F.coalesce("a_product", "b_product").isNotNull(), F.col("_spaces")).alias("lc_spaces"))
