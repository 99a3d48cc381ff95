"""Disconnects, transformers and the dispatch of mixed item lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.sources.catalogs import FUSES

# Fixed values -------------------------------------------------------------
TYPE_CHAIN = ["3PHASESTANDARD", "3PHASE115DEGREE", "3PHASE80DEGREE", "1PHASESTANDARD", "RESIN", "K13", "WATCHDOG"]
LUGS = {15.0: ("DASKP100", "DASKGS100"), 30.0: ("DASKP100", "DASKGS100"), 45.0: ("DASKP250", "DASKGS250"),
        75.0: ("DASKP250", "DASKGS250"), 112.5: ("DASKP400", "DASKGS400"), 150.0: ("DASKP600", "DASKGS600"),
        225.0: ("DASKP1000", "DASKGS1000"), 300.0: ("DASKP1000", "DASKGS1000"), 500.0: (None, "DASKGS2000")}
# --------------------------------------------------------------------------


def resolve_disconnects(items: DataFrame, catalog: DataFrame, default_enclosure: str = "NEMA1",
                        default_fusible: bool = True) -> DataFrame:
    """Switch, kits and fuses per item, or the reason why there is none.

    Three attempts in order: the duty that volts and amps call for, heavy duty,
    and, when the enclosure was not given, the other standard enclosure. Each is
    a lookup in a per-configuration ladder, so items stay in their partitions.
    """
    amps, volts = F.col("amps"), F.col("voltage")
    base = items.withColumns({
        "_fus": F.coalesce("fusible", F.lit(default_fusible)), "_enc": F.coalesce(F.upper("enclosure"), F.lit(default_enclosure)),
        "_poles": F.coalesce("poles", F.lit(3))})
    gd = (volts <= 240) & (amps <= F.when(F.col("_fus"), 800).otherwise(600))
    hd = (volts <= 600) & (amps <= 1200)
    missing = F.concat_ws(", ", F.when(~F.coalesce(amps > 0, F.lit(False)), "amps"), F.when(~F.coalesce(volts > 0, F.lit(False)), "voltage"))
    base = base.withColumns({
        "_duty": F.when(gd, "GENERAL_DUTY").when(hd, "HEAVY_DUTY"),
        "_missing": missing,
        "_fuse_ok": ~F.col("_fus") | F.col("fuse_amps").isNull() | F.col("fuse_amps").isin(*FUSES)})
    ladder = (catalog.withColumn("poles", F.coalesce("poles", F.lit(0)))
              .groupBy("family", "fusible", "poles", "volts", "enclosure")
              .agg(F.array_sort(F.collect_list(F.struct("amps", "product", "ground_kit", "neutral_kit"))).alias("opts")))

    def attempt(df: DataFrame, n: int, family: Column, enclosure: Column, wanted: Column) -> DataFrame:
        side = ladder.select(*[F.col(c).alias(f"_l_{c}") for c in ladder.columns])
        poles = F.when((family == "GENERAL_DUTY") & ~F.col("_fus"), 0).otherwise(F.col("_poles"))
        on = ((F.col("_l_family") == family) & (F.col("_l_fusible") == F.col("_fus")) & (F.col("_l_poles") == poles)
              & (F.col("_l_volts") == F.when(family == "GENERAL_DUTY", 240).otherwise(600)) & (F.col("_l_enclosure") == enclosure))
        hit = F.when(wanted & F.col("_fuse_ok"), F.get(F.filter("_l_opts", lambda o: o["amps"] >= amps), F.lit(0)))
        keep = [c for c in df.columns]
        return df.join(side, on, "left").select(*keep, hit.alias(f"_a{n}"))

    usable = (F.col("_missing") == "") & F.col("_duty").isNotNull()
    other = F.when(F.col("_enc") == "NEMA1", "NEMA3R").otherwise("NEMA1")
    df = attempt(base, 1, F.col("_duty"), F.col("_enc"), usable)
    df = attempt(df, 2, F.lit("HEAVY_DUTY"), F.col("_enc"), usable & (F.col("_duty") == "GENERAL_DUTY"))
    df = attempt(df, 3, F.lit("HEAVY_DUTY"), other, usable & F.col("enclosure").isNull())
    first = F.col("_a1").isNotNull()
    df = df.withColumn("_hit", F.coalesce("_a1", "_a2", "_a3")).withColumn(
        "duty", F.when(first, F.col("_duty")).otherwise("HEAVY_DUTY"))
    found, heavy_open = F.col("_hit").isNotNull(), (F.col("duty") == "HEAVY_DUTY") & ~F.col("_fus")
    escalated = (F.when(F.col("_duty") == "HEAVY_DUTY", F.when(volts > 240, "Escalated to Heavy Duty: Voltage > 240V")
                        .otherwise("Escalated to Heavy Duty: Amperage exceeds GD limit"))
                 .when(~first, "Escalated to Heavy Duty: no General Duty table match"))
    snapped = F.when(F.col("_hit.amps") != amps, F.concat(F.lit("Amperage snapped "), amps.cast("string"), F.lit(" to "),
                                                         F.col("_hit.amps").cast("string")))
    no_neutral = F.when(heavy_open & F.col("neutral"), "Neutral omitted: not available on Heavy Duty non-fusible")
    given = F.when(F.upper("enclosure") != default_enclosure, F.concat(F.lit("Enclosure overridden to "), F.upper("enclosure")))
    fuse = F.concat(F.col("_poles").cast("string"), F.lit(" - "), F.when(F.col("duty") == "HEAVY_DUTY", "FLSR").otherwise("FLNR"),
                    F.lpad(F.coalesce("fuse_amps", "_hit.amps").cast("string"), 3, "0"))
    fuse_width_ok = F.coalesce("fuse_amps", "_hit.amps") < 1000
    fuse = F.when(fuse_width_ok, fuse).otherwise(F.concat(
        F.col("_poles").cast("string"), F.lit(" - "), F.when(F.col("duty") == "HEAVY_DUTY", "FLSR").otherwise("FLNR"),
        F.coalesce("fuse_amps", "_hit.amps").cast("string")))
    error = (F.when(F.col("_missing") != "", F.concat(F.lit("Missing required attributes: "), F.col("_missing")))
             .when(F.col("_duty").isNull(), "no valid duty").when(~F.col("_fuse_ok"), "invalid fuse amperage")
             .when(~found, "invalid disconnect configuration"))
    return df.select(
        "item_id", F.when(found, F.col("duty")).alias("duty"), F.col("_hit.product").alias("product"), F.col("_hit.amps").alias("rated_amps"),
        F.col("_hit.ground_kit").alias("ground_kit"), F.when(F.col("neutral") & ~heavy_open, F.col("_hit.neutral_kit")).alias("neutral_kit"),
        F.when(found & F.col("_fus"), fuse).alias("fuses"),
        F.when(found, F.concat_ws("; ", given, no_neutral, escalated, snapped)).alias("notes"), error.alias("error"))


def resolve_transformers(items: DataFrame, catalog: DataFrame, default_core: str = "ALUMINUM", default_temp: int = 150,
                         resin_enclosure: str = "3R") -> DataFrame:
    """First catalog hit over type chain, core and kVA order.

    kVA order: exact, then larger ascending, then smaller descending. All
    attempts are ranked inside the row against the catalog rows that share
    voltages and temperature.
    """
    kva = F.col("kva")
    cols = ["type", "core", "kva", "product"]
    side = (catalog.withColumnsRenamed({"type": "c_type", "core": "c_core", "kva": "c_kva"})
            .groupBy("primary_volts", "secondary_volts", "temperature")
            .agg(F.array_sort(F.collect_list(F.struct("c_type", "c_core", "c_kva", "product"))).alias("opts")))
    df = items.withColumns({"_core": F.coalesce(F.upper("core"), F.lit(default_core)),
                            "_type": F.upper("type"), "temperature": F.coalesce("temperature", F.lit(default_temp))})
    df = df.join(side, ["primary_volts", "secondary_volts", "temperature"], "left")
    chain = F.array(*[F.lit(t) for t in TYPE_CHAIN])
    resin = F.array_distinct(F.array(F.lit(resin_enclosure), F.lit("SS"), F.lit("4X")))
    metal = F.when(F.col("_core") == "COPPER", F.array(F.lit("COPPER"))).otherwise(F.array(F.lit("ALUMINUM"), F.lit("COPPER")))
    t_rank = lambda o: F.when(F.col("_type").isNull(), F.array_position(chain, o["c_type"])).otherwise((o["c_type"] == F.col("_type")).cast("long"))
    c_rank = lambda o: F.array_position(F.when(o["c_type"] == "RESIN", resin).otherwise(metal), o["c_core"])
    fits = F.filter("opts", lambda o: (t_rank(o) > 0) & (c_rank(o) > 0))
    best = F.array_min(F.transform(fits, lambda o: F.struct(
        t_rank(o).alias("t"), c_rank(o).alias("c"), F.when(o["c_kva"] == kva, 0).when(o["c_kva"] > kva, 1).otherwise(2).alias("dir"),
        F.abs(o["c_kva"] - kva).alias("dist"), o["c_type"].alias("type"), o["c_core"].alias("core"), o["c_kva"].alias("kva"),
        o["product"].alias("product"))))
    df = df.withColumn("_b", best)
    found = F.col("_b").isNotNull()
    notes = F.concat_ws(
        " | ", F.when(F.col("_b.kva") != kva, "kVA snapped"), F.when(F.col("_b.type") != F.coalesce("_type", F.lit(TYPE_CHAIN[0])), F.concat(F.lit("type escalated to "), F.col("_b.type"))),
        F.when((F.col("_b.type") == "RESIN") & (F.col("_b.core") != resin_enclosure), F.concat(F.lit("enclosure overridden to "), F.col("_b.core"))),
        F.when((F.col("_b.type") != "RESIN") & (F.col("_core") != "COPPER") & (F.col("_b.core") == "COPPER"), "winding upgraded to COPPER"))
    lug = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in LUGS.items() if v[i] for x in (k, v[i])]), F.col("_b.kva"))
    dry = F.col("_b.type").startswith("3PHASE") | (F.col("_b.type") == "K13")
    return df.select("item_id", F.col("_b.type").alias("type"), F.col("_b.core").alias("core"), F.col("_b.kva").alias("kva"),
                     F.col("_b.product").alias("product"), F.when(dry, lug(0)).alias("primary_lugs"), F.when(dry, lug(1)).alias("secondary_lugs"),
                     F.when(found, notes).alias("notes"), F.when(~found, "invalid transformer configuration").alias("error"))


def quote(items: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """One outcome per item of a mixed list, each type answered by its engine.

    `results[type]` has `item_id, product, error`. Unknown or empty types and
    failing items stay in the output with a reason, so nothing stops a batch.
    """
    known = list(results)
    kind = F.lower(F.trim("type"))
    named = items.withColumn("name", F.when(F.trim(F.coalesce("name", F.lit(""))).isin("", "NONE"), "name not detected").otherwise(F.trim("name")))
    parts = [named.filter(kind == t).join(r.select("item_id", "product", "error"), "item_id", "left")
             .select("item_id", "name", "product", F.when(F.col("product").isNull(), F.coalesce("error", F.lit("engine gave no result"))).alias("reason"))
             for t, r in results.items()]
    rest = named.filter(~F.coalesce(kind.isin(*known), F.lit(False))).select(
        "item_id", "name", F.lit(None).cast("string").alias("product"),
        F.when(F.coalesce(kind, F.lit("")) == "", "missing or invalid type").otherwise("unknown item type").alias("reason"))
    return reduce(DataFrame.unionByName, [*parts, rest])
