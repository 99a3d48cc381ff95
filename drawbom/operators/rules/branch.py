"""Branch breaker part numbers and fillers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.operators.rules.sizing import BASE_KA, choose_base_family, ladder_arrays, next_size

NF_KA = [18, 35, 65]
NF_PREFIX = {18: "EDB", 35: "EGB", 65: "EJB"}
FEATURES_15_20 = ["CAFI", "PCAFI", "GFI", "DF", "PDF", "EPD", "HM"]
FEATURES_LARGER = ["GFI", "EPD"]           # 25, 30, 40, 50 and 60 A


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def feature_allowed(base: Column, amps: Column, feature: Column) -> Column:
    standard = ((amps.isin(15, 20) & feature.isin(*FEATURES_15_20))
                | (amps.isin(25, 30, 40, 50, 60) & feature.isin(*FEATURES_LARGER)))
    return (feature == "") | (~base.isin("QH", "QHB") & standard)


def nq_branch_lines(panels: DataFrame, breakers: DataFrame, ladder: DataFrame) -> DataFrame:
    """Part number or note per breaker line.

    Needs `voltage, int_rating, plug_on, series_rated` on the panels. A one-pole
    QOH does not exist and becomes the high-rated base; a rating above the
    ladder or a feature the base lacks gives a note instead of a part.
    """
    p = panels.select("panel_id", "voltage", "int_rating", "plug_on", "series_rated")
    base = choose_base_family(F.col("int_rating"), F.col("voltage"), F.col("plug_on"), F.col("series_rated"), F.col("poles"))
    arrays = ladder_arrays(ladder, ["family", "poles"])
    high = F.when(F.col("plug_on"), "QH").otherwise("QHB")
    rows = (breakers.join(p, "panel_id").withColumn("family", base).join(arrays, ["family", "poles"], "left")
            .withColumn("amps", next_size(F.col("ratings"), F.col("amperage"))))
    single = (F.col("family") == "QOH") & (F.col("poles") != 2) & F.col("amps").isNotNull()
    fallback = arrays.filter(F.col("family") == "QH").select("poles", F.col("ratings").alias("high_ratings"))
    rows = (rows.join(fallback, "poles", "left")
            .withColumn("too_big", F.col("amps").isNull())
            .withColumn("amps", F.when(single, next_size(F.col("high_ratings"), F.col("amperage"))).otherwise(F.col("amps")))
            .withColumn("base", F.when(single, high).otherwise(F.col("family"))))
    base, amps, feat = F.col("base"), F.col("amps"), F.upper(F.coalesce("special_features", F.lit("")))
    number = F.concat(
        F.replace(base, F.lit("-VH"), F.lit("")), F.when(base == "QOH", "2").otherwise(F.col("poles").cast("string")),
        amps.cast("string"), F.when(F.contains(base, F.lit("-VH")), "VH").otherwise(""),
        F.when(base.isin("QOH", "QH", "QHB"), "").otherwise(feat))
    note = (F.when(F.col("too_big"), "exceeds branch maximum").when(amps.isNull(), "no amperage for the high-rated base")
            .when(~feature_allowed(base, amps, feat), "special feature not available"))
    ka = F.concat(literal_map(BASE_KA)[base].cast("string"), F.lit("k"))
    return rows.select("panel_id", "poles", "amperage", "cnt", F.when(note.isNull(), number).alias("product"),
                       F.when(note.isNull(), ka).alias("rating"), note.alias("note"))


def nf_branch_lines(panels: DataFrame, breakers: DataFrame, ladder: DataFrame) -> DataFrame:
    """E-frame part per breaker line; ratings above a ladder take its largest."""
    p = panels.select("panel_id", "int_rating", "series_rated")
    arrays = ladder_arrays(ladder.filter(F.col("family") == "E"), ["poles"])
    ka = next_size(F.array(*[F.lit(k) for k in NF_KA]), F.when(F.col("series_rated"), 18).otherwise(F.col("int_rating")), "max")
    rows = (breakers.join(p, "panel_id").join(arrays, "poles", "left")
            .withColumn("amps", next_size(F.col("ratings"), F.col("amperage"), "max")).withColumn("ka", ka))
    number = F.concat(literal_map(NF_PREFIX)[F.col("ka")], F.col("poles").cast("string"), F.lit("4"),
                      F.lpad(F.col("amps").cast("string"), 3, "0"))
    return rows.select("panel_id", "poles", "amperage", "cnt", number.alias("product"),
                       F.concat(F.col("ka").cast("string"), F.lit("kA")).alias("rating"),
                       F.lit(None).cast("string").alias("note"))


def summarise_branch(lines: DataFrame) -> DataFrame:
    """Quantity per panel and part; lines without a part keep their note."""
    return lines.groupBy("panel_id", "product", "rating", "note").agg(F.sum("cnt").cast("long").alias("qty"))


def remaining_and_fillers(panels: DataFrame, breakers: DataFrame, fillers: DataFrame) -> DataFrame:
    """Blank spaces and filler packs per panel; `panel_type` picks the pack."""
    used = breakers.groupBy("panel_id").agg(F.sum(F.col("poles") * F.col("cnt")).cast("long").alias("used"))
    used_c = F.coalesce("used", F.lit(0).cast("long"))
    left = F.greatest(F.lit(0).cast("long"), F.col("spaces") - F.col("used"))
    packs = F.ceil(F.col("blanks") / F.col("pack_size")).cast("long")
    return (panels.join(used, "panel_id", "left").withColumn("used", used_c).withColumn("blanks", left)
            .join(fillers, "panel_type", "left")
            .select("panel_id", "used", "blanks", F.when(F.col("blanks") > 0, F.col("product")).alias("product"),
                    F.when(F.col("blanks") > 0, packs).otherwise(0).cast("long").alias("packs"),
                    ((F.col("spaces") > 0) & (F.col("used") > F.col("spaces"))).alias("overflow")))
