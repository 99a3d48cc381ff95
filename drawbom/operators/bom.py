"""Bill of materials rows from quote items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.functions.electrical import breaker_desc_from_pn
from drawbom.operators.spread import numbered

SE_ITEMS = ["Service Entrance Kit", "Service Entrance Barrier Kit"]
ATTRIBUTES = ["bus_amps", "voltage", "int_rating", "spaces", "main_amps"]
UNORDERED = 999


def bom_rows(quotes: DataFrame, bom_policy: DataFrame) -> DataFrame:
    """Section order and selection flags for `panel_id, item_type, product,
    qty, notes`; an unknown item type is listed last and cannot be ordered."""
    policy = bom_policy.withColumnRenamed("ord", "section")
    out = quotes.filter(F.trim(F.coalesce("product", F.lit(""))) != "").join(policy, "item_type", "left")
    return out.select("panel_id", "item_type", F.trim("product").alias("product"), F.col("qty").cast("long").alias("qty"),
                      F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("section", F.lit(UNORDERED)).alias("section"),
                      F.coalesce("selectable", F.lit(False)).alias("selectable"), F.coalesce("include", F.lit(False)).alias("include"))


def suppress_service_entrance(bom: DataFrame) -> DataFrame:
    """Without service entrance kits where any text calls the panel unsuitable.

    The unsuitable panels are a distinct set first, and only kit rows meet it.
    """
    unsuitable = bom.filter(F.contains(F.lower("product"), F.lit("not suitable")) & F.col("item_type").isin("Note", *SE_ITEMS))
    unsuitable = unsuitable.select("panel_id").distinct()
    kits = F.col("item_type").isin(*SE_ITEMS)
    return bom.filter(~kits).unionByName(bom.filter(kits).join(unsuitable, "panel_id", "left_anti"))


def order_bom(bom: DataFrame, panels: DataFrame) -> DataFrame:
    """Row number per job in display order: panel order, section, type, product.

    Panels unknown to the table come last, by panel_id. Rows are numbered by
    a prefix scan, so one job may hold most of the rows.
    """
    known = panels.select("panel_id", "job_id", F.col("ord").alias("panel_ord"))
    df = bom.join(known, "panel_id", "left").withColumn("panel_ord", F.coalesce("panel_ord", F.lit(2**62) + F.col("panel_id") % 2**61))
    df = df.withColumn("job_id", F.coalesce("job_id", F.lit(-1)))
    order = [F.col(c) for c in ("panel_ord", "section", "item_type", "product", "notes", "qty")]
    return numbered(df, ["job_id"], order, "row_no")


def kilo(c: Column) -> Column:
    return F.concat(c.cast("string"), F.lit("K"))


def describe_bom(bom: DataFrame, panels: DataFrame) -> DataFrame:
    """Adds the description shown beside a product."""
    shown = lambda c, unit: F.when(F.col(c) != 0, F.concat(F.col(c).cast("string"), F.lit(unit)))
    text = F.concat_ws(", ", shown("bus_amps", "A Bus"), shown("voltage", "V"), kilo(F.col("int_rating")), shown("spaces", "ckt"),
                       shown("main_amps", "A MB"))
    attrs = panels.select("panel_id", text.alias("_interior"), F.col("enclosure").alias("_enc"), F.col("trim").alias("_trim"))
    pn = F.upper("product")
    trim = (F.when(F.col("_enc") == "NEMA3R", "3R").when(F.col("_trim").isin("FLUSH", "SURFACE"), F.initcap("_trim"))
            .when(pn.endswith("F"), "Flush").when(pn.endswith("S"), "Surface").otherwise(""))
    desc = (F.when(F.col("item_type").isin("Interior", "Interior/Box"), F.col("_interior"))
            .when(F.col("item_type").isin("Trim", "Trim/Cover", "Cover"), trim)
            .when(F.col("item_type") == "Breaker", breaker_desc_from_pn(F.col("product"))).otherwise(""))
    return (bom.join(attrs, "panel_id", "left").withColumn("description", F.coalesce(desc, F.lit("")))
            .drop("_interior", "_enc", "_trim"))


def hide_empty_panels(bom: DataFrame, panels: DataFrame) -> DataFrame:
    """Rows of panels that have an attribute and something to order."""
    some = F.coalesce(*ATTRIBUTES).isNotNull()
    orderable = bom.filter("selectable").select("panel_id").distinct()
    shown = panels.filter(some).select("panel_id").join(orderable, "panel_id", "left_semi")
    return bom.join(shown, "panel_id", "left_semi")


def panel_table(panels: DataFrame) -> DataFrame:
    """One display row per panel; missing values read NONE."""
    text = lambda c, unit="": F.coalesce(F.concat(F.nullif(c, F.lit(0)).cast("string"), F.lit(unit)), F.lit(f"NONE{unit}"))
    return panels.select(
        "panel_id", F.coalesce(F.nullif(F.trim("raw_name"), F.lit("")), F.lit("(unnamed)")).alias("name"),
        text("bus_amps", "A").alias("bus"), text("voltage", "V").alias("volts"),
        F.coalesce(kilo(F.col("int_rating")), F.lit("NONE")).alias("rating"), text("spaces", "ckt").alias("spaces"),
        text("main_amps").alias("main"))


def bom_totals(bom: DataFrame, panels: DataFrame, by_panel: bool = False) -> DataFrame:
    """Included quantity per job and product; with `by_panel` also the subtotals
    of each panel and job (rollup, a missing level reads null)."""
    rows = bom.filter("include").join(panels.select("panel_id", "job_id"), "panel_id")
    grouped = rows.rollup("job_id", "panel_id", "product") if by_panel else rows.groupBy("job_id", "product")
    return grouped.agg(F.sum("qty").cast("long").alias("qty"))
