"""Queries over the bill of materials."""

from pyspark.sql import functions as F

from drawbom.operators import bom as bm
from drawbom.operators.rules import branch as br, sizing as sz
from drawbom.plans.registry import query
from drawbom.plans.rules_basic import FILL, NF_LINES, configured, typed_panels

OVERFLOW = "too many breakers detected. user review required."
UNSUITABLE = "Panel not suitable for service entrance."
_NF_ONLY = NF_LINES[NF_LINES.index(", cfg AS") + 2:]
QUOTES = FILL + ", " + _NF_ONLY + f""", quotes AS (
  SELECT panel_id, 'Breaker' AS item_type, product, CAST(sum(cnt) AS BIGINT) AS qty, 'IR: ' || rating AS notes FROM nf_lines GROUP BY panel_id, product, rating
  UNION ALL SELECT panel_id, 'Blanks/Filler', product, CAST(ceil(blanks / pack_size) AS BIGINT), '' FROM filled WHERE blanks > 0
  UNION ALL SELECT panel_id, 'Note', '{OVERFLOW}', 0, '' FROM filled WHERE spaces > 0 AND used > spaces
  UNION ALL SELECT panel_id, 'Interior', 'NF4' || spaces, 1, '' FROM panels UNION ALL SELECT panel_id, 'Trim', 'NC' || bus_amps || CASE WHEN panel_id % 2 = 0 THEN 'F' ELSE 'S' END, 1, NULL FROM panels
  UNION ALL SELECT panel_id, 'Service Entrance Kit', 'SEK' || bus_amps, 1, '' FROM panels WHERE panel_id % 3 = 0 UNION ALL SELECT panel_id, 'Note', '{UNSUITABLE}', 0, 'Service Entrance' FROM panels WHERE panel_id % 4 = 1
  UNION ALL SELECT panel_id, 'Meter', 'M1', 1, '' FROM panels WHERE panel_id % 10 = 0),
  bom AS MATERIALIZED (SELECT q.panel_id, q.item_type, trim(product) AS product, CAST(qty AS BIGINT) AS qty, coalesce(notes, '') AS notes, coalesce(p.ord, 999) AS section, coalesce(selectable, FALSE) AS selectable, coalesce(include, FALSE) AS include
    FROM quotes q LEFT JOIN bom_policy p ON p.item_type = q.item_type)"""
T = "panels breakers ladder fillers bom_policy"


def quotes_of(panels, breakers, ladder, fillers):
    """Quote items of every panel: branch breakers, fillers, enclosure parts, notes."""
    use = sz.usable_breakers(panels, breakers)
    lines = br.summarise_branch(br.nf_branch_lines(configured(panels), use, ladder))
    fill = br.remaining_and_fillers(typed_panels(panels), use, fillers)
    k = F.col("panel_id")

    def rows(df, item, product, qty, notes):
        return df.select("panel_id", F.lit(item).alias("item_type"), product.alias("product"), F.lit(qty).cast("long").alias("qty") if isinstance(qty, int) else qty.cast("long").alias("qty"), notes.alias("notes"))

    none, empty = F.lit(None).cast("string"), F.lit("")
    bus = F.col("bus_amps").cast("string")
    fixed = F.array_compact(F.array(
        F.struct(F.lit("Interior").alias("item_type"), F.concat(F.lit("NF4"), F.col("spaces").cast("string")).alias("product"), F.lit(1).alias("qty"), empty.alias("notes")),
        F.struct(F.lit("Trim").alias("item_type"), F.concat(F.lit("NC"), bus, F.when(k % 2 == 0, "F").otherwise("S")).alias("product"), F.lit(1).alias("qty"), none.alias("notes")),
        F.when(k % 3 == 0, F.struct(F.lit("Service Entrance Kit").alias("item_type"), F.concat(F.lit("SEK"), bus).alias("product"), F.lit(1).alias("qty"), empty.alias("notes"))),
        F.when(k % 4 == 1, F.struct(F.lit("Note").alias("item_type"), F.lit(UNSUITABLE).alias("product"), F.lit(0).alias("qty"), F.lit("Service Entrance").alias("notes"))),
        F.when(k % 10 == 0, F.struct(F.lit("Meter").alias("item_type"), F.lit("M1").alias("product"), F.lit(1).alias("qty"), empty.alias("notes")))))
    parts = panels.select("panel_id", F.explode(fixed).alias("i")).select("panel_id", "i.item_type", "i.product", F.col("i.qty").cast("long").alias("qty"), "i.notes")
    out = rows(lines, "Breaker", F.col("product"), F.col("qty"), F.concat(F.lit("IR: "), F.col("rating")))
    return (out.unionByName(rows(fill.filter("blanks > 0"), "Blanks/Filler", F.col("product"), F.col("packs"), empty))
            .unionByName(rows(fill.filter("overflow"), "Note", F.lit(OVERFLOW), 0, empty)).unionByName(parts))


def bom_of(panels, breakers, ladder, fillers, bom_policy):
    return bm.bom_rows(quotes_of(panels, breakers, ladder, fillers), bom_policy)


@query("m1_bom_rows", T, "WITH " + QUOTES + " SELECT * FROM bom")
def m1(*t):
    return bom_of(*t)


@query("m2_suppress_service_entrance", T, "WITH " + QUOTES + """ SELECT * FROM bom WHERE NOT (item_type = 'Service Entrance Kit' AND panel_id IN (SELECT panel_id FROM bom WHERE item_type = 'Note' AND lower(product) LIKE '%not suitable%'))""")
def m2(*t):
    return bm.suppress_service_entrance(bom_of(*t))


@query("m3_order_bom", T, "WITH " + QUOTES + """ SELECT p.job_id, b.panel_id, b.item_type, b.product, b.qty, row_number() OVER (PARTITION BY p.job_id ORDER BY p.ord, section, item_type, product, notes, qty) AS row_no
  FROM bom b JOIN panels p ON p.panel_id = b.panel_id""")
def m3(panels, *t):
    return bm.order_bom(bom_of(panels, *t), panels).select("job_id", "panel_id", "item_type", "product", "qty", "row_no")


@query("m4_describe_bom", T, "WITH " + QUOTES + r""" SELECT b.panel_id, b.item_type, b.product, b.qty, b.notes, coalesce(CASE WHEN b.item_type = 'Interior' THEN concat_ws(', ', bus_amps || 'A Bus', voltage || 'V', int_rating || 'K', p.spaces || 'ckt', main_amps || 'A MB')
    WHEN b.item_type = 'Trim' THEN CASE WHEN job_id % 3 = 0 THEN '3R' WHEN p.panel_id % 4 = 3 THEN CASE right(b.product, 1) WHEN 'F' THEN 'Flush' WHEN 'S' THEN 'Surface' ELSE '' END WHEN p.panel_id % 2 = 0 THEN 'Flush' ELSE 'Surface' END
    WHEN b.item_type = 'Breaker' THEN regexp_replace(b.product, '^[A-Z]+([0-9])4([0-9]{3})$', '\2') || 'A ' || regexp_replace(b.product, '^[A-Z]+([0-9])4([0-9]{3})$', '\1') || 'P' ELSE '' END, '') AS d
  FROM bom b JOIN panels p ON p.panel_id = b.panel_id""".replace("SELECT b.panel_id, b.item_type, b.product, b.qty, b.notes, coalesce", "SELECT panel_id, item_type, product, qty, notes, regexp_replace(d, '^0+', '') AS description FROM (SELECT b.panel_id, b.item_type, b.product, b.qty, b.notes, coalesce") + ") x")
def m4(panels, *t):
    shown = panels.withColumns({"enclosure": F.when(F.col("job_id") % 3 == 0, "NEMA3R").otherwise("NEMA1"),
                                "trim": F.when(F.col("panel_id") % 4 == 3, None).when(F.col("panel_id") % 2 == 0, "FLUSH").otherwise("SURFACE")})
    return bm.describe_bom(bom_of(panels, *t), shown).select("panel_id", "item_type", "product", "qty", "notes", "description")


@query("m5_hide_empty_panels", T, "WITH " + QUOTES + """ SELECT panel_id, item_type, product, qty FROM bom WHERE panel_id % 6 <> 0 AND panel_id IN (SELECT panel_id FROM bom WHERE selectable)""")
def m5(panels, *t):
    gaps = panels.select("panel_id", *[F.when(F.col("panel_id") % 6 != 0, F.col(c)).alias(c) for c in bm.ATTRIBUTES])
    return bm.hide_empty_panels(bom_of(panels, *t), gaps).select("panel_id", "item_type", "product", "qty")


@query("m6_panel_table", "panels", """SELECT panel_id, raw_name AS name, bus_amps || 'A' AS bus, voltage || 'V' AS volts, coalesce(int_rating || 'K', 'NONE') AS rating, spaces || 'ckt' AS spaces, coalesce(CAST(main_amps AS VARCHAR), 'NONE') AS main FROM panels""")
def m6(panels):
    return bm.panel_table(panels)


@query("m7_bom_totals", T, "WITH " + QUOTES + """ SELECT job_id, product, CAST(sum(qty) AS BIGINT) AS qty FROM bom b JOIN panels p ON p.panel_id = b.panel_id WHERE include GROUP BY job_id, product""")
def m7(panels, *t):
    return bm.bom_totals(bom_of(panels, *t), panels)


@query("m7b_bom_totals_rollup", T, "WITH " + QUOTES + """ SELECT job_id, b.panel_id, product, CAST(sum(qty) AS BIGINT) AS qty FROM bom b JOIN panels p ON p.panel_id = b.panel_id WHERE include GROUP BY ROLLUP (job_id, b.panel_id, product)""")
def m7b(panels, *t):
    return bm.bom_totals(bom_of(panels, *t), panels, by_panel=True)
