"""Queries over disconnects, transformers and mixed quotes."""

from pyspark.sql import functions as F

from drawbom.operators.rules import equipment as eq, search as se
from drawbom.plans.registry import query
from drawbom.plans.rules_search import LUG, prepared
from drawbom.sources.catalogs import FUSES

_F = ", ".join(map(str, FUSES))
DISC = f"""d0 AS (SELECT *, coalesce(fusible, TRUE) AS f, coalesce(enclosure, 'NEMA1') AS e, (NOT coalesce(fusible, TRUE) OR fuse_amps IS NULL OR fuse_amps IN ({_F})) AS fuse_ok FROM disconnect_items),
  d1 AS (SELECT *, CASE WHEN voltage <= 240 AND amps <= CASE WHEN f THEN 800 ELSE 600 END THEN 'GENERAL_DUTY' WHEN voltage <= 600 AND amps <= 1200 THEN 'HEAVY_DUTY' END AS duty0 FROM d0),
  att AS (SELECT item_id, 1 AS o, duty0 AS fam, e AS enc FROM d1 WHERE duty0 IS NOT NULL UNION ALL SELECT item_id, 2, 'HEAVY_DUTY', e FROM d1 WHERE duty0 = 'GENERAL_DUTY'
    UNION ALL SELECT item_id, 3, 'HEAVY_DUTY', CASE e WHEN 'NEMA1' THEN 'NEMA3R' ELSE 'NEMA1' END FROM d1 WHERE duty0 IS NOT NULL AND enclosure IS NULL),
  hit AS (SELECT a.item_id, a.o, a.fam, c.amps AS rated, c.product, c.ground_kit, c.neutral_kit, row_number() OVER (PARTITION BY a.item_id ORDER BY a.o, c.amps, c.product) AS n
    FROM att a JOIN d1 d ON d.item_id = a.item_id JOIN disconnects c ON c.family = a.fam AND c.fusible = d.f AND c.enclosure = a.enc AND c.volts = CASE a.fam WHEN 'GENERAL_DUTY' THEN 240 ELSE 600 END
      AND coalesce(c.poles, 0) = CASE WHEN a.fam = 'GENERAL_DUTY' AND NOT d.f THEN 0 ELSE d.poles END AND c.amps >= d.amps WHERE d.fuse_ok),
  disc AS (SELECT d.item_id, h.fam AS duty, h.product, h.rated AS rated_amps, h.ground_kit, CASE WHEN neutral AND NOT (h.fam = 'HEAVY_DUTY' AND NOT f) THEN h.neutral_kit END AS neutral_kit,
    CASE WHEN h.fam IS NOT NULL AND f THEN d.poles || ' - ' || CASE h.fam WHEN 'HEAVY_DUTY' THEN 'FLSR' ELSE 'FLNR' END || printf('%03d', coalesce(fuse_amps, h.rated)) END AS fuses,
    CASE WHEN h.fam IS NOT NULL THEN concat_ws('; ', CASE WHEN enclosure <> 'NEMA1' THEN 'Enclosure overridden to ' || enclosure END, CASE WHEN h.fam = 'HEAVY_DUTY' AND NOT f AND neutral THEN 'Neutral omitted: not available on Heavy Duty non-fusible' END,
      CASE WHEN duty0 = 'HEAVY_DUTY' THEN CASE WHEN voltage > 240 THEN 'Escalated to Heavy Duty: Voltage > 240V' ELSE 'Escalated to Heavy Duty: Amperage exceeds GD limit' END WHEN h.o > 1 THEN 'Escalated to Heavy Duty: no General Duty table match' END,
      CASE WHEN h.rated <> d.amps THEN 'Amperage snapped ' || d.amps || ' to ' || h.rated END) END AS notes,
    CASE WHEN duty0 IS NULL THEN 'no valid duty' WHEN NOT fuse_ok THEN 'invalid fuse amperage' WHEN h.fam IS NULL THEN 'invalid disconnect configuration' END AS error
    FROM d1 d LEFT JOIN hit h ON h.item_id = d.item_id AND n = 1)"""


@query("r25_resolve_disconnects", "disconnect_items disconnects", "WITH " + DISC + " SELECT * FROM disc")
def r25(disconnect_items, disconnects):
    return eq.resolve_disconnects(disconnect_items, disconnects)


_CHAIN = "['" + "', '".join(eq.TYPE_CHAIN) + "']"
TRANS = f"""t0 AS (SELECT *, coalesce(core, 'ALUMINUM') AS cm, coalesce(temperature, 150) AS temp FROM transformer_items),
  th AS (SELECT i.item_id, c.type, c.core, c.kva, c.product, row_number() OVER (PARTITION BY i.item_id ORDER BY CASE WHEN i.type IS NULL THEN list_position({_CHAIN}, c.type) ELSE 0 END,
      CASE WHEN c.type = 'RESIN' THEN list_position(['3R', 'SS', '4X'], c.core) WHEN i.cm = 'COPPER' THEN 0 ELSE list_position(['ALUMINUM', 'COPPER'], c.core) END,
      CASE WHEN c.kva = i.kva THEN 0 WHEN c.kva > i.kva THEN 1 ELSE 2 END, abs(c.kva - i.kva)) AS n
    FROM t0 i JOIN transformers c ON c.primary_volts = i.primary_volts AND c.secondary_volts = i.secondary_volts AND c.temperature = i.temp AND (i.type IS NULL OR c.type = i.type)
      AND (c.type = 'RESIN' OR c.core = 'COPPER' OR i.cm <> 'COPPER')),
  lugs(kva, p, s) AS (VALUES {', '.join(f"({k}, {repr(v[0]) if v[0] else 'NULL'}, {repr(v[1])})" for k, v in eq.LUGS.items())}),
  tr AS (SELECT i.item_id, h.type, h.core, h.kva, h.product, l.p AS primary_lugs, l.s AS secondary_lugs,
    CASE WHEN h.item_id IS NOT NULL THEN concat_ws(' | ', CASE WHEN h.kva <> i.kva THEN 'kVA snapped' END, CASE WHEN h.type <> coalesce(i.type, '3PHASESTANDARD') THEN 'type escalated to ' || h.type END,
      CASE WHEN h.type = 'RESIN' AND h.core <> '3R' THEN 'enclosure overridden to ' || h.core END, CASE WHEN h.type <> 'RESIN' AND i.cm <> 'COPPER' AND h.core = 'COPPER' THEN 'winding upgraded to COPPER' END) END AS notes,
    CASE WHEN h.item_id IS NULL THEN 'invalid transformer configuration' END AS error
    FROM t0 i LEFT JOIN th h ON h.item_id = i.item_id AND n = 1 LEFT JOIN lugs l ON l.kva = h.kva AND (h.type LIKE '3PHASE%' OR h.type = 'K13'))"""


@query("r26_resolve_transformers", "transformer_items transformers", "WITH " + TRANS + " SELECT * FROM tr")
def r26(transformer_items, transformers):
    return eq.resolve_transformers(transformer_items, transformers)


QUOTE_TABLES = "panels breakers frames ladder panel_catalog iline_catalog disconnect_items disconnects transformer_items transformers"


@query("r28_quote", QUOTE_TABLES, "WITH " + LUG + ", " + DISC + ", " + TRANS + """,
  it AS (SELECT panel_id AS item_id, [' panelboard', 'disconnect', 'Transformer', 'busway', NULL][CAST(panel_id % 5 AS INT) + 1] AS type, CASE WHEN panel_id % 6 = 0 THEN 'NONE' ELSE raw_name END AS nm FROM panels),
  ans AS (SELECT panel_id AS item_id, 'panelboard' AS t, interior AS product, CASE WHEN interior IS NULL THEN 'no interior' END AS error FROM lug UNION ALL SELECT item_id, 'disconnect', product, error FROM disc UNION ALL SELECT item_id, 'transformer', product, error FROM tr)
  SELECT i.item_id, CASE WHEN nm = 'NONE' THEN 'name not detected' ELSE nm END AS name, a.product, CASE WHEN type IS NULL THEN 'missing or invalid type' WHEN type = 'busway' THEN 'unknown item type' WHEN a.product IS NULL THEN coalesce(error, 'engine gave no result') END AS reason
  FROM it i LEFT JOIN ans a ON a.item_id = i.item_id AND a.t = lower(trim(type))""")
def r28(panels, breakers, frames, ladder, panel_catalog, iline_catalog, disconnect_items, disconnects, transformer_items, transformers):
    types = F.array(F.lit(" panelboard"), F.lit("disconnect"), F.lit("Transformer"), F.lit("busway"), F.lit(None).cast("string"))
    items = panels.select(F.col("panel_id").alias("item_id"), F.get(types, (F.col("panel_id") % 5).cast("int")).alias("type"),
                          F.when(F.col("panel_id") % 6 == 0, "NONE").otherwise(F.col("raw_name")).alias("name"))
    lug = se.search_lug_panel(prepared(panels, breakers, frames, ladder), panel_catalog, iline_catalog).select(
        F.col("panel_id").alias("item_id"), F.col("interior").alias("product"), F.when(F.col("interior").isNull(), "no interior").alias("error"))
    return eq.quote(items, {"panelboard": lug, "disconnect": eq.resolve_disconnects(disconnect_items, disconnects),
                            "transformer": eq.resolve_transformers(transformer_items, transformers)})
