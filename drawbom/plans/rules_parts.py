"""Queries over part assembly."""

from pyspark.sql import functions as F

from drawbom.operators.rules import parts as pt, search as se
from drawbom.plans.registry import query
from drawbom.plans.rules_search import LUG, _LETTERS, prepared
from drawbom.sources.catalogs import SPD_PARTS  # noqa: F401

REQ_FRAMES = ["B", "H", "J", "Q", "L", "M", "P", "R"]
REQ_AMPS = [15, 20, 60, 100, 125, 150, 200, 250, 400, 600, 800, 1000, 1200]
REQ_KA = [10, 14, 18, 22, 25, 30, 35, 42, 50, 65, 100, 125, 200]
REQ_PHASE = ["AB", "AC", "BC", "CA", "A", "ABC"]
REQ_STYLE = ["FLUSH", "SURFACE", "NEMA3R", "NONE"]


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def _sql_pick(values, index):
    return f"([{', '.join(repr(v) for v in values)}])[CAST(({index}) % {len(values)} AS INT) + 1]"


def requests_of(lineitem):
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return lineitem.select(
        k.alias("panel_id"), p.alias("part_id"), s.alias("supp_id"), _pick(REQ_FRAMES, p).alias("frame"),
        F.when(s % 2 == 0, "LUG").otherwise("ILINE").alias("termination"), (F.lit(1) + (k + s) % 3).cast("int").alias("poles"),
        _pick(REQ_AMPS, k).alias("amps"), _pick([240, 480, 600], p + s).alias("volts"), _pick(REQ_KA, s + k).alias("ka"),
        F.when((p % 8 >= 4) | (k % 5 == 0), "ELECTRONIC").otherwise("MAGNETIC").alias("trip"), (k % 11 == 0).alias("grounding"),
        _pick(REQ_PHASE, k + p).alias("phasing"), _pick(REQ_STYLE, s).alias("style")).distinct()


REQ_SQL = f"""req AS (SELECT DISTINCT l_orderkey AS panel_id, l_partkey AS part_id, l_suppkey AS supp_id, {_sql_pick(REQ_FRAMES, 'l_partkey')} AS frame,
  CASE WHEN l_suppkey % 2 = 0 THEN 'LUG' ELSE 'ILINE' END AS termination, CAST(1 + (l_orderkey + l_suppkey) % 3 AS INT) AS poles, {_sql_pick(REQ_AMPS, 'l_orderkey')} AS amps,
  {_sql_pick([240, 480, 600], 'l_partkey + l_suppkey')} AS volts, {_sql_pick(REQ_KA, 'l_suppkey + l_orderkey')} AS ka,
  CASE WHEN l_partkey % 8 >= 4 OR l_orderkey % 5 = 0 THEN 'ELECTRONIC' ELSE 'MAGNETIC' END AS trip, l_orderkey % 11 = 0 AS grounding,
  {_sql_pick(REQ_PHASE, 'l_orderkey + l_partkey')} AS phasing, {_sql_pick(REQ_STYLE, 'l_suppkey')} AS style FROM lineitem)"""
_AMPS = "amp_sets(k, amps) AS (VALUES " + ", ".join(f"('{k}', {a})" for k, ls in pt.MCCB_AMPS.items() for a in ls) + ")"
MCCB_SQL = REQ_SQL + ", " + _LETTERS + ", " + _AMPS + """,
  q1 AS (SELECT *, CASE WHEN frame IN ('H', 'J') THEN 'HJ' WHEN frame = 'L' THEN CASE trip WHEN 'MAGNETIC' THEN 'LM' ELSE 'LE' END ELSE frame END AS kind FROM req),
  q2 AS (SELECT q1.*, CASE WHEN frame = 'B' AND l.letter = 'K' AND poles = 3 THEN NULL ELSE l.letter END AS letter FROM q1 LEFT JOIN letters l ON l.kind = q1.kind AND l.volts = CASE WHEN q1.kind = 'Q' AND q1.volts <= 240 THEN 240 ELSE q1.volts END AND l.ka = q1.ka),
  q3 AS (SELECT *, CASE WHEN frame = 'B' AND letter = 'K' THEN 'BK' WHEN frame IN ('H', 'J') THEN frame || CASE trip WHEN 'ELECTRONIC' THEN 'E' ELSE 'M' END WHEN kind = 'LE' AND grounding THEN 'LEG' WHEN frame = 'R' AND termination <> 'LUG' THEN 'RI' ELSE kind END AS ak,
    frame || letter || CASE WHEN termination = 'LUG' THEN CASE frame WHEN 'R' THEN 'F' ELSE 'L' END WHEN frame = 'L' THEN '' ELSE 'A' END || poles || CASE WHEN frame = 'Q' THEN '2' WHEN frame = 'P' AND letter = 'L' AND volts = 480 THEN '4' ELSE '6' END
      || CASE WHEN frame = 'M' THEN CASE amps WHEN 400 THEN '400' ELSE '800' END WHEN frame IN ('P', 'R') THEN lpad(CAST(amps // 10 AS VARCHAR), 3, '0') ELSE lpad(CAST(amps AS VARCHAR), 3, '0') END
      || CASE WHEN (frame IN ('H', 'J') OR kind = 'LE') AND trip = 'ELECTRONIC' THEN CASE WHEN grounding THEN 'U44X' ELSE 'U31X' END WHEN frame = 'P' AND (grounding OR amps IN (250, 400)) THEN CASE WHEN grounding THEN 'U44A' ELSE 'U31A' END
        WHEN frame = 'R' THEN CASE termination WHEN 'LUG' THEN '' ELSE 'C' END || CASE WHEN grounding THEN 'U44A' WHEN termination <> 'LUG' OR amps IN (600, 800, 1000, 3000) THEN 'U31A' ELSE '' END ELSE '' END
      || CASE WHEN termination <> 'LUG' AND trip = 'MAGNETIC' THEN CASE poles || phasing WHEN '1A' THEN '1' WHEN '1B' THEN '3' WHEN '1C' THEN '5' WHEN '2AB' THEN '1' WHEN '2AC' THEN '2' WHEN '2BA' THEN '3' WHEN '2BC' THEN '4' WHEN '2CA' THEN '5' WHEN '2CB' THEN '6' ELSE '' END ELSE '' END AS part FROM q2),
  q4 AS (SELECT *, CASE WHEN frame IN ('M', 'P', 'R') AND trip <> 'ELECTRONIC' THEN 'trip' WHEN frame = 'M' AND grounding THEN 'grounding'
      WHEN NOT CASE WHEN frame = 'B' THEN poles IN (1, 2, 3) WHEN frame IN ('Q', 'M') THEN poles IN (2, 3) WHEN frame IN ('H', 'J') AND trip = 'MAGNETIC' THEN poles IN (2, 3) ELSE poles = 3 END THEN 'poles'
      WHEN letter IS NULL THEN 'interrupting rating' WHEN frame = 'H' AND trip = 'MAGNETIC' AND letter = 'R' THEN 'interrupting rating'
      WHEN NOT EXISTS (SELECT 1 FROM amp_sets a WHERE a.k = ak AND a.amps = q3.amps) THEN 'amperage' WHEN kind <> 'LM' AND part IN ('HDA261256', 'HLA261001', 'HLA261005') THEN 'not made' END AS error FROM q3)"""


@query("r23_mccb_part_number", "lineitem", "WITH " + MCCB_SQL + """, q5 AS (SELECT *, CASE WHEN error IS NULL THEN part END AS product, left(CASE WHEN error IS NULL THEN part END, 3) AS p3 FROM q4),
  q6 AS (SELECT *, CASE WHEN p3 IN ('BDL', 'BGL', 'BJL', 'BKL') THEN 'B125' WHEN p3 IN ('HDL', 'HGL') AND poles = 2 THEN 'H150' WHEN p3 IN ('HJL', 'HLL', 'JDL', 'JGL', 'JJL', 'JLL') OR (p3 = 'HGL' AND poles <> 2) THEN 'J250'
      WHEN p3 IN ('LDL', 'LJL') THEN 'L600AWK' WHEN p3 IN ('LGL', 'LLL', 'LRL') THEN 'L600AWKMC' WHEN p3 IN ('QDL', 'QGL', 'QJL', 'QBL') THEN 'Q23225N' WHEN p3 IN ('LAL', 'LHL') THEN 'LA400'
      WHEN p3 IN ('MGL', 'MJL') OR (p3 IN ('PGL', 'PJL', 'PKL', 'PLL') AND poles = 2) THEN 'M800' WHEN p3 IN ('PGL', 'PJL', 'PKL', 'PLL') THEN 'P1200' END AS b FROM q5)
  SELECT panel_id, part_id, supp_id, product, error, CASE WHEN style = 'FLUSH' AND b NOT IN ('L600AWK', 'L600AWKMC', 'Q23225N', 'M800', 'P1200') THEN b || 'F' WHEN style = 'SURFACE' AND b NOT IN ('L600AWK', 'L600AWKMC') THEN b || 'S'
    WHEN style = 'NEMA3R' THEN CASE WHEN b IN ('L600AWK', 'L600AWKMC') THEN b WHEN b IN ('B125', 'Q23225N') THEN b || 'RB' ELSE b || 'R' END END AS enclosure_product FROM q6""")
def r23(lineitem):
    return pt.mccb_part_number(requests_of(lineitem)).select("panel_id", "part_id", "supp_id", "product", "error", "enclosure_product")


def _neutral_sql(fam, size):
    return f"(SELECT arg_min(product, amps) FROM neutrals n WHERE n.family = '{fam}' AND n.size = '{size}' AND n.amps >= l.matched_amps)"


_STYLE = "CASE trim WHEN 'FLUSH' THEN 'F' ELSE 'S' END"
_NC = f"'NC' || box || CASE WHEN matched_amps >= 400 THEN 'V' ELSE '' END || {_STYLE}"
_NOSE = "'Panel not suitable for service entrance.'"
_PARTS = {
    "NQ": {"Interior": "interior || CASE material WHEN 'COPPER' THEN 'C' ELSE '' END", "Box": "'MH' || box || 'BE'",
           "Trim": f"CASE enclosure WHEN 'NEMA3R' THEN 'MH' || box || 'WP' ELSE {_NC} END",
           "Ground Bar Kit": "CASE material WHEN 'COPPER' THEN 'PK27GTACU' ELSE 'PK27GTA' END",
           "Neutral (100%)": _neutral_sql("NQ", "100%"), "Neutral (200%)": _neutral_sql("NQ", "200%"),
           "Feed-Thru Lugs": "CASE WHEN feed_thru AND matched_amps <= 225 THEN CASE WHEN matched_spaces IN (30, 42) THEN 'NQFTL2L' ELSE 'NQFTL2H' END WHEN feed_thru AND matched_amps = 400 THEN CASE WHEN matched_spaces IN (30, 42) THEN 'NQFTL4L' ELSE 'NQFTL4H' END END",
           "SPD": "CASE WHEN spd_ka IN (80, 100, 120, 160, 200, 240) THEN 'SSP0' || CASE voltage WHEN 120 THEN '1' ELSE '2' END || 'SBA' || lpad(CAST(spd_ka // 10 AS VARCHAR), 2, '0') || 'D' END", "Note": _NOSE},
    "NF": {"Interior": "CASE WHEN NOT bad THEN interior || CASE WHEN material = 'COPPER' AND right(interior, 1) <> 'C' THEN 'C' ELSE '' END END", "Box": "CASE WHEN NOT bad THEN 'MH' || box || 'BE' END",
           "Trim": f"CASE WHEN NOT bad THEN CASE WHEN enclosure = 'NEMA3R' AND matched_amps = 600 THEN 'MH' || CASE matched_spaces WHEN 30 THEN '62' WHEN 42 THEN '68' WHEN 54 THEN '74' WHEN 66 THEN '86' ELSE box END || 'WP' WHEN enclosure = 'NEMA3R' THEN 'MH' || box || 'WP' ELSE {_NC} || CASE WHEN matched_amps = 600 THEN '3PNF' ELSE '' END END END",
           "Ground Bar Kit": "CASE WHEN NOT bad THEN CASE WHEN material = 'COPPER' THEN 'PK27GTACU' WHEN matched_amps = 125 AND matched_spaces = 18 THEN 'PK12GTA' WHEN matched_amps = 125 AND matched_spaces = 30 THEN 'PK18GTA' WHEN matched_amps = 125 AND matched_spaces IN (42, 54) THEN 'PK23GTA' WHEN matched_amps IN (250, 400, 600) THEN 'PK27GTA' END END",
           "Neutral (100%)": "CASE WHEN NOT bad THEN " + _neutral_sql("NF", "100%") + " END", "Neutral (200%)": "CASE WHEN NOT bad THEN " + _neutral_sql("NF", "200%") + " END",
           "Feed-Thru Lugs": "CASE WHEN NOT bad AND feed_thru THEN CASE WHEN matched_amps <= 125 THEN 'NF125FTL' WHEN matched_amps <= 250 THEN 'NF250FTL' WHEN matched_amps <= 400 THEN 'NF400FTL' END END",
           "Note": f"CASE WHEN bad THEN 'no outdoor trim for this size' ELSE {_NOSE} END"},
    "I-LINE": {"Interior": "interior || CASE WHEN series = 'HCJ' AND matched_material = 'COPPER' THEN 'CU' ELSE '' END", "Box": "box || CASE enclosure WHEN 'NEMA3R' THEN 'WP' ELSE 'DB' END",
               "Trim": "CASE enclosure WHEN 'NEMA3R' THEN 'Included with NEMA3R' ELSE box || CASE trim WHEN 'FLUSH' THEN 'TF' ELSE 'TS' END END",
               "SPD": "CASE CAST(voltage AS VARCHAR) || '|' || CAST(spd_ka AS VARCHAR) " + " ".join(f"WHEN '{v}|{k}' THEN '{p}'" for v, by in pt.ILINE_SPD.items() for k, p in by.items()) + " END",
               "Neutral": _neutral_sql("I-LINE", "100%"), "Ground Bar Kit": "CASE matched_material WHEN 'COPPER' THEN 'PK32GTACU' ELSE 'PK32DGTA' END",
               "Service Entrance Kit": "CASE WHEN has_main THEN CASE series " + " ".join(f"WHEN '{s}' THEN '{next(iter(k.values()))}'" for s, k in pt.BARRIER_KITS.items()) + " END END",
               "Note": f"CASE WHEN NOT has_main THEN {_NOSE} END"},
}
PARTS_SQL = LUG + ", pl AS (SELECT *, enclosure = 'NEMA3R' AND matched_amps = 600 AND matched_spaces = 84 AS bad, main_amps IS NOT NULL AS has_main FROM lug), parts AS (" + " UNION ALL ".join(
    f"SELECT panel_id, '{t}' AS item_type, {e} AS product FROM pl l WHERE family = '{f}'" for f, ts in _PARTS.items() for t, e in ts.items()) + ")"


def panel_parts(panels, breakers, frames, ladder, panel_catalog, iline_catalog, neutrals):
    found = se.search_lug_panel(prepared(panels, breakers, frames, ladder), panel_catalog, iline_catalog)
    found = found.withColumns({"has_main": F.col("main_amps").isNotNull(), "main_frame": F.lit(None).cast("string")})
    return pt.panel_parts(found, neutrals)


PART_TABLES = "panels breakers frames ladder panel_catalog iline_catalog neutrals"


@query("r24_panel_parts", PART_TABLES, "WITH " + PARTS_SQL + " SELECT * FROM parts WHERE product IS NOT NULL")
def r24(*tables):
    return panel_parts(*tables)


@query("r22_iline_blank_packs", "panels breakers blank_packs", """WITH u AS (SELECT panel_id, CAST(sum(poles * cnt) AS BIGINT) AS w, CAST(sum(cnt) AS BIGINT) AS n, CAST(count(*) FILTER (poles = 3) AS BIGINT) AS e FROM breakers GROUP BY panel_id),
  l AS (SELECT panel_id, 'HLW1BL' AS product, w AS pieces FROM u UNION ALL SELECT panel_id, 'HLN1BL', n FROM u UNION ALL SELECT panel_id, 'HLW4EBL', e FROM u)
  SELECT panel_id, l.product, pieces, CAST(ceil(pieces / pack_size) AS BIGINT) AS packs, CAST(ceil(pieces / pack_size) AS BIGINT) * pack_size * spaces_each AS covers FROM l JOIN blank_packs b ON b.product = l.product WHERE pieces > 0""")
def r22(panels, breakers, blank_packs):
    pieces = breakers.groupBy("panel_id").agg(F.sum(F.col("poles") * F.col("cnt")).cast("long").alias("wide"), F.sum("cnt").cast("long").alias("narrow"),
                                              F.count(F.when(F.col("poles") == 3, 1)).alias("extension"))
    return pt.iline_blank_packs(pieces, blank_packs)


@query("r27_accessory_lookups", "panels spd_parts neutrals", """SELECT p.panel_id, s.product AS spd_product, CASE WHEN s.product IS NULL THEN 'no surge device for this service and rating' END AS spd_error,
    (SELECT arg_min(product, amps) FROM neutrals n WHERE n.family = CASE panel_id % 3 WHEN 0 THEN 'NQ' WHEN 1 THEN 'NF' ELSE 'I-LINE' END AND n.size = CASE WHEN panel_id % 2 = 0 THEN '100%' ELSE '200%' END AND n.amps >= bus_amps) AS neutral_product
  FROM panels p LEFT JOIN spd_parts s ON s.service = CAST(voltage AS VARCHAR) || CASE WHEN panel_id % 5 = 0 AND voltage = 480 THEN 'DELTA' ELSE '' END AND s.ka = 100 * (1 + panel_id % 6)""")
def r27(panels, spd_parts, neutrals):
    req = panels.select(
        "panel_id", F.concat(F.col("voltage").cast("string"), F.when((F.col("panel_id") % 5 == 0) & (F.col("voltage") == 480), "DELTA").otherwise("")).alias("service"),
        (100 * (1 + F.col("panel_id") % 6)).cast("int").alias("ka"), F.col("bus_amps").alias("amps"),
        _pick(["NQ", "NF", "I-LINE"], F.col("panel_id")).alias("family"), _pick(["100%", "200%"], F.col("panel_id")).alias("size"))
    spd = pt.external_spd(req, spd_parts).withColumnsRenamed({"product": "spd_product", "error": "spd_error"})
    return pt.neutral(spd, neutrals).select("panel_id", "spd_product", "spd_error", F.col("product").alias("neutral_product"))
