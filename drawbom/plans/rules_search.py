"""Queries over catalog search and main breakers."""

from pyspark.sql import functions as F

from drawbom.operators.rules import search as se, sizing as sz
from drawbom.plans.registry import query
from drawbom.plans.rules_basic import NEED, SCREEN, configured
from drawbom.sources.catalogs import LOADCENTER_SPACES


def prepared(panels, breakers, frames, ladder):
    """Panels with screen flags, frame spaces and the resolved mounting."""
    use = sz.usable_breakers(panels, breakers)
    screened = sz.family_screen(configured(panels), use, ladder).select("panel_id", "allow_nq", "allow_nf", "plug_on")
    need = sz.required_spaces(panels, use, frames).withColumn("int_rating", F.coalesce("int_rating", F.lit(22)))
    return need.join(screened, "panel_id").withColumns({
        "frame_spaces": F.col("frame_spaces").cast("int"),
        "enclosure": F.when(F.col("job_id") % 3 == 0, "NEMA3R").otherwise("NEMA1"),
        "material": F.when(F.col("job_id") % 5 == 0, "COPPER").otherwise("ALUMINUM"),
        "trim": F.when(F.col("panel_id") % 2 == 0, "FLUSH").otherwise("SURFACE"),
        "spd_ka": F.when(F.col("panel_id") % 6 == 0, 160).when(F.col("panel_id") % 6 == 1, 90),
        "feed_thru": F.col("bus_amps") <= 400})


_SCREEN_ONLY = SCREEN[SCREEN.index(", cfg AS") + 2:]
PREPARED = NEED + ", " + _SCREEN_ONLY + """, prep AS (SELECT s.panel_id, s.job_id, s.voltage, s.bus_amps, s.main_amps, coalesce(s.int_rating, 22) AS int_rating, s.spaces, CAST(frame_spaces AS INT) AS frame_spaces, allow_nq, allow_nf,
    job_id % 3 <> 0 AS plug_on, CASE WHEN job_id % 3 = 0 THEN 'NEMA3R' ELSE 'NEMA1' END AS enclosure, CASE WHEN job_id % 5 = 0 THEN 'COPPER' ELSE 'ALUMINUM' END AS material,
    CASE WHEN s.panel_id % 2 = 0 THEN 'FLUSH' ELSE 'SURFACE' END AS trim, CASE WHEN voltage = 240 THEN 208 ELSE voltage END AS lv, CASE WHEN voltage = 120 THEN '1PHASE' ELSE '3PHASE' END AS phase,
    CASE s.panel_id % 6 WHEN 0 THEN 160 WHEN 1 THEN 90 END AS spd_ka, bus_amps <= 400 AS feed_thru
    FROM sized s JOIN screen c ON c.panel_id = s.panel_id),
  cat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, main, min_amps, max_amps, spaces, phase, voltage ORDER BY ord DESC) AS k FROM panel_catalog) x WHERE k = 1)"""
METAL = "(p.material <> 'COPPER' OR {c}.material = 'COPPER') AND (p.material <> 'ALUMINUM' OR {c}.material = 'ALUMINUM' OR NOT ({c}.series = 'HCJ' OR ({c}.series = 'HCP' AND {c}.amps <= 600)))"
RANK = "CASE {c}.series WHEN 'HCJ' THEN 0 WHEN 'HCP' THEN 1 ELSE 2 END"
FIRST = "CASE WHEN p.bus_amps <= 250 THEN 0 WHEN p.bus_amps <= 800 THEN 1 ELSE 2 END"
DEFAULT_SERIES = "CASE WHEN bus_amps > 800 OR {s} > 99 THEN 'HCR-U' WHEN bus_amps > 250 THEN 'HCP' ELSE 'HCJ' END"
LUG = PREPARED + f""", cand AS (
    SELECT p.panel_id, CASE c.family WHEN 'NQ' THEN 0 ELSE 1 END AS cost, 0 AS rank, c.max_amps - bus_amps AS da, c.spaces - p.spaces AS ds, c.ord, c.family, CAST(NULL AS VARCHAR) AS series, c.max_amps AS a, c.spaces AS s, p.material, c.interior, CAST(c.box AS VARCHAR) AS box
    FROM prep p JOIN cat c ON c.main = 'MAIN LUG' AND c.voltage = lv AND c.phase = p.phase AND c.max_amps >= bus_amps AND c.spaces >= p.spaces AND CASE c.family WHEN 'NQ' THEN allow_nq ELSE allow_nf END
    UNION ALL SELECT p.panel_id, 2, {RANK.format(c='c')}, c.amps - bus_amps, c.spaces - greatest(p.spaces, frame_spaces), c.ord, 'I-LINE', c.series, c.amps, c.spaces, c.material, c.interior, c.box
    FROM prep p JOIN iline_catalog c ON c.main = 'MAIN LUG' AND c.enclosure = p.enclosure AND {RANK.format(c='c')} >= {FIRST} AND {METAL.format(c='c')} AND (p.enclosure = 'NEMA3R' OR c.trim = p.trim)
      AND c.amps >= bus_amps AND c.spaces >= greatest(p.spaces, frame_spaces)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY cost, rank, da, ds, ord) AS n FROM cand) x WHERE n = 1),
  chance AS (SELECT * FROM (SELECT p.panel_id, c.max_amps AS a, c.spaces AS s, c.interior, CAST(c.box AS VARCHAR) AS box, row_number() OVER (PARTITION BY p.panel_id ORDER BY c.ord) AS n FROM prep p JOIN cat c ON c.family = 'NQ' AND c.main = 'MAIN LUG' AND c.voltage = 208
      AND c.max_amps >= bus_amps AND c.spaces >= p.spaces WHERE lv = 208 AND p.spaces >= 84) x WHERE n = 1),
  lug0 AS (SELECT p.*, CASE WHEN b.panel_id IS NOT NULL THEN b.family WHEN h.panel_id IS NOT NULL THEN 'NQ' ELSE 'I-LINE' END AS family,
      CASE WHEN b.panel_id IS NOT NULL THEN b.series WHEN h.panel_id IS NULL THEN {DEFAULT_SERIES.format(s='p.spaces')} END AS series,
      CASE WHEN b.panel_id IS NOT NULL THEN b.material WHEN h.panel_id IS NULL AND {DEFAULT_SERIES.format(s='p.spaces')} = 'HCR-U' THEN 'COPPER' ELSE p.material END AS matched_material,
      CASE WHEN b.panel_id IS NOT NULL THEN b.a WHEN h.panel_id IS NOT NULL THEN h.a ELSE p.bus_amps END AS matched_amps, CASE WHEN b.panel_id IS NOT NULL THEN b.s ELSE h.s END AS s0,
      CASE WHEN b.panel_id IS NOT NULL THEN b.interior ELSE h.interior END AS interior, CASE WHEN b.panel_id IS NOT NULL THEN b.box ELSE h.box END AS box,
      CASE WHEN b.panel_id IS NOT NULL THEN 'match' WHEN h.panel_id IS NOT NULL THEN 'last chance' ELSE 'default' END AS tier
    FROM prep p LEFT JOIN best b ON b.panel_id = p.panel_id LEFT JOIN chance h ON h.panel_id = p.panel_id),
  lug_snap AS (SELECT p.panel_id, least(108, coalesce(min(c.spaces) FILTER (c.spaces >= least(108, CAST(ceil(p.spaces * 1.5) AS INT))), max(c.spaces), least(108, CAST(ceil(max(p.spaces) * 1.5) AS INT)))) AS sn
    FROM (SELECT panel_id, spaces, series, enclosure, trim, matched_material AS material FROM lug0 WHERE family = 'I-LINE') p LEFT JOIN iline_catalog c ON c.main = 'MAIN LUG' AND c.series = p.series AND c.enclosure = p.enclosure AND (p.enclosure = 'NEMA3R' OR c.trim = p.trim) AND {METAL.format(c='c')} GROUP BY p.panel_id),
  lug AS (SELECT l.*, CASE WHEN family = 'I-LINE' THEN sn ELSE s0 END AS matched_spaces FROM lug0 l LEFT JOIN lug_snap z ON z.panel_id = l.panel_id)"""
TABLES = "panels breakers frames ladder panel_catalog iline_catalog"
LUG_COLS = ["panel_id", "family", "series", "matched_amps", "matched_spaces", "matched_material", "interior", "tier"]


@query("r15_search_lug_panel", TABLES, "WITH " + LUG + f" SELECT {', '.join(LUG_COLS)} FROM lug")
def r15(panels, breakers, frames, ladder, panel_catalog, iline_catalog):
    return se.search_lug_panel(prepared(panels, breakers, frames, ladder), panel_catalog, iline_catalog).select(*LUG_COLS)


MB = PREPARED + f""", want AS (SELECT *, greatest(spaces, frame_spaces) AS want FROM prep),
  mcand AS (SELECT p.panel_id, CASE c.family WHEN 'NQ' THEN 0 ELSE 1 END AS cost, c.max_amps, c.spaces AS s, c.ord, c.family, c.interior, c.frames, c.kit, c.kit_q, CASE c.family WHEN 'NQ' THEN allow_nq ELSE allow_nf END AS allowed, p.voltage = 208 AND want >= 84 AND c.family = 'NQ' AS late, want
    FROM want p JOIN cat c ON c.main = 'MAIN BREAKER' AND c.voltage = p.voltage AND c.phase = p.phase AND bus_amps BETWEEN c.min_amps AND c.max_amps AND c.spaces >= want),
  mbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY cost, max_amps, s - want, ord) AS n FROM mcand WHERE allowed) x WHERE n = 1),
  mlate AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY ord) AS n FROM mcand WHERE late) x WHERE n = 1),
  mb0 AS (SELECT p.*, coalesce(b.family, h.family, 'I-LINE') AS family, CASE WHEN b.panel_id IS NULL AND h.panel_id IS NULL THEN {DEFAULT_SERIES.format(s='want.want').replace('want.want', 'p.want')} END AS series,
    coalesce(b.max_amps, h.max_amps, p.bus_amps) AS matched_amps, coalesce(b.s, h.s) AS s0, coalesce(b.interior, h.interior) AS interior, coalesce(b.frames, h.frames) AS frames, coalesce(b.kit, h.kit) AS kit, coalesce(b.kit_q, h.kit_q) AS kit_q,
    CASE WHEN b.panel_id IS NOT NULL THEN 'match' WHEN h.panel_id IS NOT NULL THEN 'last chance' ELSE 'default' END AS tier FROM want p LEFT JOIN mbest b ON b.panel_id = p.panel_id LEFT JOIN mlate h ON h.panel_id = p.panel_id),
  mb_snap AS (SELECT p.panel_id, least(108, coalesce(min(c.spaces) FILTER (c.spaces >= least(108, CAST(ceil(p.spaces * 1.5) AS INT))), max(c.spaces), least(108, CAST(ceil(max(p.spaces) * 1.5) AS INT)))) AS sn
    FROM (SELECT panel_id, spaces, series, enclosure, trim, material FROM mb0 WHERE family = 'I-LINE') p LEFT JOIN iline_catalog c ON c.main = 'MAIN BREAKER' AND c.series = p.series AND c.enclosure = p.enclosure AND (p.enclosure = 'NEMA3R' OR c.trim = p.trim) AND {METAL.format(c='c')} GROUP BY p.panel_id),
  mb AS (SELECT l.*, coalesce(s0, sn) AS matched_spaces FROM mb0 l LEFT JOIN mb_snap z ON z.panel_id = l.panel_id)"""
MB_COLS = ["panel_id", "family", "series", "matched_amps", "matched_spaces", "interior", "frames", "tier"]


@query("r16_search_breaker_panel", TABLES, "WITH " + MB + f" SELECT {', '.join(MB_COLS)} FROM mb")
def r16(panels, breakers, frames, ladder, panel_catalog, iline_catalog):
    return se.search_breaker_panel(prepared(panels, breakers, frames, ladder), panel_catalog, iline_catalog).select(*MB_COLS)


SHAPED = """shaped AS (SELECT *, CASE WHEN job_id % 3 = 0 THEN 'NEMA3R' ELSE 'NEMA1' END AS enclosure, CASE WHEN job_id % 5 = 0 THEN 'COPPER' ELSE 'ALUMINUM' END AS material,
    CASE WHEN panel_id % 4 = 3 THEN NULL WHEN panel_id % 2 = 0 THEN 'FLUSH' ELSE 'SURFACE' END AS trim, job_id % 3 <> 0 AS plug_on, panel_id % 7 = 0 AS spd FROM panels)"""


def shaped(panels):
    return panels.withColumns({
        "enclosure": F.when(F.col("job_id") % 3 == 0, "NEMA3R").otherwise("NEMA1"),
        "material": F.when(F.col("job_id") % 5 == 0, "COPPER").otherwise("ALUMINUM"),
        "trim": F.when(F.col("panel_id") % 4 == 3, None).when(F.col("panel_id") % 2 == 0, "FLUSH").otherwise("SURFACE"),
        "plug_on": F.col("job_id") % 3 != 0, "spd": F.col("panel_id") % 7 == 0})


ROOM = "c.enclosure = p.enclosure AND c.amps >= bus_amps AND c.spaces >= p.spaces"
TRIM_LOOSE = "(p.enclosure = 'NEMA3R' OR p.trim IS NULL OR c.trim IS NULL OR c.trim = p.trim)"


@query("r17_nearest_iline_bucket", "panels iline_catalog", f"""WITH {SHAPED},
  b AS (SELECT p.panel_id, CASE WHEN {RANK.format(c='c')} >= {FIRST} AND {METAL.format(c='c')} THEN {RANK.format(c='c')} WHEN c.series = 'HCR-U' THEN 3 END AS rank, c.amps - bus_amps AS da, c.spaces - p.spaces AS ds, c.amps, c.spaces, c.material, c.series
    FROM shaped p JOIN iline_catalog c ON c.main = 'MAIN LUG' AND {ROOM} AND {TRIM_LOOSE}),
  b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY rank, da, ds, amps, spaces, material) AS n FROM b WHERE rank IS NOT NULL) x WHERE n = 1),
  t AS (SELECT p.panel_id, c.series, c.amps, c.spaces, row_number() OVER (PARTITION BY p.panel_id ORDER BY c.amps - bus_amps, c.spaces - p.spaces, c.ord) AS n FROM shaped p JOIN iline_catalog c ON c.main = 'MAIN BREAKER' AND {ROOM} AND c.material = p.material
    AND (p.trim IS NULL OR c.trim = p.trim) AND c.series = CASE WHEN bus_amps < 250 THEN 'HCJ' WHEN bus_amps > 250 AND bus_amps <= 800 THEN 'HCP' WHEN bus_amps > 800 THEN 'HCR-U' END)
  SELECT p.panel_id, coalesce(b1.series, 'HCR-U') AS bucket_series, coalesce(b1.amps, greatest(bus_amps, 1200)) AS bucket_amps, coalesce(b1.spaces, greatest(p.spaces, 60)) AS bucket_spaces, coalesce(b1.material, 'ALUMINUM') AS bucket_material,
    t.series AS tight_series, t.amps AS tight_amps, t.spaces AS tight_spaces
  FROM shaped p LEFT JOIN b1 ON b1.panel_id = p.panel_id LEFT JOIN t ON t.panel_id = p.panel_id AND t.n = 1""")
def r17(panels, iline_catalog):
    out = se.nearest_iline_bucket(shaped(panels), iline_catalog, "MAIN LUG")
    return se.tightest_iline_breaker(out, iline_catalog).select(
        "panel_id", "bucket_series", "bucket_amps", "bucket_spaces", "bucket_material", "tight_series", "tight_amps", "tight_spaces")


from drawbom.operators.rules.parts import LETTERS  # noqa: E402

_LADDERS = "ml(frame, amps) AS (VALUES " + ", ".join(f"('{f}', {a})" for f, ls in se.MAIN_LADDERS.items() for a in ls) + ")"
_LETTERS = "letters(kind, volts, ka, letter) AS (VALUES " + ", ".join(
    f"('{k}', {v}, {a}, '{x}')" for k, by in LETTERS.items() for v, m in by.items() for a, x in m.items()) + ")"
SNAP_KA = ("coalesce((SELECT min(ka) FROM int_ratings r WHERE r.frame = c.frame AND r.voltage = c.v AND r.ka >= {k}), "
           "(SELECT max(ka) FROM int_ratings r WHERE r.frame = c.frame AND r.voltage = c.v), {k})")


@query("r18_size_main_breaker", TABLES, "WITH " + MB + f""", {_LADDERS}, {_LETTERS},
  c0 AS (SELECT panel_id, main_amps, int_rating, CASE WHEN voltage IN (120, 208) THEN 240 ELSE voltage END AS v, voltage, unnest(string_split(frames, ',')) AS frame, generate_subscripts(string_split(frames, ','), 1) AS o FROM mb WHERE frames IS NOT NULL AND main_amps IS NOT NULL),
  c1 AS (SELECT *, {SNAP_KA.format(k='c.int_rating')} AS ka0, (SELECT min(amps) FROM ml WHERE ml.frame = c.frame AND ml.amps >= c.main_amps) AS amps, CASE WHEN voltage = 120 AND frame = 'Q' THEN 2 ELSE 3 END AS poles FROM c0 c),
  c2 AS (SELECT *, {SNAP_KA.format(k='(c.ka0 + 1)')} AS ka1, CASE frame WHEN 'LL' THEN 'LM' WHEN 'L' THEN 'LE' WHEN 'H' THEN 'HJ' WHEN 'J' THEN 'HJ' ELSE frame END AS kind FROM c1 c),
  c3 AS (SELECT c.*, a.att, l.letter FROM c2 c CROSS JOIN (VALUES (0), (1)) a(att) JOIN letters l ON l.kind = c.kind AND l.volts = c.v AND l.ka = CASE a.att WHEN 0 THEN ka0 ELSE ka1 END WHERE amps IS NOT NULL AND NOT (frame = 'H' AND letter = 'R')),
  c4 AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY o, att) AS n FROM c3)
  SELECT m.panel_id, CASE WHEN c4.panel_id IS NULL THEN NULL ELSE left(frame, 1) || letter || 'L' || poles || CASE frame WHEN 'Q' THEN '2' ELSE '6' END || lpad(CAST(amps AS VARCHAR), 3, '0') || CASE frame WHEN 'L' THEN 'U31X' ELSE '' END END AS main_product,
    c4.frame AS main_frame, CASE WHEN coalesce(c4.frame, split_part(m.frames, ',', 1)) = 'Q' THEN kit_q ELSE kit END AS main_kit, CASE WHEN m.frames IS NOT NULL AND c4.panel_id IS NULL THEN 'no valid main breaker' END AS main_error
  FROM mb m LEFT JOIN c4 ON c4.panel_id = m.panel_id AND n = 1 WHERE m.main_amps IS NOT NULL""", extra="int_ratings")
def r18(panels, breakers, frames, ladder, panel_catalog, iline_catalog):
    found = se.search_breaker_panel(prepared(panels, breakers, frames, ladder), panel_catalog, iline_catalog)
    return (se.size_main_breaker(found.filter("main_amps IS NOT NULL"))
            .select("panel_id", "main_product", "main_frame", "main_kit", "main_error"))


_LC_SNAP = "CASE " + " ".join(f"WHEN spaces <= {s} THEN {s}" for s in LOADCENTER_SPACES) + " ELSE 120 END"


@query("r19_loadcenter_first", "panels loadcenters", f"""WITH {SHAPED}, w AS (SELECT *, {_LC_SNAP} AS sp FROM shaped WHERE voltage = 120 AND NOT spd AND bus_amps > 0),
  h AS (SELECT w.panel_id, c.product, c.family, c.cover, w.sp, row_number() OVER (PARTITION BY w.panel_id ORDER BY CASE WHEN (c.family = 'QO') = (w.material = 'COPPER') THEN 0 ELSE 1 END) AS n
    FROM w JOIN loadcenters c ON c.enclosure = w.enclosure AND c.main = CASE WHEN main_amps IS NULL THEN 'L' ELSE 'M' END AND c.amps = bus_amps AND c.spaces = w.sp AND c.plug_on = w.plug_on AND upper(c.cover_style) = w.trim AND NOT value_pack AND NOT quik_grip)
  SELECT p.panel_id, h.product, h.family, h.cover, h.sp AS lc_spaces FROM panels p LEFT JOIN h ON h.panel_id = p.panel_id AND n = 1""")
def r19(panels, loadcenters):
    return se.loadcenter_first(shaped(panels), loadcenters).select("panel_id", "product", "family", "cover", "lc_spaces")


@query("s9_load_catalog", "panel_catalog panels", """SELECT p.panel_id, c.family, c.main, c.interior, c.ord AS cat_ord FROM panels p JOIN
  (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, main, min_amps, max_amps, spaces, phase, voltage ORDER BY ord DESC) AS k FROM panel_catalog) x WHERE k = 1) c
  ON c.max_amps = p.bus_amps AND c.spaces = p.spaces AND c.voltage = p.voltage""")
def s9(panel_catalog, panels):
    rows = se.last_wins(panel_catalog, se.PANEL_KEY).select("family", "main", F.col("max_amps").alias("bus_amps"), "spaces", "voltage", "interior", F.col("ord").alias("cat_ord"))
    return panels.select("panel_id", "bus_amps", "spaces", "voltage").join(rows, ["bus_amps", "spaces", "voltage"]).select("panel_id", "family", "main", "interior", "cat_ord")
