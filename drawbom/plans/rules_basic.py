"""Queries over settings, breaker validation, sizing and branch parts."""

from pyspark.sql import functions as F

from drawbom.functions.electrical import phase_from_volts, snap_spaces
from drawbom.operators.rules import branch as br, settings as st, sizing as sz
from drawbom.plans.registry import query
from drawbom.plans.text_reads import SNAP_UP2

ITEMS_SQL = """SELECT o_orderkey AS item_id, o_custkey AS job_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'panelboards' WHEN 1 THEN 'transformers' ELSE 'disconnects' END AS domain FROM orders"""


def items_of(orders):
    domain = (F.when(F.col("o_orderkey") % 3 == 0, "panelboards").when(F.col("o_orderkey") % 3 == 1, "transformers")
              .otherwise("disconnects"))
    return orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("job_id"), domain.alias("domain"))


@query("r1_resolve_settings", "orders settings default_settings", f"""WITH items AS ({ITEMS_SQL}),
  l AS (SELECT scope, scope_id, domain AS ld, CASE key WHEN 'material' THEN 'bussing_material' WHEN 'allowPlugOn' THEN 'allow_plug_on_breakers'
    WHEN 'panelRatingType' THEN 'rating_type' WHEN 'trimStyle' THEN 'default_trim_style' WHEN 'nema' THEN 'enclosure' ELSE key END AS key, value, ord FROM settings),
  cand AS (SELECT item_id, i.domain, d.key, d.value, 0 AS r, 0 AS o FROM items i JOIN default_settings d ON d.domain = i.domain
    UNION ALL SELECT item_id, domain, key, value, CASE ld WHEN '*' THEN 1 ELSE 2 END, ord FROM items JOIN l ON scope = 'job' AND scope_id = job_id AND ld IN ('*', domain)
    UNION ALL SELECT item_id, domain, key, value, CASE ld WHEN '*' THEN 3 ELSE 4 END, ord FROM items JOIN l ON scope = 'item' AND scope_id = item_id AND ld IN ('*', domain))
  SELECT item_id, domain, key, value FROM (SELECT *, row_number() OVER (PARTITION BY item_id, domain, key ORDER BY r DESC, o DESC) AS n FROM cand) c WHERE n = 1""")
def r1(orders, settings, default_settings):
    return st.resolve_settings(items_of(orders), settings, default_settings)


@query("r2_default_int_rating", "panels", """SELECT panel_id, coalesce(int_rating, 22) AS int_rating,
  CASE WHEN int_rating IS NULL THEN 'No interrupting rating detected - system defaulted to 22kAIC' END AS rating_note FROM panels""")
def r2(panels):
    return st.default_int_rating(panels).select("panel_id", "int_rating", "rating_note")


VALID = """valid AS (SELECT *, CASE WHEN poles NOT IN (1, 2, 3) OR amperage <= 0 OR cnt <= 0 THEN
    'missing or invalid ' || concat_ws(', ', CASE WHEN poles NOT IN (1, 2, 3) THEN 'poles' END, CASE WHEN amperage <= 0 THEN 'amperage' END, CASE WHEN cnt <= 0 THEN 'count' END)
  WHEN amperage NOT BETWEEN 15 AND 1200 THEN CAST(amperage AS VARCHAR) || 'A outside 15-1200A' END AS reject_note FROM breakers)"""
MERGED = VALID + """, merged AS (SELECT panel_id, poles, amperage, special_features, CAST(sum(cnt) AS BIGINT) AS cnt FROM valid WHERE reject_note IS NULL GROUP BY ALL)"""
USABLE = MERGED + """, usable AS (SELECT m.* FROM merged m JOIN panels p ON p.panel_id = m.panel_id
  WHERE amperage <= CASE WHEN main_amps IS NULL THEN bus_amps ELSE least(bus_amps, main_amps) END)"""


@query("r3_validate_breakers", "breakers", "WITH " + VALID + " SELECT panel_id, ord, reject_note FROM valid")
def r3(breakers):
    return sz.validate_breakers(breakers).select("panel_id", "ord", "reject_note")


@query("r4_coalesce_breakers", "breakers", "WITH " + MERGED + " SELECT * FROM merged")
def r4(breakers):
    return sz.coalesce_breakers(sz.validate_breakers(breakers).filter("reject_note IS NULL"))


def with_gaps(panels):
    """Panels with some attributes missing, as detection leaves them."""
    return panels.select("panel_id", F.nullif("bus_amps", F.lit(250)).alias("bus_amps"),
                         F.nullif("voltage", F.lit(600)).alias("voltage"), F.nullif("spaces", F.lit(16)).alias("spaces"),
                         "int_rating", (F.col("panel_id") % 2 == 0).alias("spd"))


@query("r5_require_attrs", "panels", """WITH g AS (SELECT panel_id, nullif(bus_amps, 250) AS b, nullif(voltage, 600) AS v, nullif(spaces, 16) AS s, int_rating AS k, panel_id % 2 = 0 AS spd FROM panels),
  m AS (SELECT panel_id, concat_ws(', ', CASE WHEN b IS NULL THEN 'amperage' END, CASE WHEN v IS NULL THEN 'voltage' END, CASE WHEN s IS NULL THEN 'spaces' END,
    CASE WHEN k IS NULL AND NOT coalesce(v = 120 AND NOT spd, FALSE) THEN 'intRating' END) AS missing FROM g)
  SELECT panel_id, CASE WHEN missing <> '' THEN 'Missing required attributes: ' || missing END AS skip_reason FROM m""")
def r5(panels):
    return st.require_attrs(with_gaps(panels)).select("panel_id", "skip_reason")


@query("r6_reject_over_limit", "panels breakers", "WITH " + MERGED + """
  SELECT m.panel_id, poles, amperage, special_features, CASE WHEN main_amps IS NULL THEN bus_amps ELSE least(bus_amps, main_amps) END AS limit_amps,
    amperage > CASE WHEN main_amps IS NULL THEN bus_amps ELSE least(bus_amps, main_amps) END AS over_limit,
    bool_or(amperage > CASE WHEN main_amps IS NULL THEN bus_amps ELSE least(bus_amps, main_amps) END) OVER (PARTITION BY m.panel_id) AS needs_user_review
  FROM merged m JOIN panels p ON p.panel_id = m.panel_id""")
def r6(panels, breakers):
    valid = sz.validate_breakers(breakers).filter("reject_note IS NULL")
    limited = sz.reject_over_limit(panels, sz.coalesce_breakers(valid))
    return (limited.join(sz.panels_for_review(limited), "panel_id")
            .select("panel_id", "poles", "amperage", "special_features", "limit_amps", "over_limit", "needs_user_review"))


FITTED = """fitted AS (SELECT b.panel_id, b.ord, b.poles, b.amperage, b.cnt, f.frame, f.width, f.rating AS frame_amps,
    row_number() OVER (PARTITION BY b.panel_id, b.ord ORDER BY f.ord, f.rating) AS n
  FROM breakers b JOIN panels p ON p.panel_id = b.panel_id LEFT JOIN frames f ON f.poles = b.poles AND f.rating >= b.amperage
    AND f.max_volts >= CASE voltage WHEN 208 THEN 240 ELSE voltage END)"""


@query("r7_first_fit_frame", "panels breakers frames", "WITH " + FITTED + """
  SELECT panel_id, ord, frame, width, frame_amps FROM fitted WHERE n = 1""")
def r7(panels, breakers, frames):
    rows = breakers.join(panels.select("panel_id", "voltage"), "panel_id")
    return sz.first_fit_frame(rows, frames).select("panel_id", "ord", "frame", "width", "frame_amps")


NEED = USABLE.replace("usable AS", "usable AS") + """, fit AS (SELECT u.*, f.width, row_number() OVER (PARTITION BY u.panel_id, u.poles, u.amperage, u.special_features ORDER BY f.ord, f.rating) AS n
    FROM usable u JOIN panels p ON p.panel_id = u.panel_id LEFT JOIN frames f ON f.poles = u.poles AND f.rating >= u.amperage AND f.max_volts >= CASE voltage WHEN 208 THEN 240 ELSE voltage END),
  need AS (SELECT panel_id, CAST(sum(poles * cnt) AS BIGINT) AS slots, CAST(ceil(coalesce(sum(CASE WHEN poles >= 2 THEN width * cnt END), 0) / 1.5) AS BIGINT) AS frame_spaces FROM fit WHERE n = 1 GROUP BY panel_id),
  sized AS (SELECT p.*, coalesce(slots, 0) AS slots, coalesce(frame_spaces, 0) AS frame_spaces,
    coalesce(least(nullif(slots, 0), nullif(frame_spaces, 0)), 0) AS needed FROM panels p LEFT JOIN need n ON n.panel_id = p.panel_id)"""


@query("r8_required_spaces", "panels breakers frames", "WITH " + NEED + """
  SELECT panel_id, slots, frame_spaces, needed, CASE WHEN spaces > 0 AND needed > spaces THEN needed - spaces ELSE 0 END AS overflow FROM sized""")
def r8(panels, breakers, frames):
    out = sz.required_spaces(panels, sz.usable_breakers(panels, breakers), frames)
    return out.select("panel_id", "slots", "frame_spaces", "needed", "overflow")


def configured(panels):
    """Panels with defaulted rating and their resolved mounting and rating type."""
    return (st.default_int_rating(panels).withColumn("plug_on", F.col("job_id") % 3 != 0)
            .withColumn("series_rated", F.col("job_id") % 4 == 0))


CONFIGURED = "cfg AS (SELECT panel_id, job_id, ord, raw_name, voltage, bus_amps, main_amps, coalesce(int_rating, 22) AS int_rating, spaces, job_id % 3 <> 0 AS plug_on, job_id % 4 = 0 AS series_rated FROM panels)"
BASE_CASE = """CASE WHEN series_rated THEN CASE WHEN plug_on THEN 'QO' ELSE 'QOB' END WHEN int_rating >= 65 THEN 'QH' WHEN int_rating >= 42 THEN CASE WHEN poles IN (1, 2) THEN 'QOH' ELSE 'QH' END
  WHEN voltage IN (208, 240) AND int_rating >= 25 THEN 'QH' WHEN int_rating >= 22 THEN CASE WHEN plug_on THEN 'QO-VH' ELSE 'QOB-VH' END WHEN plug_on THEN 'QO' ELSE 'QOB' END"""
SCREEN = USABLE + ", " + CONFIGURED + f""", based AS (SELECT u.*, c.voltage, c.int_rating, c.plug_on, c.series_rated, {BASE_CASE} AS base FROM usable u JOIN cfg c ON c.panel_id = u.panel_id),
  checked AS (SELECT b.panel_id, b.voltage <= 240 AND EXISTS (SELECT 1 FROM ladder l WHERE l.family = b.base AND l.poles = b.poles AND l.rating >= b.amperage) AS nq,
    b.amperage BETWEEN 15 AND CASE WHEN b.poles = 1 THEN 70 ELSE 125 END AS nf FROM based b),
  screen AS (SELECT c.panel_id, coalesce(bool_and(nq), TRUE) AS allow_nq, coalesce(bool_and(nf), TRUE) AS allow_nf FROM cfg c LEFT JOIN checked k ON k.panel_id = c.panel_id GROUP BY c.panel_id)"""


@query("r9_family_screen", "panels breakers ladder", "WITH " + SCREEN + " SELECT * FROM screen")
def r9(panels, breakers, ladder):
    return (sz.family_screen(configured(panels), sz.usable_breakers(panels, breakers), ladder)
            .select("panel_id", "allow_nq", "allow_nf"))


@query("r10_choose_base_family", "panels breakers", "WITH " + CONFIGURED + f" SELECT b.panel_id, b.ord, {BASE_CASE} AS base FROM breakers b JOIN cfg c ON c.panel_id = b.panel_id")
def r10(panels, breakers):
    rows = breakers.join(configured(panels).drop("ord"), "panel_id")
    return rows.select("panel_id", "ord", sz.choose_base_family(
        F.col("int_rating"), F.col("voltage"), F.col("plug_on"), F.col("series_rated"), F.col("poles")).alias("base"))


@query("r11_snap_up", "breakers ladder", """SELECT b.panel_id, b.ord, min(l.rating) FILTER (l.rating >= b.amperage) AS next_or_null,
    coalesce(min(l.rating) FILTER (l.rating >= b.amperage), max(l.rating)) AS next_or_max
  FROM breakers b LEFT JOIN ladder l ON l.family = 'E' AND l.poles = b.poles GROUP BY b.panel_id, b.ord""")
def r11(breakers, ladder):
    e = ladder.filter("family = 'E'")
    out = sz.snap_up(breakers, e, "amperage", ["poles"], "next_or_null")
    return sz.snap_up(out, e, "amperage", ["poles"], "next_or_max", over="max").select("panel_id", "ord", "next_or_null", "next_or_max")


NQ_LINES = SCREEN + """, nq1 AS (SELECT b.*, (SELECT min(rating) FROM ladder l WHERE l.family = b.base AND l.poles = b.poles AND rating >= b.amperage) AS a0,
    (SELECT min(rating) FROM ladder l WHERE l.family = 'QH' AND l.poles = b.poles AND rating >= b.amperage) AS ah FROM based b),
  nq2 AS (SELECT *, CASE WHEN base = 'QOH' AND poles <> 2 AND a0 IS NOT NULL THEN CASE WHEN plug_on THEN 'QH' ELSE 'QHB' END ELSE base END AS fam,
    CASE WHEN base = 'QOH' AND poles <> 2 AND a0 IS NOT NULL THEN ah ELSE a0 END AS amps FROM nq1),
  nq3 AS (SELECT *, CASE WHEN a0 IS NULL THEN 'exceeds branch maximum' WHEN amps IS NULL THEN 'no amperage for the high-rated base'
    WHEN special_features <> '' AND (fam IN ('QH', 'QHB') OR amps NOT IN (15, 20, 25, 30, 40, 50, 60)) THEN 'special feature not available' END AS note FROM nq2),
  nq_lines AS (SELECT panel_id, poles, amperage, cnt, note, CASE WHEN note IS NULL THEN CASE WHEN fam = 'QOH' THEN 'QOH2' || amps WHEN fam IN ('QH', 'QHB') THEN fam || poles || amps
      ELSE replace(fam, '-VH', '') || poles || amps || CASE WHEN fam LIKE '%-VH' THEN 'VH' ELSE '' END || special_features END END AS product,
    CASE WHEN note IS NULL THEN CASE WHEN fam IN ('QH', 'QHB') THEN '65k' WHEN fam = 'QOH' THEN '42k' WHEN fam LIKE '%-VH' THEN '22k' ELSE '10k' END END AS rating FROM nq3)"""


@query("r12_build_branch_nq", "panels breakers ladder", "WITH " + NQ_LINES + """
  SELECT panel_id, product, rating, note, CAST(sum(cnt) AS BIGINT) AS qty FROM nq_lines GROUP BY ALL""")
def r12(panels, breakers, ladder):
    return br.summarise_branch(br.nq_branch_lines(configured(panels), sz.usable_breakers(panels, breakers), ladder))


NF_LINES = USABLE + ", " + CONFIGURED + """, nf1 AS (SELECT u.*, coalesce((SELECT min(rating) FROM ladder l WHERE l.family = 'E' AND l.poles = u.poles AND rating >= u.amperage),
      (SELECT max(rating) FROM ladder l WHERE l.family = 'E' AND l.poles = u.poles)) AS amps,
    CASE WHEN series_rated OR int_rating <= 18 THEN 18 WHEN int_rating <= 35 THEN 35 ELSE 65 END AS ka FROM usable u JOIN cfg c ON c.panel_id = u.panel_id),
  nf_lines AS (SELECT panel_id, poles, amperage, cnt, CASE ka WHEN 18 THEN 'EDB' WHEN 35 THEN 'EGB' ELSE 'EJB' END || poles || '4' || lpad(CAST(amps AS VARCHAR), 3, '0') AS product,
    ka || 'kA' AS rating, CAST(NULL AS VARCHAR) AS note FROM nf1)"""


@query("r13_build_branch_nf", "panels breakers ladder", "WITH " + NF_LINES + """
  SELECT panel_id, product, rating, note, CAST(sum(cnt) AS BIGINT) AS qty FROM nf_lines GROUP BY ALL""")
def r13(panels, breakers, ladder):
    return br.summarise_branch(br.nf_branch_lines(configured(panels), sz.usable_breakers(panels, breakers), ladder))


PANEL_TYPES = ["QO", "HOM", "NQ", "NF"]
FILL = USABLE + f""", typed AS (SELECT panel_id, {SNAP_UP2.format(more='')} AS spaces, ['QO', 'HOM', 'NQ', 'NF'][CAST(panel_id % 4 AS INT) + 1] AS panel_type FROM panels),
  u AS (SELECT panel_id, CAST(sum(poles * cnt) AS BIGINT) AS used FROM usable GROUP BY panel_id),
  filled AS (SELECT t.panel_id, coalesce(used, 0) AS used, greatest(0, spaces - coalesce(used, 0)) AS blanks, spaces, product, pack_size
    FROM typed t LEFT JOIN u ON u.panel_id = t.panel_id LEFT JOIN fillers f ON f.panel_type = t.panel_type)"""


def typed_panels(panels):
    types = F.array(*[F.lit(t) for t in PANEL_TYPES])
    return panels.select("panel_id", snap_spaces(F.col("spaces"), both_sides=False).alias("spaces"),
                         F.get(types, (F.col("panel_id") % 4).cast("int")).alias("panel_type"))


@query("r14_remaining_and_fillers", "panels breakers fillers", "WITH " + FILL + """
  SELECT panel_id, used, blanks, CASE WHEN blanks > 0 THEN product END AS product,
    CASE WHEN blanks > 0 THEN CAST(ceil(blanks / pack_size) AS BIGINT) ELSE 0 END AS packs, spaces > 0 AND used > spaces AS overflow FROM filled""")
def r14(panels, breakers, fillers):
    return br.remaining_and_fillers(typed_panels(panels), sz.usable_breakers(panels, breakers), fillers)


@query("r20_allowed_pairs", "breakers pair_rules", """WITH req AS (SELECT panel_id, ord, CASE WHEN amperage >= 150 THEN 'J' ELSE 'H' END AS frame,
    ['D', 'G', 'J', 'L'][CAST(panel_id % 4 AS INT) + 1] AS letter, amperage AS amps FROM breakers),
  pref AS (SELECT frame, letter, amps, CASE WHEN pair IN ('AB', 'BA') THEN 'AB' WHEN pair IN ('AC', 'CA') THEN 'AC' ELSE 'BC' END AS canon, min(pair) AS pair FROM pair_rules GROUP BY ALL),
  sets AS (SELECT frame, letter, amps, string_agg(pair, ',' ORDER BY canon) AS pairs FROM pref GROUP BY ALL)
  SELECT panel_id, ord, r.frame, r.letter, r.amps, coalesce(pairs, 'AB,BC,AC') AS pairs FROM req r LEFT JOIN sets s ON s.frame = r.frame AND s.letter = r.letter AND s.amps = r.amps""")
def r20(breakers, pair_rules):
    letters = F.array(*[F.lit(x) for x in "DGJL"])
    req = breakers.select("panel_id", "ord", F.when(F.col("amperage") >= 150, "J").otherwise("H").alias("frame"),
                          F.get(letters, (F.col("panel_id") % 4).cast("int")).alias("letter"), F.col("amperage").alias("amps"))
    return sz.allowed_pairs(req, pair_rules).withColumn("pairs", F.array_join("pairs", ",")).select(
        "panel_id", "ord", "frame", "letter", "amps", "pairs")


@query("r29_phase_and_largest_branch", "breakers transformer_items", """SELECT 'phase' AS kind, item_id AS id, CASE WHEN secondary_volts = 120 AND primary_volts IN (240, 277, 208, 600) THEN '1PHASE' ELSE '3PHASE' END AS value FROM transformer_items
  UNION ALL SELECT 'largest', panel_id, CAST(max(amperage) AS VARCHAR) FROM breakers GROUP BY panel_id""")
def r29(breakers, transformer_items):
    phases = transformer_items.select(F.lit("phase").alias("kind"), F.col("item_id").alias("id"),
                                      phase_from_volts(F.col("primary_volts"), F.col("secondary_volts")).alias("value"))
    largest = sz.largest_branch(breakers).select(F.lit("largest").alias("kind"), F.col("panel_id").alias("id"),
                                                 F.col("largest_amps").cast("string").alias("value"))
    return phases.unionByName(largest)
