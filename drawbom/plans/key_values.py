"""Queries over header attributes."""

from pyspark.sql import functions as F

from drawbom.operators import keyvalue as kv, layout as ly
from drawbom.operators.spread import held
from drawbom.plans.registry import query
from drawbom.plans.text_reads import DIGIT_FIX
from drawbom.sources import files as fl

_ROLE_LIST = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(upper(text), '{kv.any_pattern(p)}') THEN '{r}' END" for r, p in kv.LABELS.items()) + "], lambda r: r IS NOT NULL)"
LABELS = f"labels AS (SELECT page_id, pos, text, conf, x1, y1, x2, y2, unnest({_ROLE_LIST}) AS role FROM tokens)"


def from_settings(df, section: str, patterns: dict[str, list[str]]):
    """Patterns after a round trip through a settings file of the shared folder."""
    path = f"{fl.shared_folder(df.sparkSession)}/lexicon"
    fl.write_settings(df.sparkSession, {section: patterns}, path)
    return fl.read_lexicon(df.sparkSession, path)


@query("h1_label_candidates", "tokens", "WITH " + LABELS + " SELECT page_id, pos, role FROM labels")
def h1(tokens):
    return kv.label_candidates(tokens).select("page_id", "pos", "role")


@query("h1_label_candidates_from_settings", "tokens", "WITH " + LABELS + " SELECT page_id, pos, role FROM labels")
def h1_settings(tokens):
    return kv.label_candidates(tokens, kv.labels_of(from_settings(tokens, "labels", kv.LABELS))).select("page_id", "pos", "role")


_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)
_FIXV = r"""regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '([0-9])[IL]([0-9])', '\1/\2', 'g'), '([0-9])[IL]([0-9])', '\1/\2', 'g'),
  '([0-9])O([0-9])', '\1' || '0' || '\2', 'g'), '([0-9])O([0-9])', '\1' || '0' || '\2', 'g'), ',', ' '), '.', ' '), '\s+', ' ', 'g')"""
VALUES = LABELS + rf""", v0 AS (SELECT t.page_id, pos, text, conf, x1, y1, x2, y2, width, upper(text) AS up, {DIGIT_FIX.format(c='upper(text)')} AS d, trim(upper(trim(text)), ':') AS nm, median(abs(y2 - y1)) OVER (PARTITION BY t.page_id) AS mh
    FROM tokens t JOIN page_sizes s ON s.page_id = t.page_id),
  v1 AS (SELECT *, {_FIXV} AS v, TRY_CAST(nullif(regexp_extract(d, '\b([1-9][0-9]{{1,3}})\s*(?:A\.?|AMPS?\.?)\b', 1), '') AS INT) AS unit, TRY_CAST(nullif(regexp_extract(d, '(?:^|[^0-9])([1-9][0-9]{{1,3}})(?:[^0-9]|$)', 1), '') AS INT) AS bare,
    TRY_CAST(nullif(regexp_extract(replace(d, ' ', ''), '\b([0-9]{{2,3}})KA\b', 1), '') AS INT) AS ka, regexp_extract(d, '\b([0-9]{{2,3}},?[0-9]{{3}})\s*(?:A|KA)?\b', 1) AS bt,
    TRY_CAST(nullif(regexp_extract(d, '(?:^|[^0-9])([0-9]{{2,3}})(?:[^0-9]|$)', 1), '') AS INT) AS sm FROM v0),
  v2 AS (SELECT *, TRY_CAST(nullif(replace(bt, ',', ''), '') AS INT) AS big, regexp_matches(v, '{kv.VOLT_RX}') AS pr, regexp_matches(v, '(^|[^0-9])[1-6][0-9]{{2,3}}([^0-9]|$)') AS sg,
    CASE WHEN unit IS NOT NULL THEN unit BETWEEN 60 AND 4000 ELSE coalesce(bare BETWEEN 60 AND 1200, FALSE) END AS am, regexp_full_match(nm, '[A-Z]{{0,2}}[0-9]{{1,2}}') OR length(nm) <= 4 AS sid FROM v1),
  vals AS (SELECT page_id, pos, conf, x1, y1, x2, y2, 'VOLTAGE' AS role, text, CASE WHEN pr THEN 0.92 ELSE 0.62 END::DOUBLE AS shape, CASE WHEN regexp_matches(v, '\b(WYE|DELTA|PH|PHASE|VOLT|VOLTS|V)\b') THEN 0.15 ELSE 0 END::DOUBLE AS ctx, FALSE AS has_unit FROM v2 WHERE pr OR sg
    UNION ALL SELECT page_id, pos, conf, x1, y1, x2, y2, r, text, CASE WHEN unit IS NOT NULL THEN 0.90 ELSE 0.68 END, CASE WHEN unit IS NOT NULL THEN 0.12 ELSE 0.04 END, unit IS NOT NULL FROM v2 CROSS JOIN (VALUES ('BUS'), ('MAIN')) r(r) WHERE am
    UNION ALL SELECT page_id, pos, conf, x1, y1, x2, y2, 'AIC', text, 0.90, 0.10, FALSE FROM v2 WHERE ka BETWEEN 10 AND 100
    UNION ALL SELECT page_id, pos, conf, x1, y1, x2, y2, 'AIC', text, CASE WHEN bt LIKE '%,%' THEN 0.95 ELSE 0.85 END, CASE WHEN regexp_matches(up, '\b(SYMMETRICAL|AIC|A\.?\s*I\.?\s*C\.?|SCCR)\b') THEN 0.08 ELSE 0 END, FALSE FROM v2 WHERE ka IS NULL AND big BETWEEN 10000 AND 100000
    UNION ALL SELECT page_id, pos, conf, x1, y1, x2, y2, 'AIC', text, 0.88, 0.20, FALSE FROM v2 WHERE ka IS NULL AND big IS NULL AND sm IN (10,14,18,22,25,30,35,42,50,65,100,125,200) AND NOT regexp_matches(d, '\bA(MPS?)?\b')
      AND EXISTS (SELECT 1 FROM labels l WHERE l.role = 'AIC' AND l.page_id = v2.page_id AND least(l.y2, v2.y2) > greatest(l.y1, v2.y1) AND v2.x1 - l.x2 BETWEEN 0 AND 3 * mh)
    UNION ALL SELECT page_id, pos, conf, x1, y1, x2, y2, 'NAME', nm, least(1, 0.58::DOUBLE + CASE WHEN sid THEN 0.18 ELSE 0 END::DOUBLE + 0.10::DOUBLE * (least(1.5, greatest(0.5, (y2 - y1) / greatest(1, mh))) - 1)), CASE WHEN regexp_matches(text, '\bPNL\b') THEN 0.05 ELSE 0 END + CASE WHEN x1 <= 0.2 * width AND y1 <= 14.4 THEN 0.12 WHEN x1 <= 0.2 * width THEN 0.08 ELSE 0 END, FALSE
      FROM v2 WHERE regexp_full_match(nm, '[A-Z0-9][A-Z0-9._\-/]{{0,10}}') AND nm NOT IN ({_IN(kv.NOT_NAMES + kv.VOLTAGE_WORDS)}) AND NOT regexp_matches(nm, '\bPANEL(BOARD)?\b|\bBOARD\b') AND (sid OR regexp_matches(nm, '[A-Z]')))"""


@query("h2_value_candidates", "tokens page_sizes", "WITH " + VALUES + " SELECT page_id, pos, role, text, round(shape, 6) AS shape, round(ctx, 6) AS ctx, has_unit FROM vals")
def h2(tokens, page_sizes):
    out = kv.value_candidates(tokens, page_sizes)
    return out.select("page_id", "pos", "role", "text", F.round("shape", 6).alias("shape"), F.round("ctx", 6).alias("ctx"), "has_unit")


@query("h3_clamp_to_header", "tokens page_sizes", "WITH " + VALUES + """, e AS (SELECT page_id, max(y2) + CAST(floor(1.2 * median(abs(y2 - y1))) AS BIGINT) AS bottom FROM labels WHERE role IN ('VOLTAGE', 'AIC', 'MAIN', 'BUS') GROUP BY page_id)
  SELECT v.page_id, pos, role FROM vals v LEFT JOIN e ON e.page_id = v.page_id WHERE bottom IS NULL OR y2 <= bottom""")
def h3(tokens, page_sizes):
    return kv.clamp_to_header(kv.value_candidates(tokens, page_sizes), kv.label_candidates(tokens)).select("page_id", "pos", "role")


_DIST = "sqrt((power((v.x1 + v.x2) - (l.x1 + l.x2), 2) + power((v.y1 + v.y2) - (l.y1 + l.y2), 2)) / 4)"
AFFINITY = VALUES + f""", near AS (SELECT v.page_id, v.pos, v.role, min({_DIST}) AS dm FROM vals v JOIN labels l ON l.page_id = v.page_id AND l.role = v.role GROUP BY v.page_id, v.pos, v.role),
  aff AS (SELECT v.*, coalesce(exp(-dm / 80), 0) AS s_lbl FROM vals v LEFT JOIN near n ON n.page_id = v.page_id AND n.pos = v.pos AND n.role = v.role)"""


@query("h4_label_affinity", "tokens page_sizes", "WITH " + AFFINITY + " SELECT page_id, pos, role, round(s_lbl, 6) AS affinity FROM aff")
def h4(tokens, page_sizes):
    out = kv.label_affinity(kv.value_candidates(tokens, page_sizes), kv.label_candidates(tokens), sizes=tokens)
    return out.select("page_id", "pos", "role", F.round("affinity", 6).alias("affinity"))


MODES = r"""nw AS (SELECT page_id, upper(concat_ws(' ', text, lead(text) OVER (PARTITION BY page_id ORDER BY y1, x1, pos))) AS t FROM tokens),
  fl AS (SELECT page_id, bool_or(regexp_matches(t, '\b(MLO|MAIN\s*LUGS?)\b')) AS mlo, bool_or(regexp_matches(t, '\b(MCB|MAIN\s*(BREAKER|DEVICE))\b')) AS mcb FROM nw GROUP BY page_id),
  modes AS (SELECT page_id, CASE WHEN mlo AND NOT mcb THEN 'MLO' WHEN mcb AND NOT mlo THEN 'MCB' END AS mode FROM fl)"""


def _w(i):
    return "CASE a.role " + " ".join(f"WHEN '{r}' THEN {w[i]}" for r, w in kv.WEIGHTS.items()) + " END::DOUBLE"


SCORED = AFFINITY + ", " + MODES + rf""", wr AS (SELECT v.page_id, v.pos, v.role, min({_DIST}) AS dw FROM vals v JOIN labels l ON l.page_id = v.page_id AND l.role = 'WRONG' GROUP BY v.page_id, v.pos, v.role),
  sd AS (SELECT DISTINCT v.page_id, v.pos, v.role FROM vals v JOIN labels l ON l.page_id = v.page_id AND l.role = v.role AND least(l.y2, v.y2) > greatest(l.y1, v.y1) AND v.x1 > l.x2),
  un AS (SELECT page_id, pos, role, sum(CASE WHEN role IN ('BUS', 'MAIN') AND has_unit THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, role ORDER BY y1, x1, pos) AS k FROM vals),
  w0 AS (SELECT a.*, k, coalesce(exp(-dw / 80), 0) AS s_wrong, CASE WHEN sd.pos IS NULL THEN 0 ELSE 1 END AS s_side, upper(a.text) AS ut,
      {_w(0)} * CASE WHEN a.role = 'MAIN' AND mode = 'MLO' THEN 0.7 WHEN a.role IN ('BUS', 'MAIN') AND mode IN ('MLO', 'MCB') THEN 1.05 ELSE 1 END AS ws0, {_w(2)} * CASE WHEN a.role IN ('BUS', 'MAIN') THEN CASE WHEN mode = 'MCB' THEN 1.05 ELSE 1.2 END ELSE 1 END AS wl0
    FROM aff a JOIN un ON un.page_id = a.page_id AND un.pos = a.pos AND un.role = a.role LEFT JOIN wr ON wr.page_id = a.page_id AND wr.pos = a.pos AND wr.role = a.role LEFT JOIN sd ON sd.page_id = a.page_id AND sd.pos = a.pos AND sd.role = a.role LEFT JOIN modes m ON m.page_id = a.page_id),
  w1 AS (SELECT a.*, CASE WHEN k > 0 THEN least(1, ws0 + 0.15 * k) ELSE ws0 END AS ws, CASE WHEN k > 0 THEN greatest(0, wl0 - 0.06 * k) ELSE wl0 END AS wl, CASE WHEN role = 'NAME' THEN greatest(0, least(1, 1 - (y1 + y2) / 2 / 80)) ELSE 0 END AS s_y,
      CASE role WHEN 'BUS' THEN regexp_matches(ut, '\bBUS\b|\bPANEL\s*RATING\b')::INT - regexp_matches(ut, '\bMAIN\b|\bMCB\b')::INT WHEN 'MAIN' THEN regexp_matches(ut, '\bMAIN\b|\bMCB\b')::INT - regexp_matches(ut, '\bBUS\b|\bPANEL\s*RATING\b')::INT ELSE 0 END AS hint FROM w0 a),
  scored AS (SELECT a.*, round(greatest(0, least(1, ws * shape + {_w(1)} * conf + wl * s_lbl + {_w(3)} * s_side + {_w(4)} * ctx - {_w(5)} * s_wrong + {_w(6)} * s_y + 0.22 * hint)), 9) AS rank FROM w1 a),
  picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, role ORDER BY rank DESC, y1, x1, pos) AS n FROM scored) z WHERE n = 1 AND rank >= CASE role WHEN 'VOLTAGE' THEN 0.55 WHEN 'NAME' THEN 0.50 ELSE 0.54 END)"""


def scored_of(tokens, page_sizes, only=None):
    """Scored candidates, if given only those that the condition `only` names: no role depends on another."""
    cands = kv.value_candidates(tokens, page_sizes)
    return kv.score_candidates(cands.filter(only) if only else cands, kv.label_candidates(tokens), kv.main_mode(tokens), tokens)


AMPS = "role IN ('BUS', 'MAIN')"


@query("h5_score_candidates", "tokens page_sizes", "WITH " + SCORED + " SELECT page_id, pos, role, round(rank, 6) AS rank FROM scored")
def h5(tokens, page_sizes):
    return scored_of(tokens, page_sizes).select("page_id", "pos", "role", F.round("rank", 6).alias("rank"))


@query("h6_pick_by_role", "tokens page_sizes", "WITH " + SCORED + " SELECT page_id, role, pos, text FROM picks")
def h6(tokens, page_sizes):
    return kv.pick_by_role(scored_of(tokens, page_sizes)).select("page_id", "role", "pos", "text")


@query("h7_main_mode", "tokens", "WITH " + MODES + " SELECT * FROM modes")
def h7(tokens):
    return kv.main_mode(tokens)


UNITS = r"""lbl AS (SELECT page_id, x1, y1, x2, y2, role FROM labels WHERE role IN ('BUS', 'MAIN')), au AS (SELECT v.page_id, v.pos, v.x1, v.y1, round(coalesce(exp(-min({d}) FILTER (l.role = 'BUS') / 80), 0), 12) AS ab, round(coalesce(exp(-min({d}) FILTER (l.role = 'MAIN') / 80), 0), 12) AS am
    FROM vals v LEFT JOIN lbl l ON l.page_id = v.page_id WHERE v.role = 'BUS' AND v.has_unit GROUP BY v.page_id, v.pos, v.x1, v.y1)""".format(d=_DIST)


@query("h8_assign_bus_main", "tokens page_sizes", "WITH " + SCORED + ", " + UNITS + """, c AS (SELECT page_id, count(*) AS n, max(ab) AS ob, max(am) AS om FROM au GROUP BY page_id),
  ub AS (SELECT page_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY round(ab - am, 9) DESC, round(ab, 9) DESC, y1, x1, pos) AS k FROM au) q WHERE k = 1),
  um AS (SELECT page_id, pos FROM (SELECT au.*, row_number() OVER (PARTITION BY au.page_id ORDER BY round(ab - am, 9), round(am, 9) DESC, y1, x1, au.pos) AS k FROM au JOIN ub ON ub.page_id = au.page_id AND ub.pos <> au.pos) q WHERE k = 1),
  r AS (SELECT page_id, max(pos) FILTER (role = 'BUS') AS rb, max(pos) FILTER (role = 'MAIN') AS rm FROM picks GROUP BY page_id),
  f AS (SELECT m.page_id, coalesce(mode, '') AS mode, n, ob, om, ub.pos AS ub, um.pos AS um, rb, rm, coalesce(n = 1 AND mode IS NULL AND om > ob + 0.08, FALSE) AS tm FROM modes m LEFT JOIN c ON c.page_id = m.page_id LEFT JOIN ub ON ub.page_id = m.page_id LEFT JOIN um ON um.page_id = m.page_id LEFT JOIN r ON r.page_id = m.page_id)
  SELECT page_id, CASE WHEN n >= 2 OR (n = 1 AND NOT tm) THEN ub ELSE rb END AS bus_pos, CASE WHEN mode <> 'MLO' THEN CASE WHEN n >= 2 THEN um WHEN tm OR (n = 1 AND mode = 'MCB') THEN ub ELSE rm END END AS main_pos FROM f""")
def h8(tokens, page_sizes):
    cands, labels = kv.value_candidates(tokens, page_sizes), kv.label_candidates(tokens)
    units = cands.filter("role = 'BUS' AND has_unit")
    near = kv.label_affinity(units.withColumn("role", F.explode(F.array(F.lit("BUS"), F.lit("MAIN")))), labels.filter(AMPS), sizes=tokens)
    of = lambda role: F.round(F.max(F.when(F.col("role") == role, F.col("affinity"))), 12)
    near = near.groupBy("page_id", "pos", "x1", "y1").agg(of("BUS").alias("aff_bus"), of("MAIN").alias("aff_main"))
    modes = kv.main_mode(tokens)
    return kv.assign_bus_main(near, kv.pick_by_role(kv.score_candidates(cands.filter(AMPS), labels, modes, tokens)), modes)


@query("h9_bus_fallback", "tokens page_sizes", "WITH " + SCORED + rf""", ms AS (SELECT page_id FROM page_sizes WHERE page_id NOT IN (SELECT page_id FROM picks WHERE role = 'BUS')),
  rk AS (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, y1, x1, pos) AS k FROM scored WHERE role IN ('BUS', 'MAIN') AND regexp_matches(upper(text), '{kv.AMPS_RX}')),
  tk AS (SELECT page_id, text, y1, x1, pos, coalesce(TRY_CAST(nullif(regexp_extract(upper(text), '(?:^|[^0-9])([1-9][0-9]{{1,3}})\s*(?:A|AMPS?)\b', 1), '') AS INT), TRY_CAST(nullif(regexp_extract(upper(text), '(?:^|[^0-9])([6-9][0-9]|[1-9][0-9]{{2,3}})\b', 1), '') AS INT)) AS n FROM tokens),
  lo AS (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, pos) AS k FROM tk WHERE n BETWEEN 60 AND 1200)
  SELECT ms.page_id, coalesce(rk.text, lo.text) AS bus_text FROM ms LEFT JOIN rk ON rk.page_id = ms.page_id AND rk.k = 1 LEFT JOIN lo ON lo.page_id = ms.page_id AND lo.k = 1""")
def h9(tokens, page_sizes):
    scored = held(scored_of(tokens, page_sizes, only=AMPS))
    missing = page_sizes.select("page_id").join(kv.pick_by_role(scored).filter("role = 'BUS'").select("page_id"), "page_id", "left_anti")
    return kv.bus_fallback(missing, scored, tokens)


def with_lines(tokens, lines=3):
    """Line numbers for the tokens of the first lines, which name a page."""
    top = held(ly.top_of_pages(tokens, lines))
    return top.join(ly.assign_lines(top), ["page_id", "pos"])


@query("h10_extract_name", "tokens page_sizes")
def h10(tokens, page_sizes):
    return kv.extract_name(with_lines(tokens), page_sizes).select("page_id", "name", "pass_no")


@query("h11_name_fallback", "tokens page_sizes", "WITH " + VALUES + rf""", c AS (SELECT page_id, text, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, pos) AS k FROM vals WHERE role = 'NAME'),
  u AS (SELECT page_id, nm, row_number() OVER (PARTITION BY page_id ORDER BY pos // 12 + 1, x1, pos) AS k FROM v0 WHERE pos // 12 + 1 <= 3 AND regexp_full_match(nm, '[A-Z0-9][A-Z0-9._\-/]{{0,10}}') AND nm NOT IN ({_IN(kv.NOT_NAMES)}))
  SELECT s.page_id, coalesce(c.text, u.nm) AS name FROM page_sizes s LEFT JOIN c ON c.page_id = s.page_id AND c.k = 1 LEFT JOIN u ON u.page_id = s.page_id AND u.k = 1""")
def h11(tokens, page_sizes):
    cands = kv.value_candidates(tokens, page_sizes)
    return kv.name_fallback(page_sizes, cands, tokens.withColumn("line_no", F.floor(F.col("pos") / 12) + 1))


_AMP = r"coalesce(TRY_CAST(nullif(regexp_extract({d}, '\b([6-9][0-9]|[1-9][0-9]{{2,3}})\s*(?:A|AMPS?)\b', 1), '') AS INT), TRY_CAST(nullif(regexp_extract({d}, '(?:^|[^0-9])([6-9][0-9]|[1-9][0-9]{{2,3}})(?:[^0-9]|$)', 1), '') AS INT))"


ATTRS = SCORED + rf""", p AS (SELECT page_id, max(text) FILTER (role = 'NAME') AS nm, {DIGIT_FIX.format(c="upper(max(text) FILTER (role = 'VOLTAGE'))")} AS vt, {DIGIT_FIX.format(c="upper(max(text) FILTER (role = 'BUS'))")} AS bt, {DIGIT_FIX.format(c="upper(max(text) FILTER (role = 'MAIN'))")} AS mt,
    upper(max(text) FILTER (role = 'MAIN')) AS mr, {DIGIT_FIX.format(c="upper(max(text) FILTER (role = 'AIC'))")} AS att FROM picks GROUP BY page_id),
  q AS (SELECT p.page_id, nm, vt, {_AMP.format(d='bt')} AS bus, {_AMP.format(d='mt')} AS main, att, CASE WHEN regexp_matches(mr, '\b(MLO|MAIN\s*LUGS?)\b') THEN 'MLO' WHEN regexp_matches(mr, '\b(MCB|MAIN\s*BREAKER)\b') THEN 'MCB' ELSE m.mode END AS mode,
    CASE WHEN replace(att, ' ', '') LIKE '%KA%' THEN TRY_CAST(nullif(regexp_extract(replace(att, ' ', ''), '\b([0-9]{{2,3}})K?A\b', 1), '') AS INT) END AS k1, TRY_CAST(nullif(replace(regexp_extract(att, '\b([0-9]{{2,3}},?[0-9]{{3}})\s*(?:A|KA)?\b', 1), ',', ''), '') AS INT) AS k2,
    TRY_CAST(nullif(regexp_extract(att, '(?:^|[^0-9])([0-9]{{2,3}})(?:[^0-9]|$)', 1), '') AS INT) AS k3 FROM p LEFT JOIN modes m ON m.page_id = p.page_id),
  attrs AS (SELECT page_id, trim(regexp_replace(regexp_replace(trim(nm), '(?i)^(?:PANEL(?:BOARD)?\b\s*:?)\s*', ''), '\s{{2,}}', ' ', 'g')) AS name, CAST(CASE WHEN vt LIKE '%600%' THEN 600 WHEN vt LIKE '%480%' THEN 480 WHEN vt LIKE '%240%' THEN 240 WHEN vt LIKE '%208%' THEN 208 WHEN vt LIKE '%120%' THEN 120 END AS INT) AS voltage,
    bus AS bus_amps, CASE WHEN mode = 'MLO' THEN NULL WHEN mode = 'MCB' THEN coalesce(main, bus) ELSE main END AS main_amps,
    CAST(CASE WHEN k1 IS NOT NULL THEN k1 WHEN k2 IS NOT NULL THEN greatest(1, k2 // 1000) WHEN k3 IN (10,14,18,22,25,30,35,42,50,65,100,125,200) AND NOT regexp_matches(att, '\bA(MPS?)?\b') THEN k3 END AS INT) AS int_rating, mode FROM q)"""


def attrs_of(tokens, page_sizes, names=None):
    modes, cands = kv.main_mode(tokens), kv.value_candidates(tokens, page_sizes)
    scored = kv.score_candidates(kv.with_extracted_name(cands, names, page_sizes) if names else cands, kv.label_candidates(tokens), modes, tokens)
    return kv.build_panel_attrs(kv.pick_by_role(scored), modes)


@query("h12_build_panel_attrs", "tokens page_sizes", "WITH " + ATTRS + " SELECT * FROM attrs")
def h12(tokens, page_sizes):
    return attrs_of(tokens, page_sizes)


@query("h14_attrs_with_extracted_name", "tokens page_sizes")
def h14(tokens, page_sizes):
    return attrs_of(tokens, page_sizes, kv.extract_name(with_lines(tokens), page_sizes))


def header_text(stamps):
    k = F.col("read_id")
    return stamps.select(k.alias("text_id"), F.concat_ws(
        " ", F.when(k % 3 == 0, "Panel:").when(k % 3 == 1, "PANEL SCHEDULE -").otherwise("PNL"), F.when(k % 17 == 0, "MSB").otherwise(F.concat(F.lit("LP"), F.col("w1"))),
        "volt_text", F.lit("bus"), "amp_text", F.when(k % 2 == 0, "Main Breaker 225").otherwise("MLO"), F.lit("A.I.C. rating"), "ka_text",
        F.when(k % 5 == 0, "SPD 160kA")).alias("text"))


_FIELDS: dict = {}
for _f, _o, _p in sorted(kv.LEXICON, key=lambda r: (r[0], r[1])):
    _FIELDS.setdefault(_f, []).append(f"nullif(regexp_extract(u, '{_p}', 1), '')")


H13_SQL = """WITH t AS (SELECT read_id AS text_id, upper(concat_ws(' ', CASE read_id % 3 WHEN 0 THEN 'Panel:' WHEN 1 THEN 'PANEL SCHEDULE -' ELSE 'PNL' END, CASE WHEN read_id % 17 = 0 THEN 'MSB' ELSE 'LP' || w1 END, volt_text, 'bus', amp_text,
    CASE WHEN read_id % 2 = 0 THEN 'Main Breaker 225' ELSE 'MLO' END, 'A.I.C. rating', ka_text, CASE WHEN read_id % 5 = 0 THEN 'SPD 160kA' END)) AS u FROM stamps),
  f AS (""" + " UNION ALL ".join(f"SELECT text_id, '{f}' AS field, coalesce({', '.join(ps)}) AS value FROM t" for f, ps in _FIELDS.items()) + rf"""), g AS (SELECT *, TRY_CAST(replace(value, ',', '') AS INT) AS k, {DIGIT_FIX.format(c='upper(value)')} AS vt FROM f WHERE value IS NOT NULL),
  h AS (SELECT text_id, field, CASE field WHEN 'panel_name' THEN left(value, 32) WHEN 'voltage' THEN CAST(CASE WHEN vt LIKE '%600%' THEN 600 WHEN vt LIKE '%480%' THEN 480 WHEN vt LIKE '%240%' THEN 240 WHEN vt LIKE '%208%' THEN 208 WHEN vt LIKE '%120%' THEN 120 END AS VARCHAR)
      WHEN 'int_rating' THEN CAST(CASE WHEN k >= 1000 THEN k // 1000 ELSE k END AS VARCHAR) ELSE CAST(k AS VARCHAR) END AS value FROM g)
  SELECT * FROM h WHERE value IS NOT NULL AND NOT (field = 'panel_name' AND value IN ('MSB', 'SWBD', 'SWITCHBOARD'))"""


@query("h13_extract_by_lexicon", "stamps", H13_SQL)
def h13(stamps):
    return kv.extract_by_lexicon(header_text(stamps))


@query("h13_extract_by_lexicon_from_settings", "stamps", H13_SQL)
def h13_settings(stamps):
    fields = {}
    for field, _, pattern in sorted(kv.LEXICON):
        fields.setdefault(field, []).append(pattern)
    return kv.extract_by_lexicon(header_text(stamps), from_settings(stamps, "header", fields))
