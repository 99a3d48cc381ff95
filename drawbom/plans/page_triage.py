"""Queries over page triage."""

from pyspark.sql import functions as F

from drawbom.operators import pages as pg
from drawbom.plans.key_values import from_settings
from drawbom.plans.registry import query
from drawbom.plans.text_reads import _CHARS
from drawbom.sources.derived import PAGE_WORDS  # noqa: F401

SHEETS = _CHARS.format(key="page_id, pdf_id, conf", src="text", tbl="tokens") + r""",
  sheet AS (SELECT page_id, pdf_id, conf, CASE WHEN right(fixed, 1) = '-' THEN left(fixed, length(fixed) - 1) ELSE fixed END AS f FROM fixed),
  decisions AS (SELECT pdf_id, page_id, CASE WHEN bool_or(regexp_matches(f, '^E[A-Z\-]{0,5}.*\d.*\d')) THEN 'E'
    WHEN bool_or(conf >= 0.7 AND regexp_matches(f, '^(?:P|M|C|A|F|S|X)[A-Z\-]{0,5}.*\d.*\d')) THEN 'nonE'
    ELSE 'undecided' END AS decision FROM sheet GROUP BY pdf_id, page_id)"""


@query("p1_page_pass_a", "tokens", "WITH " + SHEETS + " SELECT * FROM decisions")
def p1(tokens):
    return pg.page_pass_a(tokens)


_ALL = " UNION ALL ".join(
    f"SELECT page_id, '{b}' AS bucket, {i} AS ord, lower(m) AS phrase FROM (SELECT page_id, unnest(regexp_extract_all(t, '(?i){p}')) AS m FROM page_text) x"
    for i, (b, p) in enumerate(pg.LABEL_PATTERNS))
MATCHES = rf"""page_text AS (SELECT page_id, trim(regexp_replace(string_agg(text, ' ' ORDER BY pos), '\s+', ' ', 'g')) AS t FROM tokens GROUP BY page_id),
  matches AS (SELECT page_id, bucket, ord, phrase, count(*) AS hits FROM ({_ALL}) u GROUP BY ALL)"""


@query("p2_match_label_buckets", "tokens", "WITH " + MATCHES + " SELECT * FROM matches")
def p2(tokens):
    return pg.match_label_buckets(tokens)


@query("p2_match_label_buckets_from_settings", "tokens", "WITH " + MATCHES + " SELECT * FROM matches")
def p2_settings(tokens):
    """Patterns from a settings file, with their place in the list as `ord`."""
    lists = {}
    for i, (bucket, pattern) in enumerate(pg.LABEL_PATTERNS):
        lists[f"{i:03d} {bucket}"] = [pattern]
    rows = from_settings(tokens, "buckets", lists)
    return pg.match_label_buckets(tokens, [(name.split(" ", 1)[1], pattern) for name, _, pattern in rows])


CONFS = r"""phrases AS (SELECT DISTINCT page_id, phrase FROM matches),
  near AS (SELECT p.page_id, p.phrase, CAST(sum(CAST(t.conf AS DECIMAL(12,6))) AS DOUBLE) / count(*) AS c FROM phrases p JOIN tokens t ON t.page_id = p.page_id
    AND len(list_filter(regexp_split_to_array(lower(trim(t.text)), '\s+'), lambda w: w <> '' AND contains(p.phrase, w))) > 0 GROUP BY p.page_id, p.phrase),
  confs AS (SELECT p.page_id, p.phrase, coalesce(n.c, 0.9) AS conf FROM phrases p LEFT JOIN near n ON n.page_id = p.page_id AND n.phrase = p.phrase)"""


@query("p3_match_confidence", "tokens", "WITH " + MATCHES + ", " + CONFS + " SELECT page_id, phrase, round(conf, 6) AS conf FROM confs")
def p3(tokens):
    out = pg.match_confidence(tokens, pg.match_label_buckets(tokens))
    return out.withColumn("conf", F.round("conf", 6))


FUZZY = ("fuzzy AS (SELECT page_id, " + ", ".join(
    f"bool_or(levenshtein(word, '{t}') <= {d}) AS like_{t}" for t, d in pg.FUZZY_VOCAB)
    + " FROM (SELECT page_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM tokens) w GROUP BY page_id)")


@query("p4_fuzzy_vocab_hit", "tokens", "WITH " + FUZZY + " SELECT * FROM fuzzy")
def p4(tokens):
    return pg.fuzzy_vocab_hit(tokens)


SCORES = MATCHES + ", " + CONFS + ", " + FUZZY + r""",
  base AS (SELECT m.page_id, sum(CAST(round((CASE bucket WHEN 'panel_schedules' THEN 4.5 WHEN 'single_one_line' THEN 4.5 WHEN 'riser' THEN 3.5 WHEN 'diagram_generic' THEN 2.0 ELSE 1.0 END::DOUBLE
      + CASE WHEN m.phrase LIKE '%schedules%' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END) * conf * 1.2::DOUBLE * hits, 9) AS DECIMAL(18,9))) AS b,
      list(DISTINCT bucket) AS found FROM matches m JOIN confs c ON c.page_id = m.page_id AND c.phrase = m.phrase GROUP BY m.page_id),
  flags AS (SELECT f.page_id, coalesce(b, 0) AS b, coalesce(found, []) AS found,
      like_schedule OR like_schedules AS sched, like_panel OR like_panelboard AS pan, (like_single OR like_one OR like_1) AND like_line AS sl, like_riser AS ri,
      like_diagram OR like_diagrams OR like_drawing OR like_drawings OR like_schematic OR like_schematics AS dg FROM fuzzy f LEFT JOIN base USING (page_id)),
  boosts AS (SELECT page_id, b, found, [CASE WHEN sched AND pan AND NOT list_contains(found, 'panel_schedules') THEN 'panel_schedules' END,
      CASE WHEN sched AND NOT pan AND NOT list_contains(found, 'schedules_generic') AND NOT list_contains(found, 'panel_schedules') THEN 'schedules_generic' END,
      CASE WHEN sl AND NOT list_contains(found, 'single_one_line') THEN 'single_one_line' END,
      CASE WHEN ri AND NOT list_contains(found, 'riser') THEN 'riser' END,
      CASE WHEN dg AND NOT list_contains(found, 'diagram_generic') THEN 'diagram_generic' END] AS extra FROM flags),
  scores AS (SELECT page_id, CAST(round(b + CAST((CASE WHEN list_contains(extra, 'panel_schedules') THEN 4.5 ELSE 0 END + CASE WHEN list_contains(extra, 'schedules_generic') THEN 1 ELSE 0 END
      + CASE WHEN list_contains(extra, 'single_one_line') THEN 4.5 ELSE 0 END + CASE WHEN list_contains(extra, 'riser') THEN 3.5 ELSE 0 END
      + CASE WHEN list_contains(extra, 'diagram_generic') THEN 2 ELSE 0 END) AS DECIMAL(18,9)), 3) AS DOUBLE) AS score,
      list_sort(list_concat(found, list_filter(extra, lambda e: e IS NOT NULL))) AS tags FROM boosts)"""


@query("p5_score_page_labels", "tokens", "WITH " + SCORES + " SELECT page_id, score, array_to_string(tags, ',') AS tags FROM scores")
def p5(tokens):
    return pg.score_page_labels(tokens).withColumn("tags", F.array_join("tags", ","))


SELECTED = SCORES + ", " + SHEETS + r""",
  e AS (SELECT pdf_id, page_id, score, list_contains(tags, 'panel_schedules') AS panel, NOT list_contains(tags, 'panel_schedules') AND list_contains(tags, 'schedules_generic') AS sched,
      list_has_any(tags, ['single_one_line', 'riser', 'diagram_generic']) AS other FROM scores JOIN decisions USING (page_id) WHERE decision = 'E'),
  pdf AS (SELECT pdf_id, bool_or(panel) AS ap, bool_or(sched) AS asch, bool_or(other) AS ao, max(score) AS best FROM e GROUP BY pdf_id),
  selected AS (SELECT * FROM (SELECT pdf_id, page_id, CASE WHEN panel THEN 'panel schedule' WHEN sched AND NOT ap THEN 'generic schedule' WHEN other THEN 'diagram'
      WHEN ap OR asch OR ao THEN NULL WHEN score >= 6.5 THEN 'strong labels' WHEN best < 6.5 AND score >= 3 THEN 'weak labels'
      WHEN best < 3 THEN 'sheet number only' END AS reason FROM e JOIN pdf USING (pdf_id)) s WHERE reason IS NOT NULL)"""


def _e_scores(tokens):
    e = pg.page_pass_a(tokens).filter("decision = 'E'")
    return pg.score_page_labels(tokens).join(e, "page_id")


@query("p6_select_pages", "tokens", "WITH " + SELECTED + " SELECT pdf_id, page_id, reason FROM selected")
def p6(tokens):
    return pg.select_pages(_e_scores(tokens))


# the title block column is what the page decision normally reads
CORNER = """corner AS (SELECT t.* FROM tokens t JOIN page_sizes s ON s.page_id = t.page_id
  WHERE (t.x1 + t.x2) / 2 BETWEEN 0.88::DOUBLE * width AND width AND (t.y1 + t.y2) / 2 BETWEEN 0.74::DOUBLE * height AND 0.98::DOUBLE * height), """


def in_corner(sql):
    sql = sql.replace("FROM tokens", "FROM corner").replace("JOIN tokens", "JOIN corner")
    return CORNER + sql.replace("  decisions AS (SELECT pdf_id", "  seen AS (SELECT pdf_id").replace(
        "GROUP BY pdf_id, page_id)", """GROUP BY pdf_id, page_id),
  decisions AS (SELECT p.pdf_id, p.page_id, coalesce(s.decision, 'undecided') AS decision FROM pdf_pages p LEFT JOIN seen s ON s.page_id = p.page_id)""")


def _corner_decisions(tokens, page_sizes, pdf_pages):
    return pg.page_pass_a(pg.corner_tokens(tokens, page_sizes), pdf_pages)


VOIDS = """voids AS (SELECT page_id, count(*) AS footprints FROM footprints WHERE bbox_w_frac BETWEEN 0.10 AND 0.55 AND bbox_h_frac BETWEEN 0.10 AND 0.60
  AND rectangularity >= 0.7 AND left_px > 4 AND top_px > 4 AND right_px > 4 AND bottom_px > 4 GROUP BY page_id)"""
FALLBACK = VOIDS + """, fallback AS (SELECT d.pdf_id, d.page_id, footprints FROM decisions d JOIN voids v ON v.page_id = d.page_id
  WHERE decision = 'undecided' AND footprints >= 2 AND d.pdf_id NOT IN (SELECT pdf_id FROM decisions WHERE decision = 'E'))"""


@query("p7_select_pages_fallback", "tokens page_sizes pdf_pages footprints", "WITH " + in_corner(SHEETS) + ", " + FALLBACK + " SELECT * FROM fallback")
def p7(tokens, page_sizes, pdf_pages, footprints):
    return pg.select_pages_fallback(_corner_decisions(tokens, page_sizes, pdf_pages), footprints)


@query("p8_qualify_footprints", "footprints", "WITH " + VOIDS + " SELECT * FROM voids")
def p8(footprints):
    return pg.qualify_footprints(footprints)


@query("p9_pages_or_all", "tokens page_sizes pdf_pages footprints", "WITH " + in_corner(SHEETS) + ", " + FALLBACK + """
  SELECT pdf_id, page_id, TRUE AS selected FROM fallback UNION ALL
  SELECT pdf_id, page_id, FALSE FROM pdf_pages WHERE pdf_id NOT IN (SELECT pdf_id FROM fallback)""")
def p9(tokens, page_sizes, pdf_pages, footprints):
    decisions = _corner_decisions(tokens, page_sizes, pdf_pages)
    return pg.pages_or_all(pg.select_pages_fallback(decisions, footprints), pdf_pages)


@query("p10_panel_status_filter", "tokens stamps", r"""SELECT read_id AS page_id, label_text AS name FROM stamps
  WHERE upper(trim(label_text)) NOT IN ('MSB', 'SWBD', 'SWITCHBOARD') AND NOT regexp_matches(upper(label_text), 'EXIST|DEMO|REMOVE|FUTURE|ABANDON|NOT IN SCOPE')
  AND read_id NOT IN (SELECT page_id FROM tokens WHERE regexp_matches(upper(text), '\(\s*E\s*\)|\bEXIST(ING|G)?\b|\bEXSTG\b|\bDEMO\b|\bDEMOLISH(ED|ING)?\b|\bREMOVED?\b|\bTO\s+BE\s+REMOVED\b'))""")
def p10(tokens, stamps):
    names = stamps.select(F.col("read_id").alias("page_id"), F.col("label_text").alias("name"))
    return pg.panel_status_filter(tokens, names)


@query("p11_corner_tokens", "tokens page_sizes", """SELECT t.* FROM tokens t JOIN page_sizes s ON s.page_id = t.page_id
  WHERE (t.x1 + t.x2) / 2 BETWEEN 0.88::DOUBLE * width AND width AND (t.y1 + t.y2) / 2 BETWEEN 0.74::DOUBLE * height AND 0.98::DOUBLE * height""")
def p11(tokens, page_sizes):
    return pg.corner_tokens(tokens, page_sizes)


@query("s8_page_audit_log", "tokens page_sizes pdf_pages footprints", "WITH " + in_corner(SELECTED) + ", " + FALLBACK + """,
  has_e AS (SELECT pdf_id, bool_or(decision = 'E') AS he FROM decisions GROUP BY pdf_id)
  SELECT d.pdf_id, d.page_id, CASE WHEN s.reason IS NOT NULL OR (NOT he AND f.footprints IS NOT NULL) THEN 'KEEP' ELSE 'DROP' END AS decision,
    CASE WHEN s.reason IS NOT NULL THEN s.reason WHEN he THEN 'not selected after label prioritisation' WHEN d.decision = 'nonE' THEN 'confident other discipline'
      WHEN f.footprints IS NOT NULL THEN 'footprints' ELSE 'no qualifying footprints' END AS why,
    CASE WHEN d.decision = 'E' THEN score END AS label_score, CASE WHEN d.decision = 'E' THEN array_to_string(tags, ',') END AS label_tags
  FROM decisions d JOIN has_e h ON h.pdf_id = d.pdf_id LEFT JOIN selected s ON s.page_id = d.page_id
  LEFT JOIN fallback f ON f.page_id = d.page_id LEFT JOIN scores c ON c.page_id = d.page_id""")
def s8(tokens, page_sizes, pdf_pages, footprints):
    decisions = _corner_decisions(tokens, page_sizes, pdf_pages)
    scores = pg.score_page_labels(pg.corner_tokens(tokens, page_sizes))
    selected = pg.select_pages(scores.join(decisions.filter("decision = 'E'"), "page_id"))
    return pg.page_audit_log(decisions, scores, selected, pg.select_pages_fallback(decisions, footprints))
