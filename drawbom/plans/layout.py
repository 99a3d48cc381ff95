"""Queries over lines, columns and header roles."""

from pyspark.sql import functions as F

from drawbom.functions.similarity import best_vocab_match, similarity
from drawbom.operators import layout as ly
from drawbom.plans.registry import query
from drawbom.plans.text_reads import _NORM_TEXT
from drawbom.sources.derived import PAGE_WORDS

HEADER_VOCAB = ["TRIP", "POLES", "AMPS", "DESCRIPTION", "CKT", "PANEL", "SCHEDULE", "NOTES"]


def lined(tokens):
    return tokens.withColumn("line_no", F.floor(F.col("pos") / 12).cast("long"))


# strips of a page that cannot share a line, then the walk token by token
L1_SQL = """WITH RECURSIVE e AS (SELECT page_id, pos, x1, y1, y2, y1 + y2 AS c, max(y2) OVER (PARTITION BY page_id ORDER BY y1 + y2, x1, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
    min((y1 + y2) / 2 - 0.6 * (y2 - y1)) OVER (PARTITION BY page_id ORDER BY y1 + y2, x1, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf FROM tokens),
  g AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe < nf THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY c, x1, pos) AS strip FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY page_id, strip ORDER BY c, x1, pos) AS i FROM g),
  walk(page_id, strip, i, pos, k, lines) AS (SELECT page_id, strip, i, pos, 1, [struct_pack(a := y1, b := y2)] FROM o WHERE i = 1
    UNION ALL SELECT page_id, strip, i, pos, CASE WHEN hit IS NULL THEN len(lines) + 1 ELSE hit END, CASE WHEN hit IS NULL THEN list_append(lines, struct_pack(a := y1, b := y2))
        ELSE list_transform(lines, lambda l, n: CASE WHEN n = hit THEN struct_pack(a := least(l.a, y1), b := greatest(l.b, y2)) ELSE l END) END
      FROM (SELECT w.page_id, w.strip, o.i, o.pos, o.y1, o.y2, w.lines, CAST(list_position(list_transform(w.lines, lambda l: abs(o.c - (l.a + l.b)) <= 1.2 * greatest(1, least(l.b - l.a, o.y2 - o.y1))), TRUE) AS INT) AS hit
        FROM walk w JOIN o ON o.page_id = w.page_id AND o.strip = w.strip AND o.i = w.i + 1) z),
  fin AS (SELECT page_id, strip, arg_max(lines, i) AS lines FROM walk GROUP BY page_id, strip), ln AS (SELECT page_id, strip, unnest(list_transform(lines, lambda l: l.a)) AS top, unnest(range(1, len(lines) + 1)) AS k FROM fin),
  num AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY top, strip, k) AS line_no FROM ln)
  SELECT w.page_id, w.pos, n.line_no FROM walk w JOIN num n ON n.page_id = w.page_id AND n.strip = w.strip AND n.k = w.k"""


@query("l1_assign_lines", "tokens", L1_SQL)
def l1(tokens):
    return ly.assign_lines(tokens)


@query("l2_first_lines", "tokens", """SELECT page_id, pos, line_no FROM (SELECT page_id, pos, pos // 12 AS line_no, dense_rank() OVER (PARTITION BY page_id ORDER BY pos // 12) AS d FROM tokens) t WHERE d <= 15""")
def l2(tokens):
    return ly.first_lines(lined(tokens)).select("page_id", "pos", F.col("line_no").cast("int").alias("line_no"))


def crowded(tokens):
    """Second reading of every token, slightly shifted, as two recognition
    passes give it."""
    shift = F.col("pos") % 3
    again = F.struct((F.col("pos") + 100000).alias("pos"), F.round(F.lit(1.0) - F.col("conf") / 2, 4).alias("conf"), (F.col("x1") + shift).alias("x1"), (F.col("x2") + shift).alias("x2"))
    both = tokens.select("page_id", "text", "y1", "y2", F.inline(F.array(F.struct("pos", "conf", "x1", "x2"), again)))
    return both.select("page_id", "pos", "text", "conf", "x1", "y1", "x2", "y2")


CROWDED = """c AS (SELECT page_id, pos, text, conf, x1, y1, x2, y2 FROM tokens
    UNION ALL SELECT page_id, pos + 100000, text, round(1.0 - conf / 2, 4), x1 + pos % 3, y1, x2 + pos % 3, y2 FROM tokens)"""
_W, _H = "(least(k.x2, o.x2) - greatest(k.x1, o.x1))", "(least(k.y2, o.y2) - greatest(k.y1, o.y1))"
_N = f"(CASE WHEN {_W} > 0 AND {_H} > 0 THEN {_W} * {_H} ELSE 0 END)"
_U = f"((k.x2 - k.x1) * (k.y2 - k.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - {_N})"
_IOU = f"CASE WHEN {_U} > 0 THEN {_N} / {_U} ELSE 0 END"
# one reading of equal boxes, stretches of a text that cannot overlap, then the walk that keeps what overlaps nothing kept
L3_SQL = "WITH RECURSIVE " + CROWDED + f""", b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, norm, x1, y1, x2, y2 ORDER BY conf DESC, pos) AS best FROM (SELECT *, {_NORM_TEXT.format(c='text')} AS norm FROM c)) WHERE best = 1),
  e AS (SELECT *, max(y2) OVER (PARTITION BY page_id, norm ORDER BY y1, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
  g AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe < y1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, norm ORDER BY y1, pos) AS strip FROM e),
  o AS (SELECT page_id, norm, strip, pos, x1, y1, x2, y2, row_number() OVER (PARTITION BY page_id, norm, strip ORDER BY conf DESC, (x2 - x1) * (y2 - y1) DESC, pos) AS i FROM g),
  walk(page_id, norm, strip, i, kept) AS (SELECT page_id, norm, strip, i, [struct_pack(pos, x1, y1, x2, y2)] FROM o WHERE i = 1
    UNION ALL SELECT o.page_id, o.norm, o.strip, o.i, CASE WHEN len(list_filter(w.kept, lambda k: {_IOU} >= 0.8)) > 0 THEN w.kept ELSE list_append(w.kept, struct_pack(o.pos, o.x1, o.y1, o.x2, o.y2)) END
      FROM walk w JOIN o ON o.page_id = w.page_id AND o.norm = w.norm AND o.strip = w.strip AND o.i = w.i + 1),
  kept AS (SELECT page_id, unnest(list_transform(arg_max(kept, i), lambda k: k.pos)) AS pos FROM walk GROUP BY page_id, norm, strip)
  SELECT c.page_id, c.pos, text, conf FROM c JOIN kept k ON k.page_id = c.page_id AND k.pos = c.pos"""


@query("l3_dedup_tokens", "tokens", L3_SQL)
def l3(tokens):
    return ly.dedup_tokens(crowded(tokens)).select("page_id", "pos", "text", "conf")


# runs of one text, then the walk that holds the last kept reading of a run
L4_SQL = "WITH RECURSIVE " + CROWDED + """, e AS (SELECT *, lag(text) OVER (PARTITION BY page_id ORDER BY y1, x1, pos) AS pt FROM c),
  g AS (SELECT *, sum(CASE WHEN pt IS NULL OR pt <> text THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y1, x1, pos) AS run FROM e),
  o AS (SELECT page_id, run, pos, conf, x1 + x2 AS xc, row_number() OVER (PARTITION BY page_id, run ORDER BY y1, x1, pos) AS i FROM g),
  walk(page_id, run, i, pos, xc, conf, k) AS (SELECT page_id, run, i, pos, xc, conf, 1 FROM o WHERE i = 1
    UNION ALL SELECT page_id, run, i, CASE WHEN new THEN p ELSE pos END, CASE WHEN new THEN x ELSE xc END, CASE WHEN new THEN f ELSE conf END, CASE WHEN far THEN k + 1 ELSE k END
      FROM (SELECT o.page_id, o.run, o.i, w.pos, w.xc, w.conf, w.k, o.pos AS p, o.xc AS x, o.conf AS f, abs(o.xc - w.xc) >= 36 AS far, abs(o.xc - w.xc) >= 36 OR o.conf > w.conf AS new
        FROM walk w JOIN o ON o.page_id = w.page_id AND o.run = w.run AND o.i = w.i + 1) z),
  kept AS (SELECT page_id, arg_max(pos, i) AS pos FROM walk GROUP BY page_id, run, k)
  SELECT c.page_id, c.pos, text, conf FROM c JOIN kept k ON k.page_id = c.page_id AND k.pos = c.pos"""


@query("l4_dedup_adjacent", "tokens", L4_SQL)
def l4(tokens):
    return ly.dedup_adjacent(crowded(tokens), ["page_id"]).select("page_id", "pos", "text", "conf")


L5_SQL = """WITH RECURSIVE t AS (SELECT page_id, pos, pos // 12 // 2 AS band, x1, x2 FROM tokens), o AS (SELECT *, row_number() OVER (PARTITION BY page_id, band ORDER BY c, x1, x2) AS i FROM (SELECT DISTINCT page_id, band, x1 + x2 AS c, x1, x2 FROM t)),
  walk(page_id, band, i, x1, x2, seed, seeds) AS (SELECT page_id, band, i, x1, x2, c, [c] FROM o WHERE i = 1
    UNION ALL SELECT page_id, band, i, x1, x2, coalesce(hit, c), CASE WHEN hit IS NULL THEN list_append(seeds, c) ELSE seeds END
      FROM (SELECT o.*, w.seeds, list_filter(w.seeds, lambda s: s BETWEEN 2 * (o.x1 - 3) AND 2 * (o.x2 + 3))[1] AS hit FROM walk w JOIN o ON o.page_id = w.page_id AND o.band = w.band AND o.i = w.i + 1) z),
  col AS (SELECT *, dense_rank() OVER (PARTITION BY page_id, band ORDER BY seed) AS n FROM walk)
  SELECT t.page_id, t.pos, CAST(t.band AS BIGINT) AS band, CAST(n AS BIGINT) AS "column" FROM t JOIN col k ON k.page_id = t.page_id AND k.band = t.band AND k.x1 = t.x1 AND k.x2 = t.x2"""


@query("l5_plumbline_columns", "tokens", L5_SQL)
def l5(tokens):
    band = lined(tokens).select("page_id", "pos", "x1", "x2", F.floor(F.col("line_no") / 2).alias("band"))
    return ly.plumbline_columns(band, ["page_id", "band"]).select("page_id", "pos", "band", "column")


COLS = """ed AS (SELECT page_id, x FROM vlines UNION SELECT page_id, 0 FROM page_refs UNION SELECT page_id, width - 1 FROM page_refs), nx AS (SELECT *, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS n FROM ed),
  ab AS (SELECT page_id, greatest(0, x + 2) AS a, least(999, n - 2) AS b, greatest(0, least(998, (x + n) // 2)) AS m FROM nx WHERE n IS NOT NULL),
  cols AS (SELECT page_id, CASE WHEN b <= a THEN greatest(0, m - 1) ELSE a END AS a, CASE WHEN b <= a THEN least(999, m + 1) ELSE b END AS b FROM ab)"""
# bands in order with their index; the first that holds x, else the nearest
BAND_AT = "row_number() OVER (PARTITION BY {k} ORDER BY CASE WHEN {x} BETWEEN a AND b THEN 0 ELSE 1 END, CASE WHEN {x} BETWEEN a AND b THEN 0 ELSE abs((a + b) / 2 - {x}) END, i)"


@query("l6_assign_band", "tokens vlines page_refs", "WITH " + COLS + f""", ci AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY a, b) AS i FROM (SELECT DISTINCT * FROM cols) q),
  r AS (SELECT t.page_id, pos, i, {BAND_AT.format(k='t.page_id, pos', x='((x1 + x2) / 2)')} AS n FROM tokens t JOIN ci ON ci.page_id = t.page_id) SELECT page_id, pos, CAST(i AS INT) AS band FROM r WHERE n = 1""")
def l6(tokens, vlines, page_refs):
    return ly.assign_band(tokens, ly.column_bands(vlines, page_refs)).select("page_id", "pos", "band")


@query("l7_split_wide_gaps", "tokens", """WITH t AS (SELECT page_id, pos, pos // 12 AS line_no, x1, x2, greatest(1, x2 - x1) AS w FROM tokens), m AS (SELECT page_id, line_no, list_sort(list(w))[count(*) // 2 + 1] AS med FROM t GROUP BY page_id, line_no),
  g AS (SELECT t.*, x1 - lag(x2) OVER (PARTITION BY t.page_id, t.line_no ORDER BY x1, pos) AS gap, med FROM t JOIN m ON m.page_id = t.page_id AND m.line_no = t.line_no)
  SELECT page_id, pos, CAST(sum(CASE WHEN gap IS NULL OR gap > greatest(32, CAST(round_even(2.6 * med, 0) AS BIGINT)) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, line_no ORDER BY x1, pos) AS BIGINT) AS segment FROM g""")
def l7(tokens):
    return ly.split_wide_gaps(lined(tokens).select("page_id", "line_no", "pos", "x1", "x2"), ["page_id", "line_no"]).select("page_id", "pos", "segment")


# stretches that share no row, then the walk that grows or closes the open label
L8_SQL = """WITH RECURSIVE e AS (SELECT *, max(y2 - 0.5) OVER (PARTITION BY page_id ORDER BY y1, x1, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM tokens),
  g AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe < y1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y1, x1, pos) AS strip FROM e),
  o AS (SELECT page_id, strip, x1, y1, x2, y2, text, conf, row_number() OVER (PARTITION BY page_id, strip ORDER BY y1, x1, pos) AS i FROM g),
  walk(page_id, strip, i, k, x1, y1, x2, y2, fy1, fy2, text, conf, words) AS (SELECT page_id, strip, i, 1, x1, y1, x2, y2, y1, y2, text, conf, 1 FROM o WHERE i = 1
    UNION ALL SELECT page_id, strip, i, CASE WHEN joins THEN k ELSE k + 1 END, CASE WHEN joins THEN x1 ELSE a1 END,
        CASE WHEN NOT joins THEN b1 WHEN least(y2, b2) <= greatest(y1, b1) THEN least(fy1, b1) ELSE greatest(y1, b1) END, CASE WHEN joins THEN greatest(x2, a2) ELSE a2 END,
        CASE WHEN NOT joins THEN b2 WHEN least(y2, b2) <= greatest(y1, b1) THEN greatest(fy2, b2) ELSE least(y2, b2) END, CASE WHEN joins THEN fy1 ELSE b1 END, CASE WHEN joins THEN fy2 ELSE b2 END,
        CASE WHEN joins THEN concat_ws(' ', text, t) ELSE t END, CASE WHEN joins THEN greatest(conf, f) ELSE f END, CASE WHEN joins THEN words + 1 ELSE 1 END
      FROM (SELECT w.page_id, w.strip, o.i, w.k, w.x1, w.y1, w.x2, w.y2, w.fy1, w.fy2, w.text, w.conf, w.words, o.x1 AS a1, o.y1 AS b1, o.x2 AS a2, o.y2 AS b2, o.text AS t, o.conf AS f,
          o.x1 - w.x2 <= 36 AND greatest(0, least(w.y2, o.y2) - greatest(w.y1, o.y1)) / greatest(1, least(w.y2 - w.y1, o.y2 - o.y1)) >= 0.35::DOUBLE AS joins
        FROM walk w JOIN o ON o.page_id = w.page_id AND o.strip = w.strip AND o.i = w.i + 1) z)
  SELECT page_id, x1, y1, x2, y2, text, conf, words FROM (SELECT *, row_number() OVER (PARTITION BY page_id, strip, k ORDER BY i DESC) AS n FROM walk) q WHERE n = 1"""


@query("l8_cluster_by_row", "tokens", L8_SQL)
def l8(tokens):
    return ly.cluster_by_row(tokens)


L9_SQL = """WITH RECURSIVE h AS (SELECT page_id, (y1 + y2) / 2 AS y, count(*) AS n FROM tokens GROUP BY ALL), m AS (SELECT page_id, min(y) AS lo, max(y) AS hi FROM h GROUP BY page_id),
  walk(page_id, r, c1, c2, still) AS (SELECT page_id, 0, lo + 0.25::DOUBLE * (hi - lo), lo + 0.75::DOUBLE * (hi - lo), FALSE FROM m WHERE hi > lo
    UNION ALL SELECT page_id, r + 1, m1, m2, abs(m1 - c1) < 0.5 AND abs(m2 - c2) < 0.5
      FROM (SELECT w.page_id, r, c1, c2, sum(y * n) FILTER (abs(y - c1) <= abs(y - c2)) / sum(n) FILTER (abs(y - c1) <= abs(y - c2)) AS m1, sum(y * n) FILTER (abs(y - c1) > abs(y - c2)) / sum(n) FILTER (abs(y - c1) > abs(y - c2)) AS m2
        FROM walk w JOIN h ON h.page_id = w.page_id WHERE NOT still AND r < 12 GROUP BY w.page_id, r, c1, c2) z WHERE m1 IS NOT NULL AND m2 IS NOT NULL),
  fin AS (SELECT page_id, arg_max(c1, r) AS c1, arg_max(c2, r) AS c2 FROM walk GROUP BY page_id)
  SELECT m.page_id, round(coalesce(0.5::DOUBLE * (c1 + c2), lo + 1), 6) AS threshold, round(coalesce(least(c1, c2), lo), 6) AS top_mean FROM m LEFT JOIN fin f ON f.page_id = m.page_id"""


@query("l9_split_header_rows", "tokens", L9_SQL)
def l9(tokens):
    out = ly.split_header_rows(tokens)
    return out.withColumns({"threshold": F.round("threshold", 6), "top_mean": F.round("top_mean", 6)})


HW = r"regexp_matches(regexp_replace(replace(replace(upper(text), '1', 'I'), '0', 'O'), '[^A-Z0-9]', '', 'g'), 'CKT|CCT|TRIP|POLES|AMP|BREAKER|BKR|SIZE|DESCRIPTION|DESIGNATION|NAME')"


@query("l10_header_y_by_band", "tokens page_sizes", f"""WITH b AS (SELECT page_id, ((y1 + y2) // 2) // 16 AS bin, count(*) FILTER ({HW}) AS score, min(pos) AS seen, min(y1) AS top FROM tokens GROUP BY ALL),
  k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seen) AS n FROM b WHERE score > 0) SELECT k.page_id, top AS header_y FROM k JOIN page_sizes s ON s.page_id = k.page_id WHERE n = 1 AND top <= floor(0.65 * height)""")
def l10(tokens, page_sizes):
    return ly.header_y_by_band(tokens, page_sizes)


@query("l11_header_y_by_categories", "tokens page_sizes ruled_lines", """WITH t AS (SELECT t.page_id, y1 // 14 * 14 AS bin, (x1 + x2) / 2 < width * 0.5 AS lft, regexp_replace(replace(replace(upper(text), '1', 'I'), '0', 'O'), '[^A-Z0-9]', '', 'g') AS n
    FROM tokens t JOIN page_sizes s ON s.page_id = t.page_id WHERE y1 BETWEEN floor(0.08 * height) AND floor(0.65 * height)),
  c AS (SELECT *, regexp_matches(n, 'CKT|CCT') AS k, regexp_matches(n, 'DESCRIPTION|DESIGNATION|NAME') AS d, regexp_matches(n, 'TRIP|AMP|BREAKER|BKR|SIZE') AS tr, n = 'P' OR n LIKE '%POLE%' AS p FROM t),
  b AS (SELECT page_id, bin, bool_or(k)::INT + bool_or(d)::INT + bool_or(tr)::INT + bool_or(p)::INT AS cats, bool_or((k OR d OR tr OR p) AND lft) AND bool_or((k OR d OR tr OR p) AND NOT lft) AS two_sided, bool_or(n LIKE '%CLASSIFICATION%') AS bad FROM c GROUP BY page_id, bin),
  s AS (SELECT page_id, bin, cats + two_sided::INT + (cats >= 2)::INT AS score FROM b WHERE NOT bad),
  h AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, bin) AS r FROM s WHERE score >= 3 AND EXISTS (SELECT 1 FROM ruled_lines l WHERE l.page_id = s.page_id AND y_center >= bin - 6 AND y_center < bin + 28))
  SELECT page_id, bin AS header_y, CAST(score AS INT) AS score FROM h WHERE r = 1""")
def l11(tokens, page_sizes, ruled_lines):
    return ly.header_y_by_categories(tokens, page_sizes, ruled_lines)


@query("l12_split_glued", "tokens", r"""WITH p AS (SELECT page_id, pos, x1, x2, CASE WHEN len(regexp_split_to_array(text, '[ \t_/:-]+')) > 1 THEN regexp_split_to_array(text, '[ \t_/:-]+')
      WHEN len(regexp_extract_all(text, '[A-Za-z]+|\([A-Za-z]+\)|[0-9]+|[^\sA-Za-z0-9]+')) > 1 THEN regexp_extract_all(text, '[A-Za-z]+|\([A-Za-z]+\)|[0-9]+|[^\sA-Za-z0-9]+') ELSE [text] END AS ps FROM tokens),
  u AS (SELECT page_id, pos, x1, x2, len(ps) AS n, unnest(ps) AS word, CAST(unnest(range(0, len(ps))) AS INT) AS part, greatest(1, greatest(1, x2 - x1 + 1) // len(ps)) AS st FROM p)
  SELECT page_id, pos, part, word, x1 + part * st AS x1, CASE WHEN part = n - 1 THEN x2 ELSE x1 + part * st + st - 1 END AS x2 FROM u""")
def l12(tokens):
    return ly.split_glued(tokens)


@query("l13_explode_multi_role", "header_cands", r"""SELECT page_id, ord, unnest(CASE WHEN regexp_matches(text, '(?i)\b(TRIP|AMP|AMPS|BREAKER|BKR|SIZE|\(A\))\b') AND regexp_matches(text, '(?i)\b(POLES?|P|\(P\))\b') THEN ['TRIP', 'POLES'] ELSE [text] END) AS text FROM header_cands""")
def l13(header_cands):
    return ly.explode_multi_role(header_cands).select("page_id", "ord", "text")


@query("l14_best_vocab_match", "tokens")
def l14(tokens):
    best = best_vocab_match(F.col("text"), HEADER_VOCAB)
    return tokens.withColumn("_b", best).select("page_id", "pos", F.col("_b.word").alias("word"), F.round("_b.score", 6).alias("score"),
                                                F.round(similarity(F.col("text"), F.lit("SCHEDULE")), 6).alias("like_schedule"))


def columns_of(header_cands):
    return header_cands.withColumnRenamed("ord", "column")


@query("l15_score_header_columns", "header_cands")
def l15(header_cands):
    return ly.score_header_columns(columns_of(header_cands))


def col_scores(header_cands):
    x = F.col("x1")
    return header_cands.select(
        "page_id", F.col("ord").alias("column"), F.col("x1").alias("x_left"), F.col("x2").alias("x_right"), (x % 17 == 0).alias("has_notes"),
        F.when(x % 5 == 0, 3).otherwise(0).alias("ckt"), F.when(x % 7 == 0, 6).otherwise(0).alias("description"), (x % 6).cast("int").alias("trip_rank"),
        F.get(F.array(F.lit(0), F.lit(1), F.lit(4)), (x % 3).cast("int")).alias("poles_rank"))


ROLES = """b AS (SELECT page_id, ord AS col, x1, x2, x1 % 17 = 0 AS notes, CASE WHEN x1 % 17 = 0 THEN NULL WHEN x1 % 7 = 0 THEN 'description' WHEN x1 % 5 = 0 THEN 'ckt' END AS role0, x1 % 17 <> 0 AND x1 % 5 <> 0 AND x1 % 7 <> 0 AS hero,
    x1 % 6 AS tr, [0, 1, 4][CAST(x1 % 3 AS INT) + 1] AS pr FROM header_cands),
  m AS (SELECT page_id, (min(x1) + max(x2)) / 2 AS mid FROM b WHERE hero GROUP BY page_id), s AS (SELECT b.*, CASE WHEN (x1 + x2) / 2 < mid THEN 'left' ELSE 'right' END AS side FROM b LEFT JOIN m ON m.page_id = b.page_id),
  h AS (SELECT page_id, side, arg_max(col, tr * 100000 - col) FILTER (hero AND tr > 0) AS tc, arg_max(col, pr * 100000 - col) FILTER (hero AND pr > 0) AS pc FROM s GROUP BY page_id, side),
  l AS (SELECT page_id, CASE WHEN bool_or(tc = pc) THEN 'combined' WHEN count(tc) > 0 AND count(pc) > 0 THEN 'separated' ELSE 'unknown' END AS layout FROM h GROUP BY page_id)"""


@query("l16_assign_column_roles", "header_cands", "WITH " + ROLES + """ SELECT s.page_id, s.col AS column, coalesce(role0, CASE WHEN hero THEN CASE WHEN layout = 'combined' THEN CASE WHEN s.col = tc AND s.col = pc THEN 'combo' END WHEN s.col = tc THEN 'trip' WHEN s.col = pc THEN 'poles' END END) AS role, layout
  FROM s LEFT JOIN h ON h.page_id = s.page_id AND h.side = s.side LEFT JOIN l ON l.page_id = s.page_id""")
def l16(header_cands):
    return ly.assign_column_roles(col_scores(header_cands))


@query("l16_roles_of_scored_columns", "header_cands")
def l16_scored(header_cands):
    return ly.assign_column_roles(ly.score_header_columns(columns_of(header_cands)))


@query("l17_classify_bands", "header_cands")
def l17(header_cands):
    return ly.classify_bands(header_cands.drop("role", "sim", "conf"))


PICKED = """sc AS (SELECT *, round(0.9 * sim + 0.1 * conf, 9) AS score, CAST(round_even((x1 + x2) / 2 / 28, 0) AS INT) AS bucket FROM header_cands WHERE sim >= 0.6), b1 AS (SELECT *, row_number() OVER (PARTITION BY page_id, role, bucket ORDER BY score DESC, ord) AS n FROM sc),
  b2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, role ORDER BY score DESC, ord) AS m FROM b1 WHERE n = 1), picks AS (SELECT page_id, role, ord, text, x1, x2, score FROM b2 WHERE m <= 2)"""


@query("l18_pick_headers", "header_cands", "WITH " + PICKED + " SELECT page_id, role, ord, score FROM picks")
def l18(header_cands):
    return ly.pick_headers(header_cands).select("page_id", "role", "ord", "score")


def wide_pages(header_cands):
    return header_cands.select("page_id").distinct().select("page_id", F.lit(1000).cast("long").alias("width"), F.lit(900).cast("long").alias("height"))


COMBINED = r"""tp AS (SELECT *, (x1 + x2) / 2 AS x, CASE WHEN (x1 + x2) / 2 < 500 THEN 'L' ELSE 'R' END AS side FROM picks WHERE role IN ('trip', 'poles')),
  cs AS (SELECT a.page_id, a.side, bool_or(regexp_matches(upper(a.text), 'TRIP|AMP|\(A\)') AND regexp_matches(upper(a.text), 'POLE| P | P\)')) OR coalesce(bool_or(abs(a.x - b.x) <= 14), FALSE) AS combined
    FROM tp a LEFT JOIN tp b ON b.page_id = a.page_id AND b.side = a.side AND b.role <> a.role GROUP BY a.page_id, a.side)"""


@query("l19_is_combined_side", "header_cands", "WITH " + PICKED + ", " + COMBINED + " SELECT * FROM cs")
def l19(header_cands):
    return ly.is_combined_side(ly.pick_headers(header_cands), wide_pages(header_cands))


@query("l20_column_bands", "vlines page_refs", "WITH " + COLS + " SELECT * FROM cols")
def l20(vlines, page_refs):
    return ly.column_bands(vlines, page_refs)


@query("l21_ckt_column_spans", "tokens vlines", """SELECT * FROM (SELECT t.page_id, pos, max(x) FILTER (x <= x1) AS x_left, min(x) FILTER (x >= x2) AS x_right FROM tokens t JOIN vlines v ON v.page_id = t.page_id
  WHERE regexp_replace(replace(upper(text), '1', 'I'), '[^A-Z]', '', 'g') IN ('CCT', 'CKT') GROUP BY t.page_id, pos, x1, x2) s WHERE x_right > x_left""")
def l21(tokens, vlines):
    return ly.ckt_column_spans(tokens, vlines)


@query("l22_footer_token", "tokens page_refs", """WITH n AS (SELECT page_id, y2, TRY_CAST(nullif(regexp_extract(CASE WHEN pos % 5 = 0 THEN 'No ' || (17 + pos % 70) ELSE text END, '([0-9]+)', 1), '') AS INT) AS v FROM tokens),
  b AS (SELECT page_id, v, y2, row_number() OVER (PARTITION BY page_id ORDER BY v DESC, y2 DESC) AS k FROM n WHERE v IN (17, 18, 29, 30, 41, 42, 53, 54, 65, 66, 71, 72, 83, 84))
  SELECT r.page_id, b.v AS token_value, coalesce(b.y2, footer_y) AS footer_y, b.v IS NOT NULL AS by_token FROM page_refs r LEFT JOIN b ON b.page_id = r.page_id AND k = 1""")
def l22(tokens, page_refs):
    numbers = tokens.withColumn("text", F.when(F.col("pos") % 5 == 0, F.concat(F.lit("No "), (17 + F.col("pos") % 70).cast("string"))).otherwise(F.col("text")))
    return ly.footer_token(numbers, page_refs)


_WIN = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(ly.CKT_WINDOWS))


@query("l23_header_y_by_ckt", "tokens ruled_lines page_sizes", f"""WITH w(win, a, b, c) AS (VALUES {_WIN}), t AS (SELECT t.*, width, height, regexp_replace(replace(upper(text), '1', 'I'), '[^A-Z]', '', 'g') AS n FROM tokens t JOIN page_sizes s ON s.page_id = t.page_id),
  s AS (SELECT t.*, win FROM t JOIN w ON y1 >= floor(height * a) AND y2 <= floor(height * b) AND x2 <= floor(width * c)),
  ln AS (SELECT page_id, win, ((y1 + y2) // 2) // 14 AS bin, min(y1) AS y, bool_or(n LIKE '%CCT%' OR n LIKE '%CKT%') AS has, bool_or(upper(text) LIKE '%HEADER%') AS bad FROM s GROUP BY ALL),
  cand AS (SELECT page_id, y1 AS y FROM s WHERE n IN ('CCT', 'CKT') UNION SELECT page_id, y FROM ln WHERE has AND NOT bad),
  ok AS (SELECT c.* FROM cand c WHERE EXISTS (SELECT 1 FROM ruled_lines l WHERE l.page_id = c.page_id AND y_center >= y - 6 AND y_center < y + 28)
    UNION ALL SELECT page_id, y1 FROM t WHERE n IN ('CCT', 'CKT') AND x2 <= floor(0.48 * width) AND y1 >= floor(0.08 * height) AND y2 <= floor(0.68 * height))
  SELECT ok.page_id, min(y) AS header_y FROM ok JOIN page_sizes s ON s.page_id = ok.page_id WHERE y <= floor(0.65 * height) GROUP BY ok.page_id""")
def l23(tokens, ruled_lines, page_sizes):
    return ly.header_y_by_ckt(tokens, ruled_lines, page_sizes)


_FR = ly.FALLBACK_FRACTIONS
MAPPED = PICKED + ", " + COMBINED + ", " + COLS + f""", ci AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY a, b) AS i, count(*) OVER (PARTITION BY page_id) AS nb FROM (SELECT DISTINCT * FROM cols) q),
  hd AS (SELECT *, row_number() OVER (PARTITION BY page_id, side, role ORDER BY x, ord) AS f FROM tp), h1 AS (SELECT page_id, side, role, x, x1, x2 FROM hd WHERE f = 1),
  hb AS (SELECT h1.*, i, a, b, nb, {BAND_AT.format(k='h1.page_id, side, role', x='x')} AS n FROM h1 JOIN ci ON ci.page_id = h1.page_id),
  nb AS (SELECT page_id, side, role, CASE WHEN abs((a + b) / 2 - x) <= 100 THEN i END AS i FROM hb WHERE n = 1),
  sd AS (SELECT r.page_id, r.width, s.side, coalesce(c.combined, FALSE) AS combined, t.x AS tx, t.x1 AS t1, t.x2 AS t2, p.x AS px, p.x1 AS p1, p.x2 AS p2, ti.i AS ti, pi.i AS pi, CASE s.side WHEN 'L' THEN -1 ELSE 1 END AS st
    FROM page_refs r CROSS JOIN (VALUES ('L'), ('R')) s(side) LEFT JOIN cs c ON c.page_id = r.page_id AND c.side = s.side LEFT JOIN h1 t ON t.page_id = r.page_id AND t.side = s.side AND t.role = 'trip' LEFT JOIN h1 p ON p.page_id = r.page_id AND p.side = s.side AND p.role = 'poles'
    LEFT JOIN nb ti ON ti.page_id = r.page_id AND ti.side = s.side AND ti.role = 'trip' LEFT JOIN nb pi ON pi.page_id = r.page_id AND pi.side = s.side AND pi.role = 'poles'),
  mx AS (SELECT sd.*, tb.a AS ta, tb.b AS tbb, tb.i AS tj, pb.a AS pa, pb.b AS pbb, pb.i AS pj FROM sd LEFT JOIN ci tb ON tb.page_id = sd.page_id AND tb.i = coalesce(ti, pi + st) LEFT JOIN ci pb ON pb.page_id = sd.page_id AND pb.i = coalesce(pi, ti - st)),
  my AS (SELECT *, side = 'L' AND coalesce(tj = pj, FALSE) AS shared, CAST(floor((tx + px) / 2) AS BIGINT) AS cut, greatest(0, coalesce(t1, p1) - 8) AS ha, least(width, coalesce(t2, p2) + 8) AS hb FROM mx)
  SELECT page_id, side, 'combo' AS role, CASE WHEN hb - ha < 24 THEN greatest(0, (ha + hb) // 2 - 12) ELSE ha END AS a, CASE WHEN hb - ha < 24 THEN least(width, (ha + hb) // 2 + 12) ELSE hb END AS b FROM my WHERE combined
  UNION ALL SELECT page_id, side, 'trip', coalesce(CASE WHEN shared AND tx > px THEN cut ELSE ta END, CASE side WHEN 'L' THEN floor(width * {_FR['L_TRIP'][0]}) ELSE floor(width * {_FR['R_TRIP'][0]}) END)::BIGINT, coalesce(CASE WHEN shared AND tx <= px THEN cut ELSE tbb END, CASE side WHEN 'L' THEN floor(width * {_FR['L_TRIP'][1]}) ELSE floor(width * {_FR['R_TRIP'][1]}) END)::BIGINT FROM my WHERE NOT combined
  UNION ALL SELECT page_id, side, 'poles', coalesce(CASE WHEN shared AND tx <= px THEN cut ELSE pa END, CASE side WHEN 'L' THEN floor(width * {_FR['L_POLES'][0]}) ELSE floor(width * {_FR['R_POLES'][0]}) END)::BIGINT, coalesce(CASE WHEN shared AND tx > px THEN cut ELSE pbb END, CASE side WHEN 'L' THEN floor(width * {_FR['L_POLES'][1]}) ELSE floor(width * {_FR['R_POLES'][1]}) END)::BIGINT FROM my WHERE NOT combined"""


@query("l24_map_columns", "header_cands vlines page_refs", "WITH " + MAPPED)
def l24(header_cands, vlines, page_refs):
    return ly.map_columns(ly.pick_headers(header_cands), ly.column_bands(vlines, page_refs), page_refs)


CLASS_ROLES = ["trip", "poles", "combo", "ckt", "unknown"]


@query("l25_backfill_picks", "header_cands", "WITH " + PICKED + """, c AS (SELECT *, ['trip', 'poles', 'combo', 'ckt', 'unknown'][CAST(x1 % 5 AS INT) + 1] AS cr FROM header_cands),
  e AS (SELECT page_id, ord, text, x1, x2, unnest(CASE cr WHEN 'combo' THEN ['trip', 'poles'] WHEN 'unknown' THEN [] ELSE [cr] END) AS role FROM c)
  SELECT page_id, role, ord, text, x1, x2, 'pick' AS origin FROM picks UNION ALL SELECT e.page_id, e.role, e.ord, e.text, e.x1, e.x2, 'class' FROM e WHERE NOT EXISTS (SELECT 1 FROM picks p WHERE p.page_id = e.page_id AND p.role = e.role)""")
def l25(header_cands):
    roles = F.array(*[F.lit(r) for r in CLASS_ROLES])
    classified = header_cands.drop("role").withColumn("class_role", F.get(roles, (F.col("x1") % 5).cast("int")))
    return ly.backfill_picks(ly.pick_headers(header_cands), classified)


@query("l25_backfill_classified", "header_cands")
def l25_classified(header_cands):
    return ly.backfill_picks(ly.pick_headers(header_cands), ly.classify_bands(header_cands.drop("role", "sim", "conf")))
