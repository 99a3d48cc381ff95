"""Queries over the text functions, on whole tables."""

from pyspark.sql import functions as F

from drawbom.functions import electrical as el, text as tx
from drawbom.plans.registry import query

_CHARS = """s AS (SELECT {key}, {src} AS src, replace(replace(replace(replace(replace(upper(trim({src})), '—', '-'), '–', '-'),
  '_', ''), ' ', ''), '.', '') AS s FROM {tbl}),
fixed AS (SELECT {key}, src, s, array_to_string(list_transform(range(1, length(s) + 1), lambda i:
  CASE WHEN NOT ((i > 1 AND regexp_matches(substr(s, CAST(i - 1 AS BIGINT), 1), '[0-9]')) OR regexp_matches(substr(s, CAST(i + 1 AS BIGINT), 1), '[0-9]'))
         THEN substr(s, CAST(i AS BIGINT), 1)
       WHEN substr(s, CAST(i AS BIGINT), 1) = 'O' THEN '0' WHEN substr(s, CAST(i AS BIGINT), 1) IN ('I', 'L', '|') THEN '1'
       WHEN substr(s, CAST(i AS BIGINT), 1) = 'S' THEN '5' WHEN substr(s, CAST(i AS BIGINT), 1) = 'B' THEN '8'
       ELSE substr(s, CAST(i AS BIGINT), 1) END), '') AS fixed FROM s)"""


@query("f1_repair_sheet_token", "stamps",
       "WITH " + _CHARS.format(key="read_id", src="sheet_text", tbl="stamps") + " SELECT read_id, fixed FROM fixed")
def f1(stamps):
    return stamps.select("read_id", tx.repair_sheet_token(F.col("sheet_text")).alias("fixed"))


@query("f2_sheet_class", "stamps",
       "WITH " + _CHARS.format(key="read_id", src="sheet_text", tbl="stamps") + r""",
       c AS (SELECT read_id, CASE WHEN right(fixed, 1) = '-' THEN left(fixed, length(fixed) - 1) ELSE fixed END AS f FROM fixed)
       SELECT read_id, CASE WHEN regexp_matches(f, '^E[A-Z\-]{0,5}.*\d.*\d') THEN 'E'
         WHEN regexp_matches(f, '^(?:P|M|C|A|F|S|X)[A-Z\-]{0,5}.*\d.*\d') THEN 'nonE' ELSE 'none' END AS cls FROM c""")
def f2(stamps):
    return stamps.select("read_id", tx.sheet_class(F.col("sheet_text")).alias("cls"))


@query("f3_clean_text", "documents", r"""SELECT doc_id,
       trim(replace(replace(regexp_replace(text, '[ \t\n\r\f\x0b]+', ' ', 'g'), '—', '-'), '–', '-')) AS cleaned FROM documents""")
def f3(documents):
    return documents.select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query("f4_alnum_tokens", "tokens", r"""SELECT page_id, pos, w AS word, CAST(generate_subscripts AS INT) - 1 AS i FROM
       (SELECT page_id, pos, unnest(ws) AS w, generate_subscripts(ws, 1) AS generate_subscripts
        FROM (SELECT page_id, pos, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM tokens) a) b""")
def f4(tokens):
    return tokens.select("page_id", "pos", F.posexplode(tx.alnum_tokens(F.col("text"))).alias("i", "word"))


@query("f5_fold_confusables", "tokens", r"""SELECT page_id, pos,
       regexp_replace(translate(upper(text), '0Q1LJ!|5$28', 'OOIIIIISSZB'), '[^A-Z0-9]', '', 'g') AS folded FROM tokens""")
def f5(tokens):
    return tokens.select("page_id", "pos", tx.fold_confusables(F.col("text")).alias("folded"))


@query("f6_norm_header_word", "tokens", r"""SELECT page_id, pos,
       regexp_replace(replace(replace(upper(text), '1', 'I'), '0', 'O'), '[^A-Z0-9]', '', 'g') AS word FROM tokens""")
def f6(tokens):
    return tokens.select("page_id", "pos", tx.norm_header_word(F.col("text")).alias("word"))


_TYPOS = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.HEADER_TYPOS.items()) + " ELSE w END"
_NORM_TEXT = (r"regexp_replace(replace(replace(replace(replace(trim(upper({c})), 'AMP.', 'AMP'), 'AMP .', 'AMP'), "
              r"'AMP ', 'AMP'), 'NO.', 'NO'), '\s+', ' ', 'g')")


@query("f7_norm_header_label", "stamps", rf"""WITH t AS (SELECT read_id, label_text, array_to_string(list_transform(
         string_split(trim(regexp_replace(upper(label_text), '\s+', ' ', 'g')), ' '), lambda w: {_TYPOS}), ' ') AS fixed FROM stamps)
       SELECT read_id, {_NORM_TEXT.format(c='label_text')} AS plain, fixed, {_NORM_TEXT.format(c='fixed')} AS label FROM t""")
def f7(stamps):
    c = F.col("label_text")
    return stamps.select("read_id", tx.norm_header_text(c).alias("plain"), tx.fix_header_typos(c).alias("fixed"),
                         tx.norm_header_label(c).alias("label"))


@query("f8_canonical_header_phrase", "stamps", r"""WITH t AS (SELECT read_id, list_transform([w1, w2, w3, w4], lambda w:
         regexp_replace(replace(replace(w, 'AMP .', 'AMP'), 'AMP.', 'AMP'), '[^A-Z0-9_ ]+', '', 'g')) AS ws FROM stamps),
       u AS (SELECT read_id, list_filter(ws, lambda w, i: list_position(ws, w) = i) AS ws FROM t),
       v AS (SELECT read_id, ws, list_filter(['BRKR','AMP','POLES','CKT','NO','DESCRIPTION','NOTES'], lambda k: list_contains(ws, k)) AS known FROM u)
       SELECT read_id, CASE WHEN list_contains(ws, 'DESCRIPTION') THEN 'DESCRIPTION'
         WHEN list_has_all(ws, ['CKT', 'NO']) THEN 'CKT NO' WHEN list_has_all(ws, ['BRKR', 'NOTES']) THEN 'BRKR NOTES'
         WHEN list_has_all(ws, ['BRKR', 'AMP', 'POLES']) THEN 'BRKR AMP, POLES'
         WHEN len(ws) <= 3 OR len(known) = 0 THEN array_to_string(ws, ' ')
         WHEN list_has_all(ws, ['AMP', 'POLES']) THEN 'AMP, POLES' ELSE array_to_string(known, ' ') END AS phrase FROM v""")
def f8(stamps):
    return stamps.select("read_id", tx.canonical_header_phrase(F.array("w1", "w2", "w3", "w4")).alias("phrase"))


@query("f9_is_phase_or_numeric", "tokens", r"""SELECT page_id, pos,
       (regexp_matches(text, '[0-9]') OR trim(text) = '' OR (regexp_matches(upper(text), '[A-Z]')
         AND len(list_filter(regexp_extract_all(upper(text), '[A-Z]+'), lambda w: w NOT IN ('A', 'B', 'C'))) = 0)) AS noise,
       (length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 0.40 * greatest(1, length(text))
         AND NOT regexp_matches(text, '(?i)^[0-9]+(\.[0-9]+)?\s*(A|AMP|AMPS)?$')
         AND NOT (s <> '' AND (regexp_full_match(s, '[ABC]( [ABC])*') OR (length(s) <= 3 AND regexp_matches(s, '[ABC]'))))) AS header_like
       FROM (SELECT *, trim(regexp_replace(regexp_replace(upper(text), '[\[\]():.,/_\-]+', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM tokens) t""")
def f9(tokens):
    c = F.col("text")
    return tokens.select("page_id", "pos", tx.is_phase_or_numeric(c).alias("noise"), tx.header_like(c).alias("header_like"))


@query("f10_is_header_word", "tokens", r"""SELECT page_id, pos, regexp_matches(
       regexp_replace(replace(replace(upper(text), '1', 'I'), '0', 'O'), '[^A-Z0-9]', '', 'g'),
       'CKT|CCT|TRIP|POLES|AMP|BREAKER|BKR|SIZE|DESCRIPTION|DESIGNATION|NAME') AS hit FROM tokens""")
def f10(tokens):
    return tokens.select("page_id", "pos", tx.is_header_word(F.col("text")).alias("hit"))


# two passes, because the pattern consumes the digit that the next match needs
DIGIT_FIX = (r"regexp_replace(regexp_replace(regexp_replace({c}, '([0-9])[Oo]([0-9])', '\1' || '0' || '\2', 'g'), "
             r"'([0-9])[Oo]([0-9])', '\1' || '0' || '\2', 'g'), '([0-9])[Oo](\s*(?:[Aa]|[Aa][Mm][Pp][Ss]?)\b)', '\1' || '0' || '\2', 'g')")


@query("f11_fix_digit_ocr", "stamps", f"SELECT read_id, {DIGIT_FIX.format(c='amp_text')} AS fixed FROM stamps")
def f11(stamps):
    return stamps.select("read_id", tx.fix_digit_ocr(F.col("amp_text")).alias("fixed"))


@query("f12_fix_voltage_text", "stamps", r"""SELECT read_id, regexp_replace(replace(replace(
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(volt_text),
         '([0-9])[IL]([0-9])', '\1/\2', 'g'), '([0-9])[IL]([0-9])', '\1/\2', 'g'),
         '([0-9])O([0-9])', '\1' || '0' || '\2', 'g'), '([0-9])O([0-9])', '\1' || '0' || '\2', 'g'),
       ',', ' '), '.', ' '), '\s+', ' ', 'g') AS fixed FROM stamps""")
def f12(stamps):
    return stamps.select("read_id", tx.fix_voltage_text(F.col("volt_text")).alias("fixed"))


@query("f13_parse_voltage", "stamps", rf"""WITH t AS (SELECT read_id, volt_text, {DIGIT_FIX.format(c='upper(volt_text)')} AS s,
         list_transform(regexp_extract_all(volt_text, '[0-9]+'), lambda x: x) AS runs,
         regexp_extract(volt_text, '(?i)(?:^|[^0-9])(120|208|240|277|480|600)\s*[Y/]\s*(120|208|240|277|480|600)(?:[^0-9]|$)', 1) AS p1,
         regexp_extract(volt_text, '(?i)(?:^|[^0-9])(120|208|240|277|480|600)\s*[Y/]\s*(120|208|240|277|480|600)(?:[^0-9]|$)', 2) AS p2,
         regexp_extract(volt_text, '(?:^|[^0-9])(120|208|240|480|600)(?:[^0-9]|$)', 1) AS p0 FROM stamps),
       u AS (SELECT *, list_transform(list_filter(runs, lambda x: length(x) BETWEEN 2 AND 4), lambda x: CAST(x AS INT)) AS nums FROM t)
       SELECT read_id, CAST(CASE WHEN s LIKE '%600%' THEN 600 WHEN s LIKE '%480%' THEN 480 WHEN s LIKE '%240%' THEN 240
           WHEN s LIKE '%208%' THEN 208 WHEN s LIKE '%120%' THEN 120 END AS INT) AS trim_v,
         CAST(CASE WHEN p1 <> '' THEN CASE WHEN greatest(CAST(p1 AS INT), CAST(p2 AS INT)) <> 277
             THEN greatest(CAST(p1 AS INT), CAST(p2 AS INT)) END WHEN p0 <> '' THEN CAST(p0 AS INT) END AS INT) AS validate_v,
         CAST(CASE WHEN list_has_all(nums, [120, 240]) THEN 120 ELSE list_max(nums) END AS INT) AS legacy_v FROM u""")
def f13(stamps):
    c = F.col("volt_text")
    return stamps.select("read_id", *[el.parse_voltage(c, m).alias(f"{m}_v") for m in ("trim", "validate", "legacy")])


@query("f14_parse_amps", "stamps", rf"""WITH t AS (SELECT read_id, {DIGIT_FIX.format(c='upper(amp_text)')} AS s FROM stamps)
       SELECT read_id, coalesce(TRY_CAST(nullif(regexp_extract(s, '\b([6-9][0-9]|[1-9][0-9]{{2,3}})\s*(?:A|AMPS?)\b', 1), '') AS INT),
         TRY_CAST(nullif(regexp_extract(s, '(?:^|[^0-9])([6-9][0-9]|[1-9][0-9]{{2,3}})(?:[^0-9]|$)', 1), '') AS INT)) AS amps FROM t""")
def f14(stamps):
    return stamps.select("read_id", el.parse_amps(F.col("amp_text")).alias("amps"))


@query("f15_parse_kaic", "stamps", rf"""WITH t AS (SELECT read_id, {DIGIT_FIX.format(c='upper(ka_text)')} AS s FROM stamps),
       u AS (SELECT read_id, s, CASE WHEN replace(s, ' ', '') LIKE '%KA%' THEN TRY_CAST(nullif(regexp_extract(replace(s, ' ', ''), '\b([0-9]{{2,3}})K?A\b', 1), '') AS INT) END AS marked,
         TRY_CAST(nullif(replace(regexp_extract(s, '\b([0-9]{{2,3}},?[0-9]{{3}})\s*(?:A|KA)?\b', 1), ',', ''), '') AS INT) AS th,
         TRY_CAST(nullif(regexp_extract(s, '(?:^|[^0-9])([0-9]{{2,3}})(?:[^0-9]|$)', 1), '') AS INT) AS small FROM t)
       SELECT read_id, CAST(CASE WHEN marked IS NOT NULL THEN marked WHEN th IS NOT NULL THEN greatest(1, th // 1000)
         WHEN small IN (10,14,18,22,25,30,35,42,50,65,100,125,200) AND NOT regexp_matches(s, '\bA(MPS?)?\b') THEN small END AS INT) AS ka FROM u""")
def f15(stamps):
    return stamps.select("read_id", el.parse_kaic(F.col("ka_text")).alias("ka"))


PARSED_COMBOS = r"""c1 AS (SELECT panel_id, ord, trim(regexp_replace(regexp_replace(upper(text), '[^ -ILP]', ' ', 'g'), '\s+', ' ', 'g')) AS u FROM combos),
  c2 AS (SELECT panel_id, ord, regexp_replace(regexp_replace(u, '-+', '/', 'g'), '\b[IL]\b', '1', 'g') AS u, regexp_matches(u, '[0-9]') AS digits FROM c1),
  c3 AS (SELECT *, regexp_extract(u, '^([0-9]{2,3})A?\s*/\s*([123])P?$', 1) AS a1, regexp_extract(u, '^([0-9]{2,3})A?\s*/\s*([123])P?$', 2) AS p1,
    regexp_extract(u, '^([0-9]{2,3})A?\s*([123])P$', 1) AS a2, regexp_extract(u, '^([0-9]{2,3})A?\s*([123])P$', 2) AS p2,
    regexp_extract(u, '^([123])P?\s*/\s*([0-9]{2,3})A?$', 2) AS a3, regexp_extract(u, '^([123])P?\s*/\s*([0-9]{2,3})A?$', 1) AS p3,
    regexp_extract(u, '^([123])P\s*([0-9]{2,3})A?$', 2) AS a4, regexp_extract(u, '^([123])P\s*([0-9]{2,3})A?$', 1) AS p4,
    list_transform(regexp_extract_all(u, '[0-9]+'), lambda x: TRY_CAST(x AS INT)) AS nums FROM c2),
  c4 AS (SELECT *, TRY_CAST(coalesce(nullif(a1, ''), nullif(a2, ''), nullif(a3, ''), nullif(a4, '')) AS INT) AS a,
    TRY_CAST(coalesce(nullif(p1, ''), nullif(p2, ''), nullif(p3, ''), nullif(p4, '')) AS INT) AS p FROM c3),
  parsed AS (SELECT panel_id, ord,
    CASE WHEN NOT digits THEN NULL WHEN a BETWEEN 15 AND 250 AND a % 5 = 0 THEN a
      ELSE list_filter(nums, lambda x: x BETWEEN 15 AND 250 AND x % 5 = 0)[1] END AS amps,
    CASE WHEN NOT digits THEN NULL WHEN a BETWEEN 15 AND 250 AND a % 5 = 0 THEN p
      ELSE list_filter(nums, lambda x: x IN (1, 2, 3))[1] END AS poles,
    CASE WHEN NOT digits THEN 'nodigits' WHEN a BETWEEN 15 AND 250 AND a % 5 = 0 THEN 'regex' ELSE 'digits' END AS method FROM c4)"""


@query("f16_parse_combo", "combos", "WITH " + PARSED_COMBOS + " SELECT panel_id, ord, amps, poles, method FROM parsed")
def f16(combos):
    return combos.select("panel_id", "ord", tx.parse_combo(F.col("text")).alias("c")).select("panel_id", "ord", "c.*")


@query("f17_parse_combo_lexicon", "combos", r"""SELECT panel_id, ord, TRY_CAST(coalesce(
         nullif(regexp_extract(u, '\b([0-9]{1,3})\s*/\s*([123])\b', 1), ''), nullif(regexp_extract(u, '\b([123])\s*P(?:OLES?)?\s*[-/]?\s*([0-9]{1,3})\s*A?\b', 2), ''),
         nullif(regexp_extract(u, '\b([0-9]{1,3})\s*A?\s*[-/ ]\s*([123])\s*P\b', 1), ''), nullif(regexp_extract(u, '\b([0-9]{1,3})\s*[A]?\s*/\s*([123])\s*[P]\b', 1), '')) AS INT) AS amps,
       TRY_CAST(coalesce(
         nullif(regexp_extract(u, '\b([0-9]{1,3})\s*/\s*([123])\b', 2), ''), nullif(regexp_extract(u, '\b([123])\s*P(?:OLES?)?\s*[-/]?\s*([0-9]{1,3})\s*A?\b', 1), ''),
         nullif(regexp_extract(u, '\b([0-9]{1,3})\s*A?\s*[-/ ]\s*([123])\s*P\b', 2), ''), nullif(regexp_extract(u, '\b([0-9]{1,3})\s*[A]?\s*/\s*([123])\s*[P]\b', 2), '')) AS INT) AS poles,
       CASE WHEN regexp_matches(u, '\bSPARES?\b') THEN 'spare' WHEN regexp_matches(u, '\b(SPACE|PROVISION|EMPTY|BLANK|UNUSED|OPEN)\b') THEN 'empty' ELSE 'device' END AS row_kind
       FROM (SELECT panel_id, ord, upper(text) AS u FROM combos) t""")
def f17(combos):
    return combos.select("panel_id", "ord", tx.parse_combo_lexicon(F.col("text")).alias("c")).select("panel_id", "ord", "c.*")


@query("f18_plausible_trip", "combos", r"""WITH t AS (SELECT *, CASE WHEN regexp_full_match(trim(text), '[0-9]+') THEN TRY_CAST(trim(text) AS INT) END AS n,
         TRY_CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS INT) AS m FROM combos)
       SELECT panel_id, ord, coalesce(n BETWEEN 10 AND 1200 AND n % 5 = 0, FALSE) AS trip,
         coalesce(n IN (15,20,25,30,35,40,45,50,60,70,80,90,100,125,150,175,200,225,250,300,350,400,450,500,600,800,1000,1200), FALSE) AS common_trip,
         coalesce(m IN (1, 2, 3) AND upper(text) NOT LIKE '%A%' AND text NOT LIKE '%.%', FALSE) AS pole FROM t""")
def f18(combos):
    c = F.col("text")
    return combos.select("panel_id", "ord", el.plausible_trip(c).alias("trip"),
                         el.plausible_trip(c, common_only=True).alias("common_trip"), el.plausible_poles(c).alias("pole"))


@query("f19_describe_row_flags", "stamps", r"""SELECT read_id, CASE WHEN s IN ('SPARE', 'SPARES') THEN 'spare'
         WHEN s IN ('SPACE', 'BLANK', 'EMPTY', 'FILLER') THEN 'blank' WHEN regexp_full_match(s, '[0-9 ]*') THEN 'numeric'
         WHEN length(regexp_replace(s, '[^A-Z]', '', 'g')) < 2 THEN 'short' ELSE 'load' END AS flag
       FROM (SELECT read_id, trim(regexp_replace(regexp_replace(upper(row_text), '[^A-Z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS s FROM stamps) t""")
def f19(stamps):
    return stamps.select("read_id", tx.describe_row_flags(F.col("row_text")).alias("flag"))


@query("f20_safe_int", "stamps", r"""SELECT read_id, coalesce(CAST(trunc(TRY_CAST(number_text AS DOUBLE)) AS INT), 0) AS safe,
       TRY_CAST(regexp_replace(number_text, '[^0-9]', '', 'g') AS INT) AS digits,
       CASE WHEN regexp_full_match(trim(replace(number_text, ',', '')), '[+-]?[0-9]+') THEN TRY_CAST(trim(replace(number_text, ',', '')) AS INT) END AS comma
       FROM stamps""")
def f20(stamps):
    c = F.col("number_text")
    return stamps.select("read_id", tx.safe_int(c).alias("safe"), tx.digits_int(c).alias("digits"), tx.comma_int(c).alias("comma"))


@query("f21_scrub_none", "stamps", r"""SELECT read_id, CASE WHEN upper(trim(number_text)) = 'NONE' THEN NULL ELSE number_text END AS number_text,
       CASE WHEN regexp_full_match(trim(number_text), '-?[0-9]+(\.[0-9]+)?') THEN TRY_CAST(trim(number_text) AS DOUBLE) END AS number,
       CASE WHEN upper(trim(number_text)) = 'NONE' THEN 'NONE'
         WHEN regexp_full_match(trim(number_text), '-?[0-9]+(\.[0-9]+)?') THEN
           CASE WHEN TRY_CAST(trim(number_text) AS DOUBLE) = floor(TRY_CAST(trim(number_text) AS DOUBLE)) THEN CAST(CAST(TRY_CAST(trim(number_text) AS DOUBLE) AS BIGINT) AS VARCHAR)
             ELSE CAST(TRY_CAST(trim(number_text) AS DOUBLE) AS VARCHAR) END
         ELSE trim(number_text) END AS rendered FROM stamps""")
def f21(stamps):
    c = F.col("number_text")
    rows = stamps.select("read_id", "number_text", tx.coerce_scalar(c).alias("number"), tx.render_scalar(c).alias("rendered"))
    return tx.scrub_none(rows, ["number_text"])


@query("f22_coerce_setting", "stamps", r"""SELECT read_id,
       CASE WHEN s IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(s, '[0-9]+') THEN 'int' ELSE 'text' END AS kind,
       CASE WHEN s IN ('true', 'false') THEN s WHEN regexp_full_match(s, '[0-9]+') THEN CAST(CAST(s AS BIGINT) AS VARCHAR) ELSE setting_text END AS value
       FROM (SELECT read_id, setting_text, lower(trim(setting_text)) AS s FROM stamps) t""")
def f22(stamps):
    return stamps.select("read_id", tx.coerce_setting(F.col("setting_text")).alias("c")).select("read_id", "c.*")


@query("f23_valid_bus_amp", "stamps", "SELECT read_id, coalesce(amps BETWEEN 100 AND 1200 AND amps % 5 = 0, FALSE) AS ok FROM stamps")
def f23(stamps):
    return stamps.select("read_id", el.valid_bus_amp(F.col("amps")).alias("ok"))


SNAP_UP2 = "CASE spaces WHEN 20 THEN 18 WHEN 32 THEN 30 WHEN 44 THEN 42 WHEN 56 THEN 54 WHEN 68 THEN 66 WHEN 74 THEN 72 WHEN 86 THEN 84 {more} ELSE spaces END"


@query("f24_snap_spaces", "panels", f"""SELECT panel_id, {SNAP_UP2.format(more='WHEN 16 THEN 18 WHEN 28 THEN 30 WHEN 40 THEN 42 WHEN 52 THEN 54 WHEN 64 THEN 66 WHEN 70 THEN 72 WHEN 82 THEN 84')} AS parsed,
       {SNAP_UP2.format(more='')} AS ruled FROM panels""")
def f24(panels):
    c = F.col("spaces")
    return panels.select("panel_id", el.snap_spaces(c).alias("parsed"), el.snap_spaces(c, both_sides=False).alias("ruled"))


@query("f25_parse_job_note", "stamps", r"""WITH p AS (SELECT read_id, list_filter(list_transform(string_split(note_text, '|'), lambda x: trim(x)), lambda x: x LIKE '%=%') AS ps FROM stamps),
       kv AS (SELECT read_id, list_transform(ps, lambda x: trim(split_part(x, '=', 1))) AS ks,
         list_transform(ps, lambda x: trim(substr(x, strpos(x, '=') + 1))) AS vs FROM p)
       SELECT read_id, vs[len(ks) - list_position(list_reverse(ks), 'job_name') + 1] AS job_name,
         CAST(NULL AS VARCHAR) AS submitted_at_utc, CAST(NULL AS VARCHAR) AS submitted_local,
         CASE WHEN list_contains(ks, 'tz_offset_min') THEN vs[list_position(ks, 'tz_offset_min')] END AS tz_offset_min,
         vs[len(ks) - list_position(list_reverse(ks), 'user') + 1] AS user FROM kv""")
def f25(stamps):
    return stamps.select("read_id", tx.parse_job_note(F.col("note_text")).alias("n")).select("read_id", "n.*")


@query("f26_slugify", "stamps", r"""SELECT read_id, coalesce(nullif(regexp_replace(replace(trim(note_text), ' ', '_'), '[^A-Za-z0-9._-]+', '', 'g'), ''), 'untitled') AS slug,
       coalesce(nullif(regexp_replace(replace(trim(row_text), ' ', '_'), '[^A-Za-z0-9._-]+', '', 'g'), ''), 'untitled') || '__' || strftime(submitted, '%Y%m%d_%H%M%S') AS job_key FROM stamps""")
def f26(stamps):
    return stamps.select("read_id", tx.slugify(F.col("note_text")).alias("slug"),
                         tx.job_key(F.col("row_text"), F.col("submitted")).alias("job_key"))


@query("f27_format_cycle_time", "stamps", r"""SELECT read_id, printf('%02d:%02d:%02d:%03d', v // 3600000, v // 60000 % 60, v // 1000 % 60, v % 1000) AS cycle,
       CASE WHEN v >= 3600000 THEN printf('%dh %dm %d.%03ds', v // 3600000, v // 60000 % 60, v // 1000 % 60, v % 1000)
         WHEN v >= 60000 THEN printf('%dm %d.%03ds', v // 60000, v // 1000 % 60, v % 1000)
         ELSE printf('%d.%03ds', v // 1000, v % 1000) END AS duration
       FROM (SELECT read_id, greatest(ms, 0) AS v FROM stamps) t""")
def f27(stamps):
    return stamps.select("read_id", tx.format_cycle_time(F.col("ms")).alias("cycle"), tx.format_duration(F.col("ms")).alias("duration"))


@query("f28_breaker_desc_from_pn", "breakers", r"""SELECT panel_id, ord, CASE WHEN TRY_CAST(p AS INT) >= 1 AND TRY_CAST(a AS INT) >= 1
         THEN CAST(CAST(a AS INT) AS VARCHAR) || 'A ' || p || 'P' ELSE '' END AS description
       FROM (SELECT panel_id, ord, regexp_extract(pn, '^[A-Z]+([0-9])[A-Z0-9]*?([0-9]{2,3})$', 1) AS p,
         regexp_extract(pn, '^[A-Z]+([0-9])[A-Z0-9]*?([0-9]{2,3})$', 2) AS a
         FROM (SELECT panel_id, ord, concat(CASE WHEN ord % 2 = 0 THEN 'EDB' ELSE 'EJB' END, CAST(poles AS VARCHAR),
           CASE WHEN ord % 3 = 0 THEN 'X4' ELSE '4' END, lpad(CAST(amperage % 1000 AS VARCHAR), 3, '0'), special_features) AS pn FROM breakers) b) t""")
def f28(breakers):
    pn = F.concat(F.when(F.col("ord") % 2 == 0, "EDB").otherwise("EJB"), F.col("poles").cast("string"),
                  F.when(F.col("ord") % 3 == 0, "X4").otherwise("4"),
                  F.lpad((F.col("amperage") % 1000).cast("string"), 3, "0"), "special_features")
    return breakers.select("panel_id", "ord", el.breaker_desc_from_pn(pn).alias("description"))
