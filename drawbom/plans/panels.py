"""Queries over panel assembly."""

from pyspark.sql import functions as F

from drawbom.operators import panels as pn
from drawbom.plans.registry import query

NAMED = """SELECT panel_id, job_id, ord, CASE panel_id % 5 WHEN 0 THEN lower(raw_name) WHEN 1 THEN concat(' ', raw_name) WHEN 2 THEN CASE WHEN panel_id % 4 = 0 THEN '  ' ELSE raw_name END ELSE raw_name END AS raw_name FROM panels"""


def named(panels):
    m = F.col("panel_id") % 5
    raw = (F.when(m == 0, F.lower("raw_name")).when(m == 1, F.concat(F.lit(" "), "raw_name"))
           .when((m == 2) & (F.col("panel_id") % 4 == 0), "  ").otherwise(F.col("raw_name")))
    return panels.select("panel_id", "job_id", "ord", raw.alias("raw_name"))


@query("v1_dedupe_names", "panels", f"""WITH p AS ({NAMED}), b AS (SELECT *, coalesce(nullif(trim(raw_name), ''), '(unnamed)') AS base FROM p),
  n AS (SELECT panel_id, base, row_number() OVER (PARTITION BY job_id, upper(base) ORDER BY ord) AS k FROM b)
  SELECT panel_id, CASE WHEN k = 1 THEN base ELSE base || ' (' || k || ')' END AS name FROM n""")
def v1(panels):
    return pn.dedupe_names(named(panels)).select("panel_id", "name")


def readings(panels):
    k = F.col("panel_id")
    header = panels.select("panel_id", F.when(k % 4 == 0, "").otherwise(F.col("raw_name")).alias("name"),
                           F.when(k % 3 == 0, 0).otherwise(F.col("voltage")).alias("voltage"),
                           F.when(k % 5 != 0, F.col("bus_amps")).alias("bus_amps"), "main_amps")
    analyzer = panels.select("panel_id", F.concat("raw_name", F.lit("?")).alias("name"), (F.col("voltage") + 1).alias("voltage"),
                             (F.col("bus_amps") * 2).alias("bus_amps"), F.when(k % 2 == 0, F.col("bus_amps")).alias("main_amps"))
    table = panels.filter(k % 7 != 0).select("panel_id", "spaces")
    return header, analyzer, table


@query("v2_coalesce_panel_keys", "panels", """SELECT panel_id, CASE WHEN panel_id % 4 = 0 THEN raw_name || '?' ELSE raw_name END AS name,
    CASE WHEN panel_id % 3 = 0 THEN voltage + 1 ELSE voltage END AS voltage, CASE WHEN panel_id % 5 = 0 THEN bus_amps * 2 ELSE bus_amps END AS bus_amps,
    coalesce(main_amps, CASE WHEN panel_id % 2 = 0 THEN bus_amps END) AS main_amps, CASE WHEN panel_id % 7 <> 0 THEN spaces END AS spaces FROM panels""")
def v2(panels):
    return pn.coalesce_panel_keys(*readings(panels))


def doubtful(panels):
    k = F.col("panel_id")
    return panels.select("panel_id", "raw_name", F.when(k % 11 == 0, 277).otherwise(F.col("voltage")).alias("voltage"),
                         F.when(k % 6 == 0, F.col("bus_amps") - 1).otherwise(F.col("bus_amps")).alias("bus_amps"),
                         F.when(k % 8 == 0, 90).otherwise(F.col("main_amps")).alias("main_amps"), "int_rating",
                         F.when(k % 9 == 0, None).otherwise(F.col("spaces")).alias("spaces"))


@query("v3_validate_panels", "panels", """WITH d AS (SELECT panel_id, raw_name, CASE WHEN panel_id % 11 = 0 THEN 277 ELSE voltage END AS voltage, CASE WHEN panel_id % 6 = 0 THEN bus_amps - 1 ELSE bus_amps END AS bus_amps,
    CASE WHEN panel_id % 8 = 0 THEN 90 ELSE main_amps END AS main_amps, int_rating, CASE WHEN panel_id % 9 = 0 THEN NULL ELSE spaces END AS spaces FROM panels),
  s AS (SELECT *, concat_ws(', ', CASE WHEN voltage NOT IN (120, 208, 240, 480, 600) THEN 'voltage' END, CASE WHEN NOT (bus_amps BETWEEN 100 AND 1200 AND bus_amps % 5 = 0) THEN 'bus' END,
    CASE WHEN main_amps IS NOT NULL AND NOT (main_amps BETWEEN 100 AND 1200 AND main_amps % 5 = 0) THEN 'main' END, CASE WHEN coalesce(spaces, 0) <= 0 THEN 'spaces' END) AS bad FROM d)
  SELECT panel_id, raw_name, CASE WHEN bad = '' THEN 'ok' ELSE 'invalid ' || bad END AS status, CASE WHEN bad = '' THEN voltage END AS voltage, CASE WHEN bad = '' THEN bus_amps END AS bus_amps,
    CASE WHEN bad = '' THEN main_amps END AS main_amps, CASE WHEN bad = '' THEN int_rating END AS int_rating, CASE WHEN bad = '' THEN spaces END AS spaces FROM s""")
def v3(panels):
    return pn.validate_panels(doubtful(panels))


@query("v4_merge_components", "panels breakers", """WITH h AS (SELECT panel_id, raw_name, voltage, bus_amps, CASE WHEN panel_id % 5 <> 0 THEN spaces END AS spaces FROM panels), t AS (SELECT panel_id, CASE WHEN panel_id % 3 <> 0 THEN spaces + 2 END AS spaces FROM panels),
  m AS (SELECT coalesce(h.panel_id, t.panel_id) AS panel_id, raw_name, coalesce(t.spaces, h.spaces) AS spaces FROM h FULL JOIN t ON t.panel_id = h.panel_id),
  b AS (SELECT panel_id, CAST(sum(cnt) AS BIGINT) AS breakers, CAST(sum(CASE WHEN ord % 2 = 0 THEN cnt ELSE 0 END) AS BIGINT) AS from_header FROM breakers GROUP BY panel_id)
  SELECT m.panel_id, raw_name, spaces, coalesce(breakers, 0) AS breakers, coalesce(from_header, 0) AS from_header FROM m LEFT JOIN b ON b.panel_id = m.panel_id""")
def v4(panels, breakers):
    header = panels.select("panel_id", "raw_name", "voltage", "bus_amps", F.when(F.col("panel_id") % 5 != 0, F.col("spaces")).alias("spaces"))
    table = panels.select("panel_id", F.when(F.col("panel_id") % 3 != 0, F.col("spaces") + 2).alias("spaces"))
    both = pn.merge_breakers(breakers.filter(F.col("ord") % 2 == 0), breakers.filter(F.col("ord") % 2 == 1))
    n = both.groupBy("panel_id").agg(F.sum("cnt").cast("long").alias("breakers"),
                                     F.sum(F.when(F.col("source") == "header", F.col("cnt")).otherwise(0)).cast("long").alias("from_header"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return pn.merge_components(header, table).join(n, "panel_id", "left").select("panel_id", "raw_name", "spaces", zero("breakers"), zero("from_header"))


@query("v5_suppress_bad_panels", "panels breakers", """WITH r AS (SELECT panel_id, ord, CASE WHEN (panel_id + ord) % 13 = 0 THEN NULL ELSE amperage END AS amperage, cnt FROM breakers),
  s AS (SELECT p.panel_id, CAST(coalesce(sum(CASE WHEN r.panel_id IS NOT NULL AND (amperage IS NULL OR amperage NOT BETWEEN 15 AND 1200 OR amperage > coalesce(main_amps, bus_amps)) THEN greatest(1, cnt) ELSE 0 END), 0) AS BIGINT) AS strikes,
    count(r.panel_id) AS n FROM panels p LEFT JOIN r ON r.panel_id = p.panel_id GROUP BY p.panel_id)
  SELECT panel_id, strikes, strikes >= 2 AS breaker_data_suppressed, CASE WHEN strikes >= 2 THEN 'No breakers supplied: ' || strikes || ' breaker(s) failed validation' END AS suppress_note, CASE WHEN strikes >= 2 THEN 0 ELSE n END AS kept FROM s""")
def v5(panels, breakers):
    reads = breakers.select("panel_id", "ord", F.when((F.col("panel_id") + F.col("ord")) % 13 == 0, None).otherwise(F.col("amperage")).alias("amperage"), "cnt")
    flagged, kept = pn.suppress_bad_panels(panels, reads)
    n = kept.groupBy("panel_id").agg(F.count("*").alias("kept"))
    return flagged.join(n, "panel_id", "left").select("panel_id", "strikes", "breaker_data_suppressed", "suppress_note",
                                                      F.coalesce("kept", F.lit(0).cast("long")).alias("kept"))


@query("v6_isolate_failures", "stamps", """SELECT read_id, TRY_CAST(number_text AS DOUBLE) AS number, TRY_CAST(setting_text AS INTEGER) AS setting,
    CASE WHEN TRY_CAST(number_text AS DOUBLE) IS NULL THEN 'number is not numeric' WHEN TRY_CAST(setting_text AS INTEGER) IS NULL THEN 'setting is not a whole number' END AS skip_reason,
    TRY_CAST(number_text AS DOUBLE) IS NULL OR TRY_CAST(setting_text AS INTEGER) IS NULL AS skipped FROM stamps""")
def v6(stamps):
    out = pn.isolate_failures(stamps.select("read_id", "number_text", "setting_text"), {
        "number": (F.col("number_text").try_cast("double"), "number is not numeric"),
        "setting": (F.col("setting_text").try_cast("int"), "setting is not a whole number")})
    return out.drop("number_text", "setting_text")
