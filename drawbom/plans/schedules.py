"""Queries over breaker extraction."""

from pyspark.sql import functions as F

from drawbom.functions.text import parse_combo
from drawbom.operators import schedule as sc
from drawbom.plans.registry import query
from drawbom.plans.text_reads import PARSED_COMBOS

# numbers found by a fold over distinct centres; the same walk as a list fold
KEPT_APART = "list_reduce(list_prepend([{first}], list_transform({rest}, lambda v: [v])), lambda acc, x: CASE WHEN x[1] - acc[-1] >= {gap} THEN list_append(acc, x[1]) ELSE acc END)"


@query("b1_trip_values", "tokens", """WITH r AS (SELECT page_id, pos AS ord, y1 + y2 AS y2x, list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))) AS ml,
    regexp_extract_all(text, '[0-9]+') AS runs FROM tokens WHERE regexp_matches(text, '[0-9]')),
  ys AS (SELECT page_id, list_sort(list(DISTINCT y2x)) AS l FROM r GROUP BY page_id),
  k AS (SELECT page_id, unnest(list_reduce(list_transform(l, lambda v: [v]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= 20 THEN list_append(acc, x[1]) ELSE acc END)) AS y2x FROM ys),
  f AS (SELECT *, row_number() OVER (PARTITION BY page_id, y2x ORDER BY ord) AS n FROM r)
  SELECT f.page_id, f.ord, f.y2x, list_filter(runs, lambda x: length(x) = ml)[1] AS value FROM f JOIN k ON k.page_id = f.page_id AND k.y2x = f.y2x WHERE n = 1""")
def b1(tokens):
    return sc.trip_values(tokens.withColumnRenamed("pos", "ord"), ["page_id"])


@query("b2_vote_digit", "digit_probs", """WITH g AS (SELECT panel_id, i, """ + ", ".join(
    f"sum(CASE WHEN source = '{s}' AND digit = {d} THEN p ELSE 0 END) AS {s}{d}" for s in ("ocr", "template", "ink") for d in (1, 2, 3)) + """,
    NOT bool_or(source = 'template' AND abstain) AS tv, NOT bool_or(source = 'ink' AND abstain) AS iv FROM digit_probs GROUP BY panel_id, i),
  s AS (SELECT *, round(2.0 * ocr1 + CASE WHEN tv THEN 1.25 ELSE 0 END * template1 + CASE WHEN iv THEN 1.25 ELSE 0 END * ink1, 6) AS s1, round(2.0 * ocr2 + CASE WHEN tv THEN 1.25 ELSE 0 END * template2 + CASE WHEN iv THEN 1.25 ELSE 0 END * ink2, 6) AS s2,
    round(2.0 * ocr3 + CASE WHEN tv THEN 1.25 ELSE 0 END * template3 + CASE WHEN iv THEN 1.25 ELSE 0 END * ink3, 6) AS s3 FROM g),
  w AS (SELECT *, CASE WHEN s1 >= s2 AND s1 >= s3 THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS hat, CASE WHEN ocr1 >= ocr2 AND ocr1 >= ocr3 THEN 1 WHEN ocr2 >= ocr3 THEN 2 ELSE 3 END AS od,
    CASE WHEN template1 >= template2 AND template1 >= template3 THEN 1 WHEN template2 >= template3 THEN 2 ELSE 3 END AS td, CASE WHEN ink1 >= ink2 AND ink1 >= ink3 THEN 1 WHEN ink2 >= ink3 THEN 2 ELSE 3 END AS idg FROM s),
  a AS (SELECT *, CASE WHEN tv AND td = hat THEN 1 ELSE 0 END + CASE WHEN iv AND idg = hat THEN 1 ELSE 0 END AS agree, round([s1, s2, s3][hat] - [s1, s2, s3][od], 6) AS margin, greatest(ocr1, ocr2, ocr3) AS q FROM w),
  d AS (SELECT *, round(CASE WHEN agree >= 2 THEN 0.60 WHEN agree = 1 THEN 0.75 END - CASE WHEN q < 0.55 THEN 0.10 ELSE 0 END, 6) AS delta FROM a)
  SELECT panel_id, i, CASE WHEN hat <> od AND coalesce(margin >= delta, FALSE) THEN hat ELSE od END AS digit, hat <> od AND coalesce(margin >= delta, FALSE) AS override, margin FROM d""")
def b2(digit_probs):
    return sc.vote_digit(digit_probs)


PAIRS = "pairs AS (SELECT t.panel_id, t.side, t.i, p.poles, t.amps FROM trip_reads t JOIN pole_reads p ON p.panel_id = t.panel_id AND p.side = t.side AND p.i = t.i WHERE amps IS NOT NULL AND poles IS NOT NULL)"


@query("b3_pair_by_index", "trip_reads pole_reads", "WITH " + PAIRS + " SELECT * FROM pairs")
def b3(trip_reads, pole_reads):
    return sc.pair_by_index(trip_reads, pole_reads)


COMBINED = PARSED_COMBOS + ", " + PAIRS + """, combo AS (SELECT panel_id, CASE WHEN ord % 2 = 1 THEN 'L' ELSE 'R' END AS side, (ord + 1) // 2 AS i, poles, amps FROM parsed WHERE amps IS NOT NULL AND poles IS NOT NULL),
  merged AS (SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM combo c WHERE c.panel_id = p.panel_id AND c.side = p.side) UNION ALL SELECT * FROM combo)"""


def combined(trip_reads, pole_reads, combos):
    read = combos.select("panel_id", "ord", parse_combo(F.col("text")).alias("c"))
    combo = read.select("panel_id", F.when(F.col("ord") % 2 == 1, "L").otherwise("R").alias("side"), F.floor((F.col("ord") + 1) / 2).cast("long").alias("i"), "c.poles", "c.amps")
    combo = combo.filter("amps IS NOT NULL AND poles IS NOT NULL")
    return sc.prefer_combo_side(sc.pair_by_index(trip_reads, pole_reads), combo)


@query("b4_prefer_combo_side", "trip_reads pole_reads combos", "WITH " + COMBINED + " SELECT panel_id, side, i, poles, amps FROM merged")
def b4(trip_reads, pole_reads, combos):
    return combined(trip_reads, pole_reads, combos)


@query("b5_count_breakers", "trip_reads pole_reads combos", "WITH " + COMBINED + " SELECT panel_id, poles, amps AS amperage, count(*) AS cnt FROM merged GROUP BY ALL")
def b5(trip_reads, pole_reads, combos):
    return sc.count_breakers(combined(trip_reads, pole_reads, combos))


@query("b6_union_chunks", "trip_reads", """WITH t AS (SELECT * FROM trip_reads WHERE i <= 2), b AS (SELECT panel_id, side, i - 2 AS i, amps FROM trip_reads WHERE i > 2)
  SELECT *, 1 AS chunk FROM t UNION ALL SELECT b.panel_id, b.side, b.i + coalesce((SELECT max(i) FROM t WHERE t.panel_id = b.panel_id AND t.side = b.side), 0), amps, 2 FROM b""")
def b6(trip_reads):
    return sc.union_chunks(trip_reads.filter("i <= 2"), trip_reads.filter("i > 2").withColumn("i", F.col("i") - 2))
