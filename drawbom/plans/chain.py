"""The whole way from recognised tokens and schedule readings to bills of materials."""

import re

from pyspark.sql import functions as F

from drawbom.operators import panels as pn, schedule as sc
from drawbom.plans.bom import QUOTES, bom_of
from drawbom.plans.key_values import ATTRS, attrs_of
from drawbom.plans.registry import query
from drawbom.plans.schedules import COMBINED, combined
from drawbom.sources import files as fl

_READ = re.sub(r"\bmerged\b", "schedule_rows", COMBINED)
_QUOTED = re.sub(r"\b(FROM|JOIN) (panels|breakers)\b", r"\1 read_\2", QUOTES)
CHAIN = ATTRS + ", " + _READ + """, sides AS (SELECT panel_id, CAST(2 * max(i) AS INT) AS spaces FROM schedule_rows GROUP BY panel_id),
  assembled AS (SELECT a.page_id AS panel_id, a.page_id // 20 AS job_id, a.page_id AS ord, a.name AS raw_name, voltage, bus_amps, main_amps, int_rating, s.spaces FROM attrs a LEFT JOIN sides s ON s.panel_id = a.page_id),
  read_panels AS MATERIALIZED (SELECT * FROM assembled WHERE voltage IN (120, 208, 240, 480, 600) AND bus_amps BETWEEN 100 AND 1200 AND bus_amps % 5 = 0
    AND (main_amps IS NULL OR (main_amps BETWEEN 100 AND 1200 AND main_amps % 5 = 0)) AND spaces > 0),
  counted AS (SELECT panel_id, poles, amps AS amperage, count(*) AS cnt FROM schedule_rows GROUP BY ALL),
  strikes AS (SELECT c.panel_id, sum(CASE WHEN amperage BETWEEN 15 AND 1200 AND amperage <= coalesce(main_amps, bus_amps) THEN 0 ELSE cnt END) AS n FROM counted c JOIN read_panels p ON p.panel_id = c.panel_id GROUP BY c.panel_id),
  read_breakers AS MATERIALIZED (SELECT c.panel_id, poles, amperage, cnt, '' AS special_features, CAST(NULL AS BIGINT) AS ord FROM counted c JOIN strikes s ON s.panel_id = c.panel_id AND s.n < 2), """ + _QUOTED


def panels_of(attrs, schedule):
    """Valid panels: header attributes of a page with the spaces of its schedule."""
    sides = schedule.groupBy("panel_id").agg((2 * F.max("i")).cast("int").alias("spaces"))
    page = F.col("page_id")
    panels = attrs.select(page.alias("panel_id"), F.floor(page / 20).alias("job_id"), page.alias("ord"), F.col("name").alias("raw_name"),
                          "voltage", "bus_amps", "main_amps", "int_rating").join(sides, "panel_id", "left")
    return pn.validate_panels(panels).filter("status = 'ok'").drop("status")


def written(df, folder, name):
    """A stage output that several later steps read: computed once, on shared storage."""
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


@query("c1_tokens_to_bom", "tokens page_sizes trip_reads pole_reads combos ladder fillers bom_policy",
       "WITH " + CHAIN + " SELECT p.job_id, b.panel_id, p.raw_name AS name, b.item_type, b.product, b.qty, b.notes FROM bom b JOIN read_panels p ON p.panel_id = b.panel_id")
def c1(tokens, page_sizes, trip_reads, pole_reads, combos, ladder, fillers, bom_policy):
    folder = fl.shared_folder(tokens.sparkSession)
    schedule = written(combined(trip_reads, pole_reads, combos), folder, "schedule")
    panels = written(panels_of(attrs_of(tokens, page_sizes), schedule), folder, "panels")
    counted = sc.count_breakers(schedule).withColumn("special_features", F.lit("")).join(panels.select("panel_id"), "panel_id", "left_semi")
    breakers = written(pn.suppress_bad_panels(panels, counted)[1], folder, "breakers")
    named = panels.select("job_id", "panel_id", F.col("raw_name").alias("name"))
    bom = bom_of(panels, breakers, ladder, fillers, bom_policy).join(named, "panel_id")
    return bom.select("job_id", "panel_id", "name", "item_type", "product", "qty", "notes")
