"""Queries over sources and sinks: derived data goes out and comes back."""

from pyspark.sql import functions as F

from drawbom.operators.rules import placement as pl, sizing as sz
from drawbom.plans.bom import QUOTES, T, bom_of
from drawbom.plans.registry import query
from drawbom.plans.rules_basic import configured
from drawbom.sources import files as fl


@query("s1_tokens_from_polygons", "tokens", """SELECT pdf_id, page_id, pos, text, greatest(0, least(999, x1 - 5)) AS x1, greatest(0, least(1999, y1 - 3)) + 40 AS y1, greatest(0, least(999, x2 + 4)) AS x2, greatest(0, least(1999, y2)) + 40 AS y2 FROM tokens""")
def s1(tokens):
    p = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    dets = tokens.select("pdf_id", "page_id", "pos", "text", "conf", F.array(p(x1 - 5, y1), p(x2, y1 - 3), p(x2 + 4, y2), p(x1, y2 - 1)).alias("box"),
                         F.lit(1000).cast("long").alias("band_width"), F.lit(2000).cast("long").alias("band_height"), F.lit(40).cast("long").alias("band_offset"))
    return fl.tokens_from_polygons(dets).drop("conf")


@query("s2_lines_round_trip", "ruled_lines", "SELECT page_id // 100 AS pdf_id, page_id, line_no, y_center, x_left, x_right, thickness FROM ruled_lines")
def s2(ruled_lines):
    spark, folder = ruled_lines.sparkSession, fl.shared_folder(ruled_lines.sparkSession)
    fl.write_lines(ruled_lines.withColumn("pdf_id", F.floor(F.col("page_id") / 100)), folder + "/lines")
    return fl.read_lines(spark, folder + "/lines")


@query("s3_list_crops", "ruled_lines", "SELECT 'job=' || (page_id // 100) AS job, count(DISTINCT page_id % 100 // 25) AS crops FROM ruled_lines GROUP BY ALL")
def s3(ruled_lines):
    """Files of all jobs, one per quarter of a job's pages, listed from the shared folder."""
    spark, folder = ruled_lines.sparkSession, fl.shared_folder(ruled_lines.sparkSession)
    job, part = F.floor(F.col("page_id") / 100), F.floor(F.col("page_id") % 100 / 25)
    ruled_lines.withColumns({"job": job, "part": part}).repartition("job", "part").write.partitionBy("job", "part").json(folder + "/crops")
    crops = fl.list_crops(spark, folder + "/crops", "*.json").filter("length > 0")
    return crops.groupBy("job").agg(F.count("*").alias("crops"))


@query("s4_lexicon_settings", "job_events", """SELECT owner_id, field, CAST(row_number() OVER (PARTITION BY owner_id, field ORDER BY pattern) AS INTEGER) AS ord, pattern FROM (
    SELECT DISTINCT owner_id, 'states' AS field, state AS pattern FROM job_events UNION ALL SELECT DISTINCT owner_id, 'ended', state || ' // "kept"' FROM job_events WHERE state IN ('done', 'error')) x""")
def s4(job_events):
    """A settings file with comments per owner, and the pattern rows read from all of them."""
    spark, folder = job_events.sparkSession, fl.shared_folder(job_events.sparkSession)
    lists = job_events.groupBy("owner_id").agg(
        F.array_sort(F.collect_set("state")).alias("states"), F.array_sort(F.collect_set(F.when(F.col("state").isin("done", "error"), F.concat("state", F.lit(' // "kept"'))))).alias("ended"))
    text = F.concat(F.lit('// states of one owner\n{ "states": '), F.to_json("states"), F.lit(', /* those that\nend a job */ "more": {"ended": '), F.to_json("ended"), F.lit(",},}"))
    lists.select("owner_id", text.alias("value")).repartition("owner_id").write.partitionBy("owner_id").option("lineSep", "\n").text(folder + "/settings")
    rows = fl.lexicon_patterns(fl.read_jsonc_config(spark, folder + "/settings"))
    return rows.select(F.regexp_extract("path", "owner_id=([0-9]+)/", 1).cast("long").alias("owner_id"), "field", "ord", "pattern")


@query("s5_job_status_round_trip", "job_events", """SELECT job_id, owner_id, state FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts_ms DESC, event_id DESC) AS n FROM job_events) x WHERE n = 1 AND job_id % 9 <> 0""")
def s5(job_events):
    from drawbom.operators.jobs import latest_job_state
    spark, folder = job_events.sparkSession, fl.shared_folder(job_events.sparkSession)
    latest = latest_job_state(job_events)
    doc = F.to_json(F.struct("job_id", "owner_id", "state"))
    broken = F.when(F.col("job_id") % 9 == 0, F.concat(F.lit("{broken "), doc)).otherwise(doc)
    latest.select(broken.alias("value")).write.mode("overwrite").text(folder + "/jobs")
    return (spark.read.schema(fl.STATUS_SCHEMA).option("mode", "DROPMALFORMED").json(folder + "/jobs")
            .filter("state IS NOT NULL").select("job_id", "owner_id", "state"))


@query("s6_bom_csv_round_trip", T, "WITH " + QUOTES + """ SELECT product AS "Product", 'LP "' || panel_id || '"' AS "Designation", qty AS "Quantity" FROM bom WHERE include AND item_type NOT IN ('Note', 'Skipped')""")
def s6(panels, *t):
    spark, folder = panels.sparkSession, fl.shared_folder(panels.sparkSession)
    bom = bom_of(panels, *t).withColumn("designation", F.concat(F.lit('LP "'), F.col("panel_id").cast("string"), F.lit('"')))
    fl.write_bom_csv(bom, folder + "/bom")
    return fl.read_bom_csv(spark, folder + "/bom")


@query("s7_results_json_round_trip", T, "WITH " + QUOTES + """ SELECT p.job_id, b.panel_id, item_type, product, qty, notes FROM bom b JOIN panels p ON p.panel_id = b.panel_id""")
def s7(panels, *t):
    spark, folder = panels.sparkSession, fl.shared_folder(panels.sparkSession)
    fl.write_results_json(bom_of(panels, *t).join(panels.select("panel_id", "job_id"), "panel_id"), folder + "/results")
    return fl.read_results_json(spark, folder + "/results").select("job_id", "panel_id", F.explode("items").alias("i")).select("job_id", "panel_id", "i.*")


@query("r21_place_iline", "panels breakers frames pair_rules")
def r21(panels, breakers, frames, pair_rules):
    series = F.when(F.col("bus_amps") > 800, "HCR-U").when(F.col("bus_amps") > 250, "HCP").otherwise("HCJ")
    p = configured(panels).withColumns({"series": series, "spd": F.col("panel_id") % 7 == 0})
    return pl.place_iline(p, sz.usable_breakers(panels, breakers), frames, pair_rules)
