"""Files in and out: detections, lines, crops, settings, job status, results."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from drawbom.session import shared_base

DETECTION_SCHEMA = ("pdf_id bigint, page_id bigint, pos int, text string, conf double, box array<array<double>>, "
                    "band_width bigint, band_height bigint, band_offset bigint")
LINE_SCHEMA = "pdf_id bigint, page_id bigint, line_no bigint, y_center bigint, x_left bigint, x_right bigint, thickness bigint"
STATUS_SCHEMA = "job_id bigint, owner_id bigint, state string, step string, progress double, ts string"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared directory."""
    return f"{shared_base(spark)}/drawbom-{os.urandom(6).hex()}"


def tokens_from_polygons(dets: DataFrame) -> DataFrame:
    """Rectangles from four-point boxes, clamped to their band and moved to the
    page by the band offset."""
    def side(i: int, limit: str):
        return F.transform("box", lambda p: F.greatest(F.lit(0), F.least(F.col(limit) - 1, p[i].cast("long"))))
    xs, ys = side(0, "band_width"), side(1, "band_height")
    return dets.filter(F.col("text") != "").select(
        "pdf_id", "page_id", "pos", "text", F.coalesce("conf", F.lit(0.0)).alias("conf"), F.array_min(xs).alias("x1"),
        (F.array_min(ys) + F.col("band_offset")).alias("y1"), F.array_max(xs).alias("x2"), (F.array_max(ys) + F.col("band_offset")).alias("y2"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return tokens_from_polygons(spark.read.schema(DETECTION_SCHEMA).json(path))


def write_lines(lines: DataFrame, path: str) -> None:
    """Ruled lines as JSON, one folder per PDF. Lines of a PDF are brought together first, else
    every task would open a file in every folder; a very large PDF still takes several tasks."""
    lines.hint("rebalance", "pdf_id").write.mode("overwrite").partitionBy("pdf_id").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINE_SCHEMA).json(path)


def list_crops(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """Rendered crops of all jobs; the image bytes are never read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
             .select("path", "length", "modificationTime"))
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.regexp_extract("path", "([^/]+)/[^/]+/[^/]+$", 1).alias("job"), "path", "length")


def read_jsonc_config(spark: SparkSession, path: str) -> DataFrame:
    """Settings files (JSON with comments) as `path, key, value`; values stay
    JSON text. Comments inside quoted text are kept."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    bare = F.regexp_replace("value", r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', "$1")
    clean = F.regexp_replace(bare, r",(\s*[}\]])", "$1")
    entries = F.from_json(clean, "map<string,string>")
    return text.select("path", F.explode(entries).alias("key", "value"))


def lexicon_patterns(settings: DataFrame) -> DataFrame:
    """Patterns in settings (`read_jsonc_config`) as `path, field, ord, pattern`, ord from 1:
    lists of text directly under a key, or under the fields of an object."""
    single = F.from_json("value", "array<string>")
    nested = F.coalesce(F.from_json("value", "map<string,array<string>>"), F.create_map("key", single))
    fields = settings.select("path", F.explode(nested).alias("field", "patterns")).filter("patterns IS NOT NULL")
    return (fields.select("path", "field", F.posexplode("patterns").alias("ord", "pattern")).filter("pattern IS NOT NULL")
            .select("path", "field", (F.col("ord") + 1).alias("ord"), "pattern"))


def read_lexicon(spark: SparkSession, path: str, limit: int = 10_000) -> list[tuple[str, int, str]]:
    """`(field, ord, pattern)` of settings files, ordered, for operators that take patterns.
    They become expressions of a plan, so more than `limit` raise an error."""
    rows = lexicon_patterns(read_jsonc_config(spark, path)).select("field", "ord", "pattern").take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} patterns below {path}")
    return sorted(tuple(r) for r in rows)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """One settings file, with a comment that names it."""
    text = f"// {path.rsplit('/', 1)[-1]}\n{json.dumps(settings, indent=1)}\n"
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_job_status(spark: SparkSession, folder: str) -> DataFrame:
    """Every readable `status.json` below a jobs folder; broken ones are left out."""
    df = (spark.read.schema(STATUS_SCHEMA).option("mode", "DROPMALFORMED").option("multiLine", "true").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", "*.json").json(folder))
    return df.filter("state IS NOT NULL")


def write_bom_csv(bom: DataFrame, path: str) -> None:
    """Included rows as Product, Designation, Quantity; quotes are doubled."""
    rows = bom.filter(F.col("include") & ~F.col("item_type").isin("Note", "Skipped"))
    (rows.select(F.col("product").alias("Product"), F.col("designation").alias("Designation"), F.col("qty").alias("Quantity"))
     .write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path))


def read_bom_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Product string, Designation string, Quantity bigint").option("header", True).option("escape", '"').csv(path)


def write_results_json(bom: DataFrame, path: str) -> None:
    """One result document per panel, one folder per job.

    The document unit is the panel: a job may hold very many panels, and no task
    ever gathers a whole job.
    """
    item = F.struct("item_type", "product", "qty", "notes")
    docs = bom.groupBy("job_id", "panel_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    docs.withColumn("job", F.col("job_id") % 64).write.mode("overwrite").partitionBy("job").json(path)


def read_results_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("job_id bigint, panel_id bigint, items array<struct<item_type:string,product:string,qty:bigint,notes:string>>").json(path)
