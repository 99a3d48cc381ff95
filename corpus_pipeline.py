"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it was
given; the last returns packed pieces. Stages keep extra columns and handle what the
operators handle: null, empty and very long texts, repeated rows, empty tables. Rows
without doc_id pass the near-duplicate stage, as nothing can refer to them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from drawbom.llm import decontaminate, langid, packing, pii, simhash
from drawbom.llm.shared import settle


def carried(docs: DataFrame, *names: str) -> DataFrame:
    """The columns `names` with the whole row beside them, so that no extra column clashes."""
    return docs.select(*names, F.struct(*docs.columns).alias("row"))


SENT = 64 << 20     # bytes of keys that are sent to every task


def without(rows: DataFrame, key: str, dropped: DataFrame, width: int) -> DataFrame:
    """The rows whose key is not in the settled table `dropped`. Keys of about `width` bytes go to
    every task while they fit `SENT`, so that no text is shuffled; more meet the rows in an exchange."""
    return rows.join(F.broadcast(dropped) if dropped.count() * width <= SENT else dropped, key, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised; learns from those outside its held-out part."""
    model = langid.fit(docs.filter(~langid.held_out("doc_id", 4, 2)).select("doc_id", "lang", "text"))
    return langid.identify(carried(docs, "text"), model).filter("accepted").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that with the smallest doc_id; of its
    repeated rows one."""
    named = docs.filter("doc_id IS NOT NULL")
    own = F.coalesce(F.bool_or(F.col("doc_id") == F.col("component_id")), F.lit(False))
    told = simhash.near_duplicates(named).groupBy("doc_id").agg(own.alias("kept"), F.count("*").alias("n"))
    ids = settle(told.filter("NOT kept OR n > 1"), "not-once")
    left = without(carried(named, "doc_id", "text"), "doc_id", ids.filter("NOT kept").select("doc_id"), 24)
    repeated = ids.filter("kept").select("doc_id")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    first = left.join(repeated, "doc_id", "left_semi").withColumn("nth", nth).filter("nth = 1").select("row.*")
    once = without(left, "doc_id", repeated, 24).select("row.*")
    return (once if repeated.isEmpty() else once.unionByName(first)).unionByName(docs.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold benchmark passages, row by row: the verdict follows from
    the text alone, so a digest of the text names it whatever the doc_id, null or repeated.
    Null texts stay; they meet no digest, and doc_id spreads them."""
    digest = F.sha2("text", 256)
    judged = decontaminate.contamination(docs.select(digest.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dropped = settle(judged.filter("contaminated").select(F.col("doc_id").alias("digest")).distinct(), "contaminated")
    own = F.coalesce(digest, F.xxhash64("doc_id").cast("string"))
    return without(docs.select(own.alias("digest"), F.struct(*docs.columns).alias("row")), "digest", dropped, 128).select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; `n_chars`, where present, follows."""
    texts = carried(docs, "text")
    out = pii.redact(texts, pii.fit(pii.candidates(docs.select("text"))))
    length = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": length}
    return out.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col(f"row.`{f.name}`")).alias(f.name) for f in docs.schema])


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("best-fit packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out = settle(stage(spark, out, sf_dir), name.replace(" ", "-"))
    return out
