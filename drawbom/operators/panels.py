"""Panel assembly: names, attribute merge, validation, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.functions.electrical import VOLTAGES, valid_bus_amp
from drawbom.operators.rules.sizing import MAX_AMPS, MIN_AMPS
from drawbom.operators.spread import numbered


def dedupe_names(panels: DataFrame) -> DataFrame:
    """`LP-1`, `LP-1 (2)`, ... per job in panel order, ignoring case.

    The ordinal comes from a prefix scan, so a job (or one name) that holds a third
    of all panels is numbered by many tasks.
    """
    base = F.coalesce(F.nullif(F.trim("raw_name"), F.lit("")), F.lit("(unnamed)"))
    df = panels.withColumn("_base", base).withColumn("_key", F.upper("_base"))
    out = numbered(df, ["job_id", "_key"], [F.col("ord")], "_n")
    name = F.when(F.col("_n") == 1, F.col("_base")).otherwise(
        F.concat("_base", F.lit(" ("), F.col("_n").cast("string"), F.lit(")")))
    return out.withColumn("name", name).drop("_base", "_key", "_n")


def coalesce_panel_keys(header: DataFrame, analyzer: DataFrame, parser: DataFrame) -> DataFrame:
    """First usable value per key: header reading, then analyzer; the spaces
    come from the table reading. Empty text and zero do not count as values."""
    keys = {"name": F.lit(""), "voltage": F.lit(0), "bus_amps": F.lit(0), "main_amps": F.lit(0)}
    second = analyzer.select("panel_id", *[F.col(k).alias(f"_{k}") for k in keys])
    joined = header.join(second, "panel_id", "left").join(parser.select("panel_id", "spaces"), "panel_id", "left")
    return joined.select("panel_id", *[F.coalesce(F.nullif(k, empty), F.col(f"_{k}")).alias(k) for k, empty in keys.items()],
                         "spaces")


def validate_panels(panels: DataFrame) -> DataFrame:
    """Adds `status`; an invalid panel keeps its name and loses its attributes."""
    bad = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("voltage").isin(*VOLTAGES), F.lit(False)), "voltage"),
        F.when(~valid_bus_amp(F.col("bus_amps")), "bus"),
        F.when(F.col("main_amps").isNotNull() & ~valid_bus_amp(F.col("main_amps")), "main"),
        F.when(~F.coalesce(F.col("spaces") > 0, F.lit(False)), "spaces")))
    out = panels.withColumn("_bad", bad)
    masked = {c: F.when(F.size("_bad") == 0, F.col(c)) for c in ("voltage", "bus_amps", "main_amps", "int_rating", "spaces")}
    status = F.when(F.size("_bad") == 0, "ok").otherwise(F.concat(F.lit("invalid "), F.array_join("_bad", ", ")))
    return out.withColumn("status", status).withColumns(masked).drop("_bad")


def merge_components(header: DataFrame, table: DataFrame) -> DataFrame:
    """Attributes of both readings; the table reading decides the spaces."""
    t = table.select("panel_id", F.col("spaces").alias("_t"))
    return (header.join(t, "panel_id", "full_outer").withColumn("spaces", F.coalesce("_t", "spaces")).drop("_t"))


def merge_breakers(header_breakers: DataFrame, table_breakers: DataFrame) -> DataFrame:
    return (header_breakers.withColumn("source", F.lit("header"))
            .unionByName(table_breakers.withColumn("source", F.lit("table"))))


def bad_breaker(amps: Column, limit: Column) -> Column:
    return amps.isNull() | ~amps.between(MIN_AMPS, MAX_AMPS) | F.coalesce((limit > 0) & (amps > limit), F.lit(False))


def count_strikes(panels: DataFrame, breakers: DataFrame) -> DataFrame:
    """Breakers per panel that could not be used, repeats counted."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    limit = panels.select("panel_id", F.coalesce(positive("main_amps"), positive("bus_amps")).alias("_limit"))
    rows = breakers.join(limit, "panel_id")
    strikes = F.sum(F.when(bad_breaker(F.col("amperage"), F.col("_limit")), F.greatest(F.lit(1), F.coalesce("cnt", F.lit(1)))).otherwise(0))
    return rows.groupBy("panel_id").agg(strikes.cast("long").alias("strikes"))


def suppress_bad_panels(panels: DataFrame, breakers: DataFrame, strikes: int = 2) -> tuple[DataFrame, DataFrame]:
    """Panels with their strike count and flag, and the breakers that remain.

    From `strikes` unusable breakers on, no breaker of the panel is trusted.
    """
    counted = panels.join(count_strikes(panels, breakers), "panel_id", "left").withColumn(
        "strikes", F.coalesce("strikes", F.lit(0).cast("long")))
    flagged = counted.withColumn("breaker_data_suppressed", F.col("strikes") >= strikes)
    note = F.concat(F.lit("No breakers supplied: "), F.col("strikes").cast("string"), F.lit(" breaker(s) failed validation"))
    flagged = flagged.withColumn("suppress_note", F.when(F.col("breaker_data_suppressed"), note))
    gone = flagged.filter("breaker_data_suppressed").select("panel_id")
    return flagged, breakers.join(gone, "panel_id", "left_anti")


def isolate_failures(df: DataFrame, checks: dict[str, tuple[Column, str]]) -> DataFrame:
    """Evaluate each checked column without raising; the first null result of a
    row marks the row as skipped with that check's reason."""
    out = df.withColumns({name: value for name, (value, _) in checks.items()})
    reason = F.coalesce(*[F.when(F.col(name).isNull(), text) for name, (_, text) in checks.items()])
    return out.withColumn("skip_reason", reason).withColumn("skipped", F.col("skip_reason").isNotNull())
