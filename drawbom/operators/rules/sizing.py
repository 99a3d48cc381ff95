"""Breaker validation, next-size-up, frames, spaces and family choice.

Ladders are folded to one array per family, so the next size is found inside
the row: the only join is an equi-join with a tiny side, and no row multiplies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_AMPS, MAX_AMPS = 15, 1200
BASE_KA = {"QO": 10, "QOB": 10, "QO-VH": 22, "QOB-VH": 22, "QOH": 42, "QH": 65, "QHB": 65}
SUPPORTED_POLES = {"QOH": (1, 2)}        # all other bases take 1, 2 or 3 poles
SPACE_INCHES = 1.5


def rating_voltage(v: Column) -> Column:
    return F.when(v == 208, 240).otherwise(v)


def validate_breakers(breakers: DataFrame) -> DataFrame:
    """Adds `reject_note`, null for a usable breaker."""
    poles, amps, cnt = F.col("poles"), F.col("amperage"), F.col("cnt")
    bad = F.array_compact(F.array(F.when(~F.coalesce(poles.isin(1, 2, 3), F.lit(False)), "poles"),
                                  F.when(~F.coalesce(amps > 0, F.lit(False)), "amperage"),
                                  F.when(~F.coalesce(cnt > 0, F.lit(False)), "count")))
    note = (F.when(F.size(bad) > 0, F.concat(F.lit("missing or invalid "), F.array_join(bad, ", ")))
            .when(~amps.between(MIN_AMPS, MAX_AMPS), F.concat(amps.cast("string"), F.lit("A outside 15-1200A"))))
    return breakers.withColumn("reject_note", note)


def coalesce_breakers(breakers: DataFrame) -> DataFrame:
    return (breakers.groupBy("panel_id", "poles", "amperage", "special_features")
            .agg(F.sum("cnt").cast("long").alias("cnt")))


def panel_limit(bus: Column, main: Column) -> Column:
    return F.when(F.coalesce(main, F.lit(0)) == 0, bus).otherwise(F.least(bus, main))


def reject_over_limit(panels: DataFrame, breakers: DataFrame) -> DataFrame:
    """Adds the panel limit and whether the breaker exceeds it."""
    limits = panels.select("panel_id", panel_limit(F.col("bus_amps"), F.col("main_amps")).alias("limit_amps"))
    over = F.coalesce((F.col("limit_amps") > 0) & (F.col("amperage") > F.col("limit_amps")), F.lit(False))
    return breakers.join(limits, "panel_id").withColumn("over_limit", over)


def panels_for_review(limited: DataFrame) -> DataFrame:
    return limited.groupBy("panel_id").agg(F.bool_or("over_limit").alias("needs_user_review"))


def usable_breakers(panels: DataFrame, breakers: DataFrame) -> DataFrame:
    """Valid, merged breakers within the limit of their panel."""
    valid = validate_breakers(breakers).filter("reject_note IS NULL")
    limited = reject_over_limit(panels, coalesce_breakers(valid)).filter(~F.col("over_limit"))
    return limited.select("panel_id", "poles", "amperage", "special_features", "cnt")


def ladder_arrays(ladder: DataFrame, keys: list[str], value: str = "rating") -> DataFrame:
    """One sorted array of ratings per family; catalogs only, hence bounded."""
    return ladder.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("ratings"))


def next_size(ratings: Column, wanted: Column, over: str = "null") -> Column:
    """First rating at or above `wanted`; above all, null or the largest."""
    up = F.get(F.filter(ratings, lambda r: r >= wanted), F.lit(0))
    return F.coalesce(up, F.array_max(ratings)) if over == "max" else up


def snap_up(df: DataFrame, ladder: DataFrame, value: str, on: list[str], out: str = "snapped",
            over: str = "null") -> DataFrame:
    arrays = ladder_arrays(ladder, on)
    return (df.join(arrays, on, "left").withColumn(out, next_size(F.col("ratings"), F.col(value), over))
            .drop("ratings"))


def frame_options(frames: DataFrame) -> DataFrame:
    """Per pole count, the frames in search order with their ladders."""
    one = (frames.groupBy("poles", "ord", "frame", "width", "max_volts")
           .agg(F.array_sort(F.collect_set("rating")).alias("ratings")))
    return one.groupBy("poles").agg(
        F.array_sort(F.collect_list(F.struct("ord", "frame", "width", "max_volts", "ratings"))).alias("options"))


def first_fit_frame(breakers: DataFrame, frames: DataFrame) -> DataFrame:
    """First frame whose voltage, poles and ladder take the breaker.

    Needs `voltage`; adds frame, width and the rating of that frame, null when
    nothing fits.
    """
    v = rating_voltage(F.col("voltage"))
    fits = F.filter("options", lambda o: (o["max_volts"] >= v) & (F.array_max(o["ratings"]) >= F.col("amperage")))
    hit = F.get(fits, F.lit(0))
    return (breakers.join(frame_options(frames), "poles", "left").withColumn("_hit", hit)
            .withColumns({"frame": F.col("_hit.frame"), "width": F.col("_hit.width"),
                          "frame_amps": next_size(F.col("_hit.ratings"), F.col("amperage"))})
            .drop("options", "_hit"))


def required_spaces(panels: DataFrame, breakers: DataFrame, frames: DataFrame) -> DataFrame:
    """Slots, estimated inches as spaces, the smaller positive need, overflow."""
    volts = panels.select("panel_id", "voltage")
    sized = first_fit_frame(breakers.join(volts, "panel_id"), frames)
    need = sized.groupBy("panel_id").agg(
        F.sum(F.col("poles") * F.col("cnt")).cast("long").alias("slots"),
        F.ceil(F.coalesce(F.sum(F.when(F.col("poles") >= 2, F.col("width") * F.col("cnt"))), F.lit(0.0)) / SPACE_INCHES)
        .cast("long").alias("frame_spaces"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    smallest = F.coalesce(F.least(F.nullif("slots", F.lit(0)), F.nullif("frame_spaces", F.lit(0))), F.lit(0).cast("long"))
    out = panels.join(need, "panel_id", "left").withColumns({"slots": zero("slots"), "frame_spaces": zero("frame_spaces")})
    out = out.withColumn("needed", smallest)
    return out.withColumn("overflow", F.when((F.col("spaces") > 0) & (F.col("needed") > F.col("spaces")),
                                             F.col("needed") - F.col("spaces")).otherwise(0).cast("long"))


def choose_base_family(ka: Column, volts: Column, plug_on: Column, series_rated: Column, poles: Column) -> Column:
    """Branch breaker base from the rating wanted at 240 V."""
    plain = F.when(plug_on, "QO").otherwise("QOB")
    base = (F.when(ka >= 65, "QH").when(ka >= 42, "QOH").when(volts.isin(208, 240) & (ka >= 25), "QH")
            .when(ka >= 22, F.concat(plain, F.lit("-VH"))).otherwise(plain))
    base = F.when((base == "QOH") & ~poles.isin(*SUPPORTED_POLES["QOH"]), "QH").otherwise(base)
    return F.when(series_rated, plain).otherwise(base)


def family_screen(panels: DataFrame, breakers: DataFrame, ladder: DataFrame) -> DataFrame:
    """Whether every breaker of the panel could sit in an NQ or NF interior.

    Needs `voltage, int_rating, plug_on, series_rated` on the panels; a panel
    without breakers allows both.
    """
    p = panels.select("panel_id", "voltage", "int_rating", "plug_on", "series_rated")
    rows = breakers.join(p, "panel_id").withColumn("family", choose_base_family(
        F.col("int_rating"), F.col("voltage"), F.col("plug_on"), F.col("series_rated"), F.col("poles")))
    rows = snap_up(rows, ladder, "amperage", ["family", "poles"], "nq_amps")
    nq = (rating_voltage(F.col("voltage")) <= 240) & F.col("nq_amps").isNotNull()
    nf = F.col("amperage").between(15, F.when(F.col("poles") == 1, 70).otherwise(125)) & F.col("poles").isin(1, 2, 3)
    flags = rows.groupBy("panel_id").agg(F.bool_and(nq).alias("allow_nq"), F.bool_and(nf).alias("allow_nf"))
    return (panels.join(flags, "panel_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(True)) for c in ("allow_nq", "allow_nf")}))


def largest_branch(breakers: DataFrame) -> DataFrame:
    return breakers.groupBy("panel_id").agg(F.max("amperage").alias("largest_amps"))


def int_rating_arrays(int_ratings: DataFrame) -> DataFrame:
    return ladder_arrays(int_ratings, ["frame", "voltage"], "ka")


def allowed_pairs(requests: DataFrame, pair_rules: DataFrame) -> DataFrame:
    """Canonical phase pairs for `frame, letter, amps`; AB rather than BA when
    both are made; a request without rules may use any pair."""
    canon = lambda c: F.when(c.isin("AB", "BA"), "AB").when(c.isin("AC", "CA"), "AC").otherwise("BC")
    prefer = (pair_rules.withColumn("canon", canon(F.col("pair")))
              .groupBy("frame", "letter", "amps", "canon").agg(F.min("pair").alias("pair")))
    pairs = prefer.groupBy("frame", "letter", "amps").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("canon", "pair"))), lambda s: s["pair"]).alias("pairs"))
    anything = F.array(F.lit("AB"), F.lit("BC"), F.lit("AC"))
    return (requests.join(pairs, ["frame", "letter", "amps"], "left")
            .withColumn("pairs", F.coalesce("pairs", anything)))
