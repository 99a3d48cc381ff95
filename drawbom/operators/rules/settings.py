"""Layered settings and attribute defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.sources.catalogs import SETTING_ALIASES

DEFAULT_KA = 22


def canonical_key(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in SETTING_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, c), c)


def resolve_settings(items: DataFrame, layers: DataFrame, defaults: DataFrame) -> DataFrame:
    """Effective value per item and key.

    `items(item_id, job_id, domain)`; `layers(scope, scope_id, domain, key,
    value, ord)`. Later layers win: built-in, job for all domains, job for this
    domain, item for all domains, item for this domain; inside a layer the last
    entry wins. The layers are unioned and reduced with one partial aggregate.
    """
    layers = layers.withColumn("key", canonical_key(F.col("key"))).withColumnRenamed("domain", "layer_domain")

    def level(scope: str, id_col: str, base: int) -> DataFrame:
        side = layers.filter(F.col("scope") == scope).drop("scope").withColumnRenamed("scope_id", id_col)
        # the last entry per scope, domain and key, before it meets the items
        side = side.groupBy(id_col, "layer_domain", "key").agg(F.max_by("value", "ord").alias("value"))
        hit = items.join(side, id_col).filter((F.col("layer_domain") == "*") | (F.col("layer_domain") == F.col("domain")))
        rank = F.lit(base) + (F.col("layer_domain") != "*").cast("int")
        return hit.select("item_id", "domain", "key", "value", rank.alias("rank"))

    built_in = items.join(defaults, "domain").select("item_id", "domain", "key", "value", F.lit(0).alias("rank"))
    return (built_in.unionByName(level("job", "job_id", 1)).unionByName(level("item", "item_id", 3))
            .groupBy("item_id", "domain", "key").agg(F.max_by("value", "rank").alias("value")))


def default_int_rating(panels: DataFrame, default: int = DEFAULT_KA) -> DataFrame:
    note = F.when(F.col("int_rating").isNull(), f"No interrupting rating detected - system defaulted to {default}kAIC")
    return panels.withColumn("rating_note", note).withColumn("int_rating", F.coalesce("int_rating", F.lit(default)))


def require_attrs(panels: DataFrame) -> DataFrame:
    """Panels with the text of the skip reason, null when nothing is missing.

    A 120 V panel without surge device may become a load centre and then needs
    no interrupting rating.
    """
    small = (F.col("voltage") == 120) & ~F.coalesce("spd", F.lit(False))
    missing = F.array_compact(F.array(
        F.when(F.col("bus_amps").isNull(), "amperage"), F.when(F.col("voltage").isNull(), "voltage"),
        F.when(F.col("spaces").isNull(), "spaces"),
        F.when(F.col("int_rating").isNull() & ~F.coalesce(small, F.lit(False)), "intRating")))
    return panels.withColumn("skip_reason", F.when(
        F.size(missing) > 0, F.concat(F.lit("Missing required attributes: "), F.array_join(missing, ", "))))
