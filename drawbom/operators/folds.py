"""Greedy, order-dependent folds over sorted positions.

Before anything is gathered, rows are reduced to distinct positions and cut
into islands at gaps that no fold can bridge. What is folded is therefore one
island of distinct integer positions, bounded by the raster height of a page
and not by the number of rows on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.operators.spread import along, near_by


def islands(df: DataFrame, keys: list[str], pos: str, gap: int, out: str = "island") -> DataFrame:
    """Number the stretches of positions that are closer than `gap`."""
    def starts(rows: DataFrame, run) -> DataFrame:
        return near_by(F.col(pos), prev="_prev")(rows, run).withColumn(
            "_start", F.when(F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") >= gap), 1).otherwise(0).cast("long"))
    return along(df, keys, [F.col(pos)], starts, lambda rows, run: run(rows, {out: ("sum", F.col("_start"), True)})).drop("_prev", "_start")


def keep_apart(df: DataFrame, keys: list[str], pos: str, gap: int) -> DataFrame:
    """Positions kept when each must lie at least `gap` after the last kept one."""
    cut = islands(df.select(*keys, pos).distinct(), keys, pos, gap)

    def step(acc: Column, x: Column) -> Column:
        return F.when(x - F.element_at(acc, -1) >= gap, F.concat(acc, F.array(x))).otherwise(acc)

    xs = F.array_sort(F.collect_list(pos))
    folded = cut.groupBy(*keys, "island").agg(xs.alias("_xs"))
    kept = F.aggregate(F.slice("_xs", 2, F.greatest(F.size("_xs") - 1, F.lit(0))), F.slice("_xs", 1, 1), step)
    return folded.select(*keys, F.explode(kept).alias(pos))
