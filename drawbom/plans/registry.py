"""Registered queries: a name, a Spark plan and, where possible, checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from drawbom.sources.derived import table, with_tables

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None, extra: str = ""):
    """Register `fn(*tables)`; `sql` sees the same tables by name."""
    def wrap(fn):
        names = tables.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[table(spark, sf_dir, n) for n in names])

        run.__name__ = name
        PLANS[name] = run
        if sql is not None:
            CHECKS[name] = with_tables(f"{tables} {extra}", sql)
        return fn
    return wrap
