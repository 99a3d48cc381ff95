"""Every registered query against its SQL, on the smallest data set."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.cursor().execute(f"create view {f[:-8]} as select * from '{SF}/{f}'").fetchall()
    return con


def rows(table):
    cols = sorted(table.column_names)
    norm = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v
    return cols, sorted((tuple(map(norm, r)) for r in zip(*[table[c].to_pylist() for c in cols])), key=repr)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_same_rows(spark, db, name):
    got = rows(entry.queries()[name](spark, SF).toArrow())
    want = rows(db.cursor().execute(CHECKS[name]).to_arrow_table())
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["job_id", "product", "qty"]
    assert df.limit(1).count() == 1


def test_results_do_not_depend_on_partitions(spark):
    names = ["v1_dedupe_names", "m3_order_bom", "g3_nms_keep_larger", "l5_plumbline_columns", "j4_job_progress"]
    seen = {}
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        for name in names:
            seen.setdefault(name, []).append(rows(entry.queries()[name](spark, SF).toArrow()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert all(a == b for a, b in seen.values())
