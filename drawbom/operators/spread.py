"""Ordered computations that never put one large key into one task.

A window partitioned by `page_id` sends a page that holds a third of the corpus to a
single task. So only keys of at most `HOT` rows go through windows (`along`); the rows of
larger keys go through a parallel prefix scan: one range exchange by (keys, order) cuts
them into stretches of about `STRETCH` rows at quantiles, wherever keys begin or end; each
stretch sums up its first and last key in one row; the rows of earlier stretches give each
stretch what it starts with. Both steps read the same written stretches, so a scan costs
one read of its input and one shuffle.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from drawbom.session import shared_base

BACKWARD = ("min_ahead", "next")
PLACE = "_at"
HOT = 200_000        # rows of one key that a window may take
STRETCH = 250_000    # rows of one stretch of a scan


def held(df: DataFrame, **options) -> DataFrame:
    """A table in the shared folder of what several later steps read."""
    spark = df.sparkSession
    path = f"{shared_base(spark)}/held-{os.urandom(6).hex()}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A written table for a join: sent to every task while it has at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ordered(df: DataFrame, keys: list[str], order: list[Column], rows: int = 0) -> DataFrame:
    """Equal stretches of the order, each sorted; with a total order no stretch is hot.
    With the number of `rows` given, there are as many as keep each within `STRETCH`.

    The stretches are a table with the place `_at` of every row: whoever reads them gets
    the same cuts, which two runs of one exchange need not have. A file is one row group,
    so a stretch is read by one task.
    """
    by, n = [*map(F.col, keys), *order], max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // STRETCH))
    return held(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(PLACE, F.monotonically_increasing_id()), **{"parquet.block.size": 1 << 30})


def key_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row has another key than the row before."""
    out = np.zeros(len(table), bool)
    out[:1] = True
    for k in keys:
        column = table[k].combine_chunks()
        one, two = column.slice(1), column.slice(0, max(len(column) - 1, 0))
        differ = pc.or_(pc.fill_null(pc.not_equal(one, two), False), pc.xor(pc.is_null(one), pc.is_null(two)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def scanned(kind: str, values: pa.Array, starts: np.ndarray, inclusive: bool) -> pa.Array:
    """Sums, extremes or last non-null values from the start of each key to each row; the
    BACKWARD kinds from the end of the key."""
    n = len(values)
    if kind in BACKWARD:
        ends = np.append(starts[1:], True)[::-1]
        turned = scanned({"min_ahead": "min", "next": "last"}[kind], values.take(pa.array(np.arange(n)[::-1])), ends, inclusive)
        return turned.take(pa.array(np.arange(n)[::-1]))
    at, valid = np.arange(n), values.is_valid().to_numpy(zero_copy_only=False)
    first = np.maximum.accumulate(np.where(starts, at, 0))
    if kind == "sum":
        v = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        if v.dtype.kind == "f":
            sums = np.concatenate([np.cumsum(part) for part in np.split(v, np.flatnonzero(starts)[1:])]) if n else v
        else:
            sums = np.cumsum(v)
            sums = sums - (sums[first] - v[first])
        return pa.array(sums if inclusive else sums - v, values.type)
    if kind == "last":
        best = np.maximum.accumulate(np.where(valid, at, -1))
    else:
        v = values.to_numpy(zero_copy_only=False)
        by_size = np.argsort(np.where(valid, v, -np.inf if kind == "max" else np.inf), kind="stable")
        by_size = by_size if kind == "max" else by_size[::-1]
        size = np.empty(n, np.int64)
        size[by_size] = at
        size[~valid] = -1
        segment = np.cumsum(starts) * (n + 1)
        top = np.maximum.accumulate(segment + size) - segment
        best = np.where(top >= 0, by_size[np.maximum(top, 0)], -1)
    if not inclusive:
        best = np.where(starts, -1, np.concatenate([[-1], best[:-1]]))
    best = np.where(best >= first, best, -1)
    return values.take(pa.array(best, mask=best < 0))


def scan(df: DataFrame, keys: list[str], specs: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Add running results along the stretches of `ordered`; scans can follow each other
    without a new exchange.

    `specs` maps an output name to (kind, value, inclusive) with kind one of sum, max,
    min, last, min_ahead, next. Exclusive results leave out the row itself; min_ahead and next
    look at later rows instead. A task holds one stretch.
    """
    kinds = {n: (kind, inclusive) for n, (kind, _, inclusive) in specs.items()}
    marked = df.withColumns({f"_v_{n}": v for n, (_, v, _) in specs.items()})
    value_types = {n: marked.schema[f"_v_{n}"].dataType for n in specs}
    names = df.columns

    def stretches(batches):
        """Rows of neighbouring places, as tables; only one stretch is held at a time."""
        held_back, after = [], None
        for b in batches:
            at = b.column(PLACE).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)] if len(at) else []
            for x, y in zip(cuts, cuts[1:]):
                if held_back and at[x] != after:
                    yield pa.Table.from_batches(held_back)
                    held_back = []
                held_back.append(b.slice(x, y - x))
                after = at[y - 1] + 1
        if held_back:
            yield pa.Table.from_batches(held_back)

    def summary(batches):
        for table in stretches(batches):
            starts = np.flatnonzero(key_starts(table, keys))
            stop = starts[1] if len(starts) > 1 else len(table)
            row = {f"f{i}": table[k].slice(0, 1) for i, k in enumerate(keys)} | {f"l{i}": table[k].slice(len(table) - 1) for i, k in enumerate(keys)}
            for n, (kind, _) in kinds.items():
                part = table[f"_v_{n}"].combine_chunks()
                part = part.slice(0, stop) if kind in BACKWARD else part.slice(starts[-1])
                total = scanned(kind, part, np.arange(len(part)) == 0, True)
                row[n] = total.slice(0 if kind in BACKWARD else len(total) - 1, 1)
            note = pa.table({**row, "whole": pa.array([len(starts) == 1])})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, note.schema) as out:
                out.write_table(note)
            yield pa.RecordBatch.from_arrays([table[PLACE].slice(0, 1).combine_chunks(), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["place", "note"])

    def carried(notes: dict, table) -> dict[str, pa.Array]:
        """What the neighbouring stretches hold of this one's first key (last key, backward), in order."""
        here, out = table[PLACE][0].as_py(), {}
        for back in (False, True):
            mine = [table[k][len(table) - 1 if back else 0].as_py() for k in keys]
            met = []
            for p in sorted((p for p in notes if (p > here if back else p < here)), reverse=not back):
                note = notes[p] = notes[p] if isinstance(notes[p], pa.Table) else pa.ipc.open_stream(notes[p]).read_all()
                if [note[f"{'f' if back else 'l'}{i}"][0].as_py() for i in range(len(keys))] != mine:
                    break
                met.append(note)
                if not note["whole"][0].as_py():
                    break
            for n, (kind, _) in kinds.items():
                if met and (kind in BACKWARD) == back:
                    out[n] = pa.concat_arrays([m[n].combine_chunks() for m in (met if back else met[::-1])])
        return out

    def apply(batches):
        notes: dict = {}
        for table in stretches(batches):
            notes |= {r["place"]: r["note"] for r in table["_notes"][0].as_py() or []}
            starts, known = key_starts(table, keys), carried(notes, table)
            columns = [table[c] for c in names]
            for n, (kind, inclusive) in kinds.items():
                values, first = table[f"_v_{n}"].combine_chunks(), starts
                size, before = len(values), known.get(n)
                if before is not None and kind in BACKWARD:
                    values, first = pa.concat_arrays([values, before.cast(values.type)]), np.append(starts, np.zeros(len(before), bool))
                elif before is not None:
                    values = pa.concat_arrays([before.cast(values.type), values])
                    first = np.concatenate([np.arange(len(before)) == 0, [False], starts[1:]])
                result = scanned(kind, values, first, inclusive)
                columns.append(result.slice(0 if kind in BACKWARD or before is None else len(before), size))
            yield from pa.table(columns, [*names, *kinds]).combine_chunks().to_batches(max_chunksize=10_000)

    lean = marked.select(PLACE, *keys, *[f"_v_{n}" for n in specs])
    notes = lean.mapInArrow(summary, "place long, note binary").agg(F.collect_list(F.struct("place", "note")).alias("notes"))
    opens = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    schema = StructType([*df.schema.fields, *(StructField(n, t) for n, t in value_types.items())])
    return marked.withColumn("_notes", F.when(opens, notes.scalar())).mapInArrow(apply, schema)


def windowed(df: DataFrame, keys: list[str], order: list[Column], specs: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """What `scan` gives, by windows: for keys whose rows fit one task."""
    ahead = Window.partitionBy(*keys).orderBy(*order)
    back = Window.partitionBy(*keys).orderBy(F.col("_nth").desc())
    names = [*df.columns, *specs]
    if any(kind in BACKWARD for kind, _, _ in specs.values()):
        df = df.withColumn("_nth", F.row_number().over(ahead))

    def result(kind: str, value: Column, inclusive: bool) -> Column:
        frame = (back if kind in BACKWARD else ahead).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if kind == "sum":
            of = df.select(value.alias("v")).schema["v"].dataType
            zero = F.lit(0).cast(of)
            return F.coalesce(F.sum(F.coalesce(value, zero)).over(frame), zero).cast(of)
        return {"max": F.max, "min": F.min, "min_ahead": F.min}.get(kind, lambda c: F.last(c, ignorenulls=True))(value).over(frame)
    return df.withColumns({n: result(*spec) for n, spec in specs.items()}).select(*names)


def by_size(df: DataFrame, keys: list[str], small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame, int], DataFrame],
            sizes: DataFrame | None = None) -> DataFrame:
    """`small` of the rows whose first key has at most `HOT` rows, with `large` of the others,
    which also gets their number. Rows are counted in `sizes`, a table that holds at least the
    keys of `df` and is cheaper to read, if given."""
    if not keys:
        return large(df, (df if sizes is None else sizes).count())
    key = keys[0]
    hot = held((df if sizes is None else sizes).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HOT))
    rows = hot.agg(F.sum("_rows")).first()[0]
    if rows is None:
        return small(df)
    same, names = F.col(key).eqNullSafe(F.col("_hot")), hot.select("_hot")
    return small(df.join(names, same, "left_anti")).unionByName(large(df.join(names, same, "left_semi"), rows))


def along(df: DataFrame, keys: list[str], order: list[Column], *steps: Callable, sizes: DataFrame | None = None) -> DataFrame:
    """Steps along one order of every key: each is a function of the rows and of `run`, and
    `run(rows, specs)` adds running results as in `scan`. Small keys go through windows."""
    def small(part: DataFrame) -> DataFrame:
        for step in steps:
            part = step(part, lambda d, specs: windowed(d, keys, order, specs))
        return part

    def large(part: DataFrame, rows: int) -> DataFrame:
        part = ordered(part, keys, order, rows)
        for step in steps:
            part = step(part, lambda d, specs: scan(d, keys, specs))
        return part.drop(PLACE)
    return by_size(df, keys, small, large, sizes)


def running(df: DataFrame, keys: list[str], order: list[Column], specs: dict[str, tuple[str, Column, bool]], sizes: DataFrame | None = None) -> DataFrame:
    """Add running sums, extremes or last non-null values along `order`, as in `scan`."""
    return along(df, keys, order, lambda d, run: run(d, specs), sizes=sizes)


def near_by(value: Column, prev: str | None = None, nxt: str | None = None) -> Callable:
    """A step that adds the previous and/or next value.

    Values travel in a struct, so that a neighbour that is null differs from none.
    """
    held = F.struct(value.alias("v"))
    specs = ({prev: ("last", held, False)} if prev else {}) | ({nxt: ("next", held, False)} if nxt else {})
    return lambda df, run: run(df, specs).withColumns({n: F.col(n)["v"] for n in specs})


def beside(df: DataFrame, keys: list[str], value: Column, prev: str | None = None, nxt: str | None = None) -> DataFrame:
    """Add the previous and/or next value along the stretches of `ordered`."""
    return near_by(value, prev, nxt)(df, lambda d, specs: scan(d, keys, specs))


def neighbours(df: DataFrame, keys: list[str], order: list[Column], value: Column, prev: str | None = None, nxt: str | None = None) -> DataFrame:
    """Add the previous and/or next value of `value` along `order`."""
    return along(df, keys, order, near_by(value, prev, nxt))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, sizes: DataFrame | None = None) -> DataFrame:
    """row_number() along a total order."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"), True)}, sizes)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key. The rank limit is applied before the shuffle
    (WindowGroupLimit), so a hot key sends one row per map task."""
    return top_per(df, keys, order, 1)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def one_of(column: Column, values) -> Column:
    return column.isin(*values)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)
