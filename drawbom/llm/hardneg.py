"""Hard negatives by a multiway hyperplane tree over distance ranges (GNAT).

A node holds split points; a vector belongs to the nearest, so hyperplanes part the
children. For each split point the node stores the range of its distances to every
child's vectors. A query whose wanted scores lie in a window looks for vectors in an
annulus around it; a child whose range misses what the annulus allows is eliminated.
The tree is fitted on a bounded sample, all vectors are dealt to its leaves, ranges
cover all of them, and what is left of the leaves is compared exactly, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from drawbom.llm.shared import settle

FOUND = "query long, wanted long, score long, vec_id long"
SLACK = 1e-6            # distances are doubles of integers; rounding stays far below


def quantised(rows: DataFrame, dims: int) -> DataFrame:
    """`vec_id, label, v`: components floor(256 * x) as 32-bit integers, padded with zeros."""
    def scan(batches):
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(float))
            if len(values) and np.abs(values).max() ** 2 * dims >= 2.0 ** 62:
                raise ValueError("a component is too large for 64-bit scores")
            out = np.zeros((len(sizes), dims), np.int32)
            out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes() for r in out], pa.binary())], ["vec_id", "label", "v"])
    return rows.select("vec_id", "label", "embedding").mapInArrow(scan, "vec_id long, label long, v binary")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a binary column, one a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), dims).astype(float)


def gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Distances of all rows to all split points."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * x @ centers.T, 0))


def grow(x: np.ndarray, total: int, leaf: int, fan: int, seed: int = 11) -> list[tuple[np.ndarray, list[int]]]:
    """Nodes (split points, children) from a sample of `total` vectors; a child >= 0 is a
    node, else leaf number -1 - child. Split points are taken far apart."""
    rng, nodes, leaves = np.random.default_rng(seed), [], [0]

    def node(rows: np.ndarray) -> int:
        pick = x[rng.choice(rows, min(len(rows), 3 * fan), replace=False)] if len(rows) else np.zeros((1, x.shape[1]))
        chosen, far = [0], gaps(pick, pick[:1])[:, 0]
        while len(chosen) < fan and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, gaps(pick, pick[chosen[-1:]])[:, 0])
        me, centers = len(nodes), pick[chosen]
        children: list[int] = []
        nodes.append((centers, children))
        home = gaps(x[rows], centers).argmin(1) if len(rows) else np.zeros(0, int)
        for j in range(len(chosen)):
            mine = rows[home == j]
            if len(chosen) > 1 and len(mine) >= 2 * fan and len(mine) < len(rows) and len(mine) / len(x) * total > leaf:
                children.append(node(mine))
            else:
                leaves[0] += 1
                children.append(-leaves[0])
        return me

    node(np.arange(len(x)))
    return nodes


def descend(x: np.ndarray, nodes) -> tuple[np.ndarray, np.ndarray, list]:
    """Leaf and distance to its split point of each row, and the visits (node, rows, their
    distances to its split points, their child)."""
    leaf, own, visits, todo = np.zeros(len(x), np.int64), np.zeros(len(x)), [], [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        d = gaps(x[rows], nodes[at][0])
        child = d.argmin(1)
        visits.append((at, rows, d, child))
        for j, to in enumerate(nodes[at][1]):
            mine = rows[child == j]
            if len(mine) and to >= 0:
                todo.append((to, mine))
            elif len(mine):
                leaf[mine], own[mine] = -1 - to, d[child == j, j]
    return leaf, own, visits


def dealt(points: DataFrame, nodes, dims: int) -> DataFrame:
    """points(v, label, ids) with `leaf` and `own`."""
    def scan(batches):
        for batch in batches:
            leaf, own, _ = descend(matrix(batch.column("v"), dims), nodes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(own)], [*batch.schema.names, "leaf", "own"])
    return points.mapInArrow(scan, "v binary, label long, ids array<long>, leaf long, own double")


def ranges(points: DataFrame, nodes, dims: int):
    """For each node the (least, greatest) distance of split point i to child j, over all points; and the range of squared lengths."""
    def scan(batches):
        for batch in batches:
            x = matrix(batch.column("v"), dims)
            norm = (x * x).sum(1)
            rows = [(-1, 0, 0, float(norm.min()), float(norm.max()))] if len(x) else []
            for at, _, d, child in descend(x, nodes)[2]:
                for j in np.unique(child):
                    part = d[child == j]
                    rows += [(at, i, int(j), float(a), float(b)) for i, (a, b) in enumerate(zip(part.min(0), part.max(0)))]
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "i", "j", "lo", "hi"), r)) for r in rows], pa.schema([("node", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64())]))
    table = [(np.full((len(c), len(c)), np.inf), np.full((len(c), len(c)), -np.inf)) for c, _ in nodes]
    norms = (0.0, 0.0)
    for r in points.select("v").mapInArrow(scan, "node long, i long, j long, lo double, hi double").groupBy("node", "i", "j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        if r["node"] < 0:
            norms = r["lo"], r["hi"]
        else:
            table[r["node"]][0][r["i"], r["j"]], table[r["node"]][1][r["i"], r["j"]] = r["lo"], r["hi"]
    return table, norms


def blocked(points: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Leaves cut into rings of their distances, and rings of one distance by hash, so
    that a block holds at most about twice `size` points: (directory, packed points)."""
    most = points.groupBy("leaf").agg(F.max("own").alias("most"))
    bins = points.join(most, "leaf").withColumn("bin", F.floor(F.when(F.col("most") > 0, 63 * F.col("own") / F.col("most")).otherwise(0.0)))
    sizes = bins.groupBy("leaf", "bin").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("leaf").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rings = sizes.select("leaf", "bin", F.floor(before / size).alias("ring"), F.greatest(F.lit(1), F.ceil(F.col("n") / size)).alias("cut"))
    placed = settle(bins.join(rings, ["leaf", "bin"]).select("leaf", "ring", F.pmod(F.xxhash64("v", "label"), "cut").alias("part"), "own", "v", "label", "ids"), "gnat-points")
    directory = placed.groupBy("leaf", "ring", "part").agg(F.min("own").alias("near"), F.max("own").alias("far"))
    packed = placed.groupBy("leaf", "ring", "part").agg(F.collect_list(F.struct("v", "label", "ids")).alias("points"))
    return settle(directory, "gnat-directory"), settle(packed, "gnat-blocks")


def routed(queries: DataFrame, nodes, table, norms, dims: int, home: bool) -> DataFrame:
    """`leaf, lo, hi, asked`: for every leaf not eliminated the queries that must see it, and the
    distances to its split point they allow. queries(query, v, label, windows); the
    windows (low, high) are of scores, null is open. With `home` only the query's own leaf."""
    kind = pa.list_(pa.struct([("query", pa.int64()), ("v", pa.binary()), ("label", pa.int64()), ("windows", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))]))

    def scan(batches):
        for batch in batches:
            x, rows = matrix(batch.column("v"), dims), batch.to_pylist()
            out = []
            if home:
                leaf = descend(x, nodes)[0]
                out = [(int(t), 0.0, math.inf, np.flatnonzero(leaf == t)) for t in np.unique(leaf)]
            else:
                own = (x * x).sum(1)
                width = max((len(r["windows"]) for r in rows), default=0)
                near, far = np.full((len(rows), width), np.inf), np.full((len(rows), width), -np.inf)
                for q, r in enumerate(rows):
                    for w, s in enumerate(r["windows"]):
                        near[q, w] = 0.0 if s["high"] is None else math.sqrt(max(0.0, own[q] + norms[0] - 2 * s["high"])) - SLACK
                        far[q, w] = math.inf if s["low"] is None else math.sqrt(max(0.0, own[q] + norms[1] - 2 * s["low"])) + SLACK
                todo = [(0, np.arange(len(rows)))]
                while todo:
                    at, mine = todo.pop()
                    d = gaps(x[mine], nodes[at][0])
                    # Distances to split point i that a vector inside the annulus can have.
                    least = np.maximum(np.maximum(d[:, :, None] - far[mine][:, None, :], near[mine][:, None, :] - d[:, :, None]), 0)
                    most = d[:, :, None] + far[mine][:, None, :]
                    for j, to in enumerate(nodes[at][1]):
                        lo, hi = table[at][0][:, j], table[at][1][:, j]
                        alive = ((least <= hi[None, :, None] + SLACK) & (most >= lo[None, :, None] - SLACK)).all(axis=1)
                        left = mine[alive.any(axis=1)]
                        if len(left) and to >= 0:
                            todo.append((to, left))
                        elif len(left):
                            keep = alive.any(axis=1)
                            out.append((-1 - to, float(np.where(alive, least[:, j], np.inf)[keep].min()) - SLACK, float(np.where(alive, most[:, j], -np.inf)[keep].max()) + SLACK, left))
            for leaf, lo, hi, who in out:
                asked = pa.array([[rows[q] for q in who]], kind)
                yield pa.RecordBatch.from_arrays([pa.array([leaf]), pa.array([lo]), pa.array([hi]), asked], ["leaf", "lo", "hi", "asked"])
    return queries.select("query", "v", "label", "windows").mapInArrow(scan, "leaf long, lo double, hi double, asked array<struct<query:long,v:binary,label:long,windows:array<struct<low:long,high:long>>>>")


def leaves_searched(routes: DataFrame, directory: DataFrame, packed: DataFrame, dims: int, same: bool, k: int) -> DataFrame:
    """`query, wanted, score, vec_id`: the k best rows of each query and window in what each
    task sees; `wanted` is the window's upper end. `same` asks for the query's label, else for others."""
    met = routes.join(directory, (routes["leaf"] == directory["leaf"]) & (F.col("near") <= F.col("hi")) & (F.col("far") >= F.col("lo"))).select(directory["leaf"], "ring", "part", "asked")
    pairs = met.join(packed, ["leaf", "ring", "part"]).select("asked", "points")

    def scan(batches):
        best: dict = {}

        def flush():
            rows = [(q, w, s, i) for (q, w), found in best.items() for s, i in found]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in range(4)], ["query", "wanted", "score", "vec_id"])
        for batch in batches:
            for asked, points in zip(batch.column("asked"), batch.column("points")):
                asked, points = asked.values, points.values
                x, label = matrix(points.field("v"), dims), points.field("label").to_numpy(zero_copy_only=False)
                ids, q, mine = points.field("ids"), matrix(asked.field("v"), dims), asked.field("label").to_numpy(zero_copy_only=False)
                exact = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0)) ** 2 * dims < 2.0 ** 52
                for at in range(0, len(q), 128):
                    part = q[at:at + 128]
                    scores = (part @ x.T).astype(np.int64) if exact else part.astype(np.int64) @ x.T.astype(np.int64)
                    for n, row in enumerate(scores):
                        fits = (label == mine[at + n]) == same
                        number = asked.field("query")[at + n].as_py()
                        for window in asked.field("windows")[at + n].as_py():
                            old = best.get((number, window["high"]), [])
                            lows = [b for b in (window["low"], old[-1][0] if len(old) == k else None) if b is not None]
                            ok = fits & (row >= max(lows)) if lows else fits
                            if window["high"] is not None:
                                ok = ok & (row <= window["high"])
                            here = np.flatnonzero(ok)
                            if len(here) > k:
                                here = here[row[here] >= np.partition(row[here], len(here) - k)[len(here) - k]]
                            if len(here):
                                new = [(int(row[p]), i) for p in here for i in ids[p].as_py()]
                                best[number, window["high"]] = sorted(set(old + new), key=lambda r: (-r[0], r[1]))[:k]
                if len(best) > 200_000:
                    yield flush()
        yield flush()
    found = pairs.mapInArrow(scan, FOUND)
    rank = F.row_number().over(Window.partitionBy("query", "wanted").orderBy(F.desc("score"), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   sample: int = 20_000, leaf: int = 4096, fan: int = 16, salts: int = 16) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score` from rows(vec_id,
    embedding, label); `anchors` is a condition on vec_id.

    The score is the integer inner product of floor(256 * x). Positives are the first rows
    of the anchor's label, negatives for one are the first rows of other labels with
    low * positive <= 100 * negative <= high * positive; ties go by vec_id. Rows without vec_id, with a
    null label or vector, or a null or non-finite component take no part; exact repeats
    count once, and rows that share the anchor's vec_id are not its positives. Shorter
    vectors count as padded with zeros. Equal vectors of one label are one point with its first ids, and
    anchors that share vector and label are searched once. Components too large for
    64-bit scores raise an error. The tree comes from at most `sample` vectors; all
    are in its leaves. An empty table gives no rows; extra columns are ignored.
    """
    spark = rows.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    dims = max(1, whole.agg(F.max(F.size("embedding"))).first()[0] or 0)
    each = settle(quantised(whole, dims).groupBy("vec_id", "label", "v").agg(F.count("*").alias("copies")).drop("copies"), "vectors")
    nth = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    points = settle(each.withColumn("nth", nth).filter(F.col("nth") <= max(positives + 1, negatives)).groupBy("v", "label").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("v", "label", "ids"), "vector-points")
    total = points.count()
    chosen = points.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toArrow().column("v").combine_chunks()
    nodes = grow(matrix(chosen, dims), total, leaf, fan)
    homed = settle(dealt(points, nodes, dims), "gnat-leaves")
    table, norms = ranges(homed, nodes, dims)
    directory, packed = blocked(homed, leaf)
    asked = settle(each.filter(anchors).select("v", "label").distinct().withColumn("query", F.monotonically_increasing_id()), "anchors")
    window = "array<struct<low:long,high:long>>"
    open_ = asked.withColumn("windows", F.array(F.struct(F.lit(None).alias("low"), F.lit(None).alias("high"))).cast(window))
    first = settle(leaves_searched(routed(open_, nodes, table, norms, dims, True), directory, packed, dims, True, positives + 1), "gnat-first")
    bound = first.groupBy("query").agg(F.when(F.count("*") > positives, F.min("score")).alias("low"))
    bounded = asked.join(bound, "query", "left").withColumn("windows", F.array(F.struct("low", F.lit(None).alias("high"))).cast(window))
    near = settle(leaves_searched(routed(bounded, nodes, table, norms, dims, False), directory, packed, dims, True, positives + 1), "gnat-positives")
    # Integers only: ceil(score * low / 100) and floor(score * high / 100).
    whole_low, whole_high = F.expr(f"-((-score * {low}L - pmod(-score * {low}L, 100L)) div 100L)"), F.expr(f"(score * {high}L - pmod(score * {high}L, 100L)) div 100L")
    wanted = near.select("query", whole_low.alias("low"), whole_high.alias("high")).filter("low <= high").groupBy("query").agg(F.collect_set(F.struct("low", "high")).cast(window).alias("windows"))
    far = leaves_searched(routed(asked.join(wanted, "query"), nodes, table, norms, dims, False), directory, packed, dims, False, negatives)
    negative = settle(far.groupBy("query", "wanted").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("negatives")), "gnat-negatives")
    pairs = near.select("query", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), whole_high.alias("wanted")).join(negative, ["query", "wanted"], "left")
    answers = pairs.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("positive_score")).alias("order"), "positive_id", "positive_score", "negatives"))).alias("found"))
    answers = asked.join(answers, "query").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).select("v", "label", "salt", "found")
    mine = each.filter(anchors).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    kept = mine.join(answers, ["v", "label", "salt"]).select(F.col("vec_id").alias("anchor_id"), F.explode(F.slice(F.filter("found", lambda p: p.positive_id != F.col("vec_id")), 1, positives)).alias("p"))
    return kept.select("anchor_id", "p.positive_id", "p.positive_score", F.explode("p.negatives").alias("n")).select(
        "anchor_id", "positive_id", "n.rank", "n.negative_id", "positive_score", "n.negative_score")
