"""SimHash fingerprints and near-duplicate groups by covering locality-sensitive hashing.

A fingerprint holds 64 majority bits over the shingle hashes of a text. Bit i gets a
non-zero vector m(i) of radius + 1 bits, and table v keeps the bits whose vector has
an odd product with v. Any `radius` vectors miss some v altogether, so two
fingerprints that differ in at most `radius` bits agree in at least one of the
2 ** (radius + 1) - 1 tables: no pair within the radius is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from drawbom.llm.shared import bytes_of, settle

BITS = 64


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> bytes:
    """Eight bytes: bit set where more than half of the shingle hashes have it."""
    parts = text.lower().split()
    if not parts:
        return bytes(8)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[:len(parts) - k + 1].tolist(), ends[k - 1:].tolist())])
    votes = np.zeros(BITS, np.int64)
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 4096):
        votes += np.unpackbits(rows[at:at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(rows)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """`doc_id, fp` (fp as a signed long) of whole texts."""
    def scan(batches):
        for batch in batches:
            fps = [int.from_bytes(fingerprint(t.as_py(), words), "big", signed=True) for t in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])
    return docs.select("doc_id", bytes_of().alias("raw")).mapInArrow(scan, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The bits that each table keeps."""
    size = (1 << radius + 1) - 1
    odd = lambda v: sum(1 << i for i in range(BITS) if (v & (i % size + 1)).bit_count() % 2)
    return [odd(v) for v in range(1, size + 1)]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> BITS - 1 else x


def links(nodes: DataFrame, radius: int = 2, small: int = 16) -> DataFrame:
    """Edges `a, b` (a > b) whose connected groups are those of all pairs of `nodes(fp,
    node)` within the radius; fingerprints are distinct.

    Members of a bucket of at most `small` are compared in the bucket. In larger ones
    each member proposes every value within radius / 2 of it in the bits that the
    table leaves out, and members that propose one value link to its smallest node:
    they are within the radius of each other, and every pair within the radius shares
    a value. So the rows grow with the members, not with their square.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    kept = masks(radius)
    keyed = nodes.select("fp", "node", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in kept])).alias("t", "key"))
    crowded = settle(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-buckets")
    members = settle(keyed.join(crowded, ["t", "key"]), "simhash-members")
    packed = members.filter(F.col("n") <= small).groupBy("t", "key").agg(F.collect_list(F.struct("fp", "node")).alias("m"))
    pairs = packed.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y")).filter(
        (F.col("x.node") > F.col("y.node")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius))
    near = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def flips(mask: int) -> list[int]:
        free = [i for i in range(BITS) if not mask >> i & 1]
        return [signed(sum(1 << i for i in c)) for k in range(radius // 2 + 1) for c in combinations(free, k)]
    table = F.element_at(F.array(*[F.array(*map(F.lit, flips(m))) for m in kept]), F.col("t") + 1)
    proposals = members.filter(F.col("n") > small).select("t", "fp", "node", F.explode(table).alias("flip")).select(
        "t", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "node")
    shared = settle(proposals.groupBy("t", "value").agg(F.min("node").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n"), "simhash-values")
    far = proposals.join(shared, ["t", "value"]).filter("node > b").select(F.col("node").alias("a"), "b")
    return near.unionByName(far).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node, component` (its smallest node) for the nodes of `edges(a, b)`, a > b, by
    alternating large and small stars; each round is a settled table of edges."""
    def mark(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def star(df: DataFrame) -> DataFrame:
        """(u, v) and the least of v over u, with u itself."""
        least = settle(df.groupBy("u").agg(F.min("v").alias("m")), "stars").withColumn("m", F.least("u", "m"))
        return df.join(least, "u")

    edges = settle(edges, "edges")
    before = mark(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = settle(star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct(), "edges")
        small = star(large)
        edges = settle(small.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a > b").distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row of docs(doc_id, text).

    A null or blank text has the zero fingerprint, which links like any other. Texts of
    fewer words than a shingle are one shingle. Repeated rows are returned as often as
    they occur. Rows without doc_id keep their fingerprint; one that only such rows
    carry links to nothing and has a null component. Extra columns are ignored.
    """
    prints = settle(fingerprints(docs.select("doc_id", "text"), words), "simhash")
    nodes = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node IS NOT NULL"), "simhash-nodes")
    groups = components(links(nodes, radius))
    names = settle(nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "simhash-groups")
    return prints.join(names, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
