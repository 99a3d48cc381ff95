"""Best-fit packing of tokenised documents into training sequences.

Every piece needs (tokens, one document, tokens squared) of a sequence's capacities.
Pieces of one length are alike, so vector best-fit runs over the histogram of lengths
(at most `capacity` entries, whatever the corpus) and places runs of equal pieces into
runs of equally filled sequences. The result is a bounded table of placements; each
piece finds its own by its rank within its length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from drawbom.llm.shared import settle

CAPACITY = 2048
SALTS = 256


class Encoder:
    """Token ids of byte-level BPE as little-endian 32-bit bytes.

    The vocabulary's split pattern treats runs of white space in a way of their own,
    by look-ahead. A text without such a run is split alike by the pattern without
    look-ahead, which is faster. Strings of special tokens are left to the tokenizer
    of the JSON file.
    """

    def __init__(self, path: str):
        import base64
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        split = public_tokenizers.PATTERN
        self.exact = tiktoken.Encoding("exact", pat_str=split, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.plain = tiktoken.Encoding("plain", pat_str=split.replace(r"|\s+(?!\S)", ""), mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.full, self.runs = Tokenizer.from_file(path), re.compile(r"\s\s")

    def encode(self, text: str) -> bytes:
        if "<|" in text:
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = (self.exact if self.runs.search(text) else self.plain)(text)
        return array("I", ids).tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32` of every row of docs(doc_id, text): its
    ids and the end id, cut only where it exceeds a sequence, then into whole
    sequences after a first piece that may be shorter."""
    def scan(batches):
        encoder, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            doc, piece, start, length, crc = zip(*rows) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(histogram: dict[int, int], capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm") -> list[tuple]:
    """Vector best-fit over counts by length, longest first.

    Rows `(length, rank, sequence, offset, per, n)`: pieces of this length from this
    rank on go, `per` to each, into n sequences from this one on, the first of each
    at this offset. `rule` picks among the fill states that can take a piece under
    every capacity: "dot" the largest dot product of need and residual, each divided
    by the capacities, "norm" the smallest norm of what remains.
    """
    caps = np.array([capacity, max_docs or capacity, max_cost or capacity * capacity], float)
    if max(histogram, default=0) > capacity or max((x * x for x in histogram), default=0) > caps[2]:
        raise ValueError("a piece is larger than a sequence")
    spaces: dict[tuple, list] = defaultdict(list)   # residual capacities -> runs [first, n] of sequences
    placed, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        need = np.array([length, 1, length * length], float)
        states = np.array(list(spaces), float).reshape(-1, 3)
        states = states[(states >= need).all(axis=1)]
        after = (states - need) / caps
        score = -(states / caps) @ (need / caps) if rule == "dot" else (after ** 2).sum(axis=1)
        order = list(map(tuple, states[np.lexsort((states[:, 0], score))].astype(int))) if len(states) else []
        for state in order:
            while left and spaces[state]:
                first, n = spaces[state].pop()
                fits = int(min(state[0] // length, state[1], state[2] // (length * length)))
                full = min(n, left // fits)
                offset = capacity - state[0]
                for bins, per in ((full, fits), (1 if full < n and left - full * fits else 0, left - full * fits)):
                    if bins:
                        placed.append((length, rank, first, offset, per, bins))
                        spaces[state[0] - per * length, state[1] - per, state[2] - per * length * length].append([first, bins])
                        first, n, left, rank = first + bins, n - bins, left - bins * per, rank + bins * per
                if n:
                    spaces[state].append([first, n])
                    if not left:
                        break
            if not spaces[state]:
                del spaces[state]
            if not left:
                break
        if left:
            fits = int(min(capacity // length, caps[1], caps[2] // (length * length)))
            for bins, per in ((left // fits, fits), (1, left % fits)):
                if bins and per:
                    placed.append((length, rank, fresh, 0, per, bins))
                    spaces[int(caps[0]) - per * length, int(caps[1]) - per, int(caps[2]) - per * length * length].append([fresh, bins])
                    fresh, rank = fresh + bins, rank + bins * per
    return placed


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm") -> DataFrame:
    """One row per piece: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`.

    A null or empty text is the end id alone. Repeated rows are packed each. An empty
    table gives no rows; rows without doc_id are packed too; extra columns are ignored.
    """
    cut = settle(pieces(docs, tokenizer, capacity), "pieces").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    counts = settle(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = place(histogram, capacity, max_docs, max_cost, rule)
    columns = np.array(sorted(table), np.int64).reshape(-1, 6)
    key = columns[:, 0] << 44 | columns[:, 1]

    def assign(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            row = columns[np.searchsorted(key, length << 44 | rank, "right") - 1]
            nth, within = np.divmod(rank - row[:, 1], row[:, 4])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 2] + nth), pa.array(row[:, 3] + within * length)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    at = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = cut.withColumn("nth", at).join(bases, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
