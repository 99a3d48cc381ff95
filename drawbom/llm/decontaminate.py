"""Benchmark decontamination by winnowing.

Each window of `span` words keeps the least hash of its k-grams. Windows that are
equal keep equal hashes, so a document that shares a whole window with a benchmark
item shares a fingerprint at that place; only such places are extended to the full
window and matched exactly (128-bit hashes). Items shorter than a window count as one
window of their own length, whose only k-gram is the item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drawbom.llm.shared import Rolling, blocks, bytes_of, flat, lists, mixed, settle, sliding

SPAN, GRAM = 13, 5
FILTER_BITS = 23
WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Grams:
    """Words and word-gram hashes of a block of texts."""

    def __init__(self):
        self.letters, self.first, self.second = Rolling(0x9E3779B97F4A7C15), Rolling(0xD6E8FEB86659FD93), Rolling(0xA0761D6478BD642F)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> None:
        text = LOWER[data]
        word = WORD_BYTES[text]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        closes[:-1] &= ~word[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(text))]
        opens[inner] |= word[inner]
        closes[inner - 1] |= word[inner - 1]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        sums = self.letters.prefix(text.astype(np.uint64) + np.uint64(1))
        self.words = mixed(self.letters.spans(sums, starts, ends) ^ (ends - starts).astype(np.uint64))
        self.bounds = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.sums = self.first.prefix(self.words), self.second.prefix(mixed(self.words + np.uint64(1)))

    def grams(self, k: int, which: int = 0) -> np.ndarray:
        """Hashes of all runs of k words, those over document ends included."""
        n = max(0, len(self.words) - k + 1)
        at = np.arange(n)
        return mixed((self.first, self.second)[which].spans(self.sums[which], at, at + k))

    def whole(self, k: int) -> np.ndarray:
        """Which of these runs stay in one document."""
        n = max(0, len(self.words) - k + 1)
        return np.arange(n) + k <= self.bounds[1:][self.doc[:n]]

    def winnowed(self, span: int, gram: int) -> np.ndarray:
        """The least k-gram hash of each window."""
        return sliding(self.grams(gram), span - gram + 1)


def windows_of_items(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """`item_id, n, h1, h2, fp` for each window of the benchmark."""
    def scan(batches):
        g = Grams()
        for batch in batches:
            data, offsets = flat(batch.column("raw"))
            for lo, hi in blocks(offsets):
                g.read(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                ids = batch.column("item_id").slice(lo, hi - lo)
                for n in [span, *[int(c) for c in np.unique(g.counts) if 0 < c < span]]:
                    if len(g.words) < n:
                        continue
                    use = g.whole(n)
                    if n < span:
                        use &= g.counts[g.doc[:len(use)]] == n
                    at = np.flatnonzero(use)
                    h1, h2 = g.grams(n)[at].view(np.int64), g.grams(n, 1)[at].view(np.int64)
                    fp = g.winnowed(span, gram)[at].view(np.int64) if n == span else h1
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(g.doc[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(h1), pa.array(h2), pa.array(fp)],
                                                     ["item_id", "n", "h1", "h2", "fp"])
    return items.filter("item_id IS NOT NULL").select("item_id", bytes_of().alias("raw")).mapInArrow(scan, "item_id long, n int, h1 long, h2 long, fp long")


def bit_filter(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A table of 2 ** bits bits with those of all fingerprints and windows set. Its size
    does not depend on the benchmark; a full table only lets more places through to
    the exact join."""
    slots = windows.select(F.explode(F.array("fp", "h1")).alias("h")).select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("s"))
    rows = slots.groupBy(F.shiftright("s", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 31 AS INT))")).alias("b")).toPandas()
    table = np.zeros(1 << bits - 5, np.uint32)
    table[rows["w"].to_numpy(np.int64)] = rows["b"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool)


def candidate_windows(docs: DataFrame, table: np.ndarray, lengths: list[int], span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """`rid, doc_id, n_words` and the windows of each document that may occur in the benchmark."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(np.packbits(table))
    keep = np.uint64(len(table) - 1)

    def scan(batches):
        g, hit = Grams(), np.unpackbits(known.value).astype(bool)
        for batch in batches:
            data, offsets = flat(batch.column("raw"))
            for lo, hi in blocks(offsets):
                g.read(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                found = []
                for n in lengths:
                    if len(g.words) < n:
                        continue
                    use = g.whole(n)
                    if n == span:
                        use &= hit[(g.winnowed(span, gram) & keep).astype(np.int64)]
                    h1 = g.grams(n)
                    at = np.flatnonzero(use)
                    at = at[hit[(h1[at] & keep).astype(np.int64)]]
                    found.append((at, np.full(len(at), n, np.int32), h1[at].view(np.int64), g.grams(n, 1)[at].view(np.int64)))
                at, n, h1, h2 = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
                order = np.argsort(at, kind="stable")
                at, n, h1, h2 = at[order], n[order], h1[order], h2[order]
                doc = g.doc[at]
                per = np.bincount(doc, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(g.counts.astype(np.int64)), lists((at - g.bounds[doc]).astype(np.int64), per), lists(n, per), lists(h1, per), lists(h2, per)],
                    ["doc_id", "n_words", "pos", "n", "h1", "h2"])
    return docs.select("doc_id", bytes_of().alias("raw")).mapInArrow(
        scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, pos array<long>, n array<int>, h1 array<long>, h2 array<long>").withColumn("rid", F.monotonically_increasing_id())


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, share: int = 20) -> DataFrame:
    """`doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items` per row of docs.

    Texts that are null, empty or without words have no windows and are clean, as are
    all documents when the benchmark is empty. Items without item_id are ignored;
    repeated items count once by item_id. Repeated documents are judged one by one and
    returned as often as they occur; extra columns are ignored. What is judged is the text
    alone, and doc_id may be of any type, so a digest of the text can stand for it.
    """
    windows = settle(windows_of_items(items.select("item_id", "text"), span, gram).distinct(), "windows")
    lengths = sorted({span} | {r["n"] for r in windows.filter(F.col("n") < span).select("n").distinct().collect()})
    scanned = settle(candidate_windows(docs.select("doc_id", "text"), bit_filter(windows), lengths, span, gram), "scanned")
    places = scanned.filter(F.size("pos") > 0).select("rid", F.explode(F.arrays_zip("pos", "n", "h1", "h2")).alias("w")).select("rid", "w.*")
    known = settle(windows.select("n", "h1", "h2").distinct(), "known")
    hits = settle(places.join(known, ["n", "h1", "h2"]), "hits")
    ordered = F.sort_array(F.collect_set(F.struct("pos", (F.col("pos") + F.col("n")).alias("end"))))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["end"], x["pos"]))).cast("long").alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = hits.groupBy("rid").agg(ordered.alias("spans")).select("rid", F.aggregate("spans", zero, step)["n"].alias("n_hit"))
    named = (hits.select("rid", "n", "h1", "h2").distinct().join(windows.select("n", "h1", "h2", F.col("item_id").cast("string").alias("item")), ["n", "h1", "h2"])
             .groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items")))
    out = scanned.select("rid", "doc_id", "n_words").join(covered, "rid", "left").join(named, "rid", "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
                      ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"), names.alias("items"))
