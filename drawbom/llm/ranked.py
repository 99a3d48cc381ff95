"""Ranked lexical search without random access (NRA) over shards of an impact-sorted index.

Documents stay where they are: each task turns the rows it reads into shards, whose
postings are sorted by impact under each term. An item reads its lists in step, from
the highest impacts down. A document's score lies between the sum of the impacts seen
(lower) and that sum plus, for each unseen term, the impact last read (upper). Reading
goes on until no other document can enter, and every one that can is known exactly, so
membership, ties and scores are final. What a task found bounds its next shards.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from drawbom.llm.shared import bytes_of, settle

KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HITS = "item long, doc_id long, score long"


def words_of(text: bytes, step: int = 1 << 20):
    """The terms of a whole text, in lists of about `step` bytes."""
    at = 0
    while at < len(text):
        end = at + step
        cut = text[at:end].translate(KEEP)
        while end < len(text) and cut[-1] != 32:      # the last term goes on
            more = text[end:end + step].translate(KEEP)
            stop = more.find(b" ")
            cut, end = cut + (more if stop < 0 else more[:stop + 1]), end + (len(more) if stop < 0 else stop + 1)
        yield cut.split()
        at = end


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """`doc_id, n, terms, tfs`: all terms of a document, and those of the vocabulary."""
    def scan(batches):
        for batch in batches:
            n, terms, tfs, ends = [], [], [], [0]
            for raw in batch.column("raw"):
                seen, total = Counter(), 0
                for words in words_of(raw.as_py()):
                    total += len(words)
                    seen.update(words)
                for w in seen.keys() & vocabulary.keys():
                    terms.append(vocabulary[w])
                    tfs.append(seen[w])
                n.append(total)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))],
                                             ["doc_id", "n", "terms", "tfs"])
    return docs.select("doc_id", bytes_of().alias("raw")).mapInArrow(scan, "doc_id long, n long, terms array<int>, tfs array<long>")


def best_of(ids: np.ndarray, known: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: high scores first, then small ids, rows without id last."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= least)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], ~known[among], -scores[among]))[:k]]


def read_lists(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of a superset of the k best of `n_docs` documents, all of it exact.

    `lists` holds (documents, impacts) by falling impact. `floor` is a score that k
    documents elsewhere reach: lower ones cannot enter.
    """
    lower, at = np.zeros(n_docs, np.int64), [0] * len(lists)
    while True:
        last, covered = [0] * len(lists), np.zeros(n_docs, np.int64)
        for t, (places, impacts) in enumerate(lists):
            end = min(depth, len(places))
            lower[places[at[t]:end]] += impacts[at[t]:end]
            at[t] = end
            if end < len(places):                     # an exhausted list has nothing to give
                last[t] = int(impacts[end - 1])
                covered[places[:end]] += last[t]
        unseen = sum(last)
        upper = lower + (unseen - covered)
        bar = floor
        if n_docs >= k:
            bar = max(bar, int(np.partition(lower, n_docs - k)[n_docs - k]))
        may = upper >= max(bar, 1)
        if not unseen or bool((upper[may] == lower[may]).all()):
            places = np.flatnonzero(may & (lower > 0))
            return places, lower[places]
        depth *= 4


def search_shards(counts: DataFrame, items: list[tuple[int, list[int]]], weights: dict[int, int], N: int, L: int, k: int, shard: int) -> DataFrame:
    """The k best documents of each item, from every task. A shard ends at `shard` postings or documents."""
    def scan(batches):
        held = {}

        def search(parts):
            ids = np.concatenate([p[0] for p in parts])
            known = np.concatenate([p[1] for p in parts])
            n = np.concatenate([p[2] for p in parts])
            sizes = np.concatenate([p[3] for p in parts])
            terms = np.concatenate([p[4] for p in parts])
            tfs = np.concatenate([p[5] for p in parts])
            places = np.repeat(np.arange(len(ids)), sizes)
            m = 50 + (50 * n * N) // max(L, 1)
            top = max(weights, default=0) + 1
            w = np.zeros(top, np.int64)
            w[list(weights)] = list(weights.values())
            impacts = w[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[places]))
            order = np.lexsort((-impacts, terms))
            terms, places, impacts = terms[order], places[order], impacts[order]
            ends = np.searchsorted(terms, np.arange(top + 1))
            for item, wanted in items:
                lists = [(places[ends[t]:ends[t + 1]], impacts[ends[t]:ends[t + 1]]) for t in wanted if ends[t] < ends[t + 1]]
                if not lists:
                    continue
                old = held.get(item)
                floor = int(old[2][-1]) if old is not None and len(old[2]) == k else 0
                found, scores = read_lists(lists, len(ids), k, floor)
                if len(found):
                    now = (ids[found], known[found], scores)
                    now = now if old is None else tuple(map(np.concatenate, zip(old, now)))
                    pick = best_of(*now, k)
                    held[item] = tuple(a[pick] for a in now)

        parts, postings = [], 0
        for batch in batches:
            column = batch.column("doc_id")
            lists, amounts = batch.column("terms"), batch.column("tfs")
            parts.append((column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False),
                          np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False), amounts.flatten().to_numpy(zero_copy_only=False)))
            postings += len(parts[-1][4]) + len(column)
            if postings >= shard:
                search(parts)
                parts, postings = [], 0
        if parts:
            search(parts)
        for item, (ids, known, scores) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), item)), pa.array(ids, mask=~known), pa.array(scores)], ["item", "doc_id", "score"])
    return counts.mapInArrow(scan, HITS)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, block: int = 1000, shard: int = 1 << 21) -> DataFrame:
    """`item_id, rank, doc_id, score`: the k best documents of every row of items(item_id, text).

    Null texts have no terms; documents without any of an item's terms, or only with
    terms of weight 0, are not returned, and an item without terms has no rows. Equal
    scores go by doc_id, rows without doc_id last. Each row counts as a document of its
    own, each row of items as an item, repeated ones too. Texts of any length are read whole, in pieces. Items are
    searched in blocks of about `block`, whose terms are what a task is sent; empty
    tables give none. Extra columns are ignored.
    """
    spark = docs.sparkSession
    asked = settle(items.select("item_id", bytes_of().alias("raw"), F.monotonically_increasing_id().alias("item")), "items")
    blocks = max(1, math.ceil(asked.count() / block))
    found = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "raw").collect()
        words = {r["item"]: set().union(*words_of(bytes(r["raw"]))) for r in rows}
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*words.values())))}
        counts = settle(counted(docs, vocabulary), "term-counts")
        N, L = (x or 0 for x in counts.filter("n > 0").agg(F.count("*"), F.sum("n")).first())
        df = {r["t"]: r["df"] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        weights = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * n + 1))) for t, n in df.items()}
        wanted = [(item, sorted(t for t in map(vocabulary.get, ws) if weights.get(t, 0) > 0)) for item, ws in words.items()]
        found.append(settle(search_shards(counts, wanted, weights, N, L, k, shard), "hits"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    cells = hits.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    for keys in (["item", "cell"], ["item"]):
        cells = cells.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return cells.select("item", "rank", "doc_id", "score").join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
