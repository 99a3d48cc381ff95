"""Removal of long repeated byte strings by distributed prefix doubling.

Ranking every position of a corpus would shuffle many times its size. Only positions
that decide a window are ranked: each window of `span` bytes is led by the position of
the least hash of its `seed`-byte strings, and equal windows have equal leaders at equal
places. Ranks of leaders grow as in prefix doubling: first by the `seed` bytes at a
leader, then, for leaders whose rank is shared, by longer strings around it, and at last
by whole windows where longer strings left it open. Each round groups (rank, position)
rows, drops what has become unique, and stops past the threshold. Ranks are hashes: 64
bits for seeds, which only choose what to look at, and 96 bits for what decides.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drawbom.llm.shared import Rolling, blocks, bytes_of, discard, flat, mixed, settle, sliding

SPAN, SEED, STEP = 200, 64, 32
READ, SENT = 1 << 15, 1 << 19         # bytes of text read at once, so that arrays stay in the cache, and answered at once
PLACE = np.uint64((1 << 28) - 1)      # low bits of an ordering key hold the place, so the leftmost of equals leads


class Leaders:
    """The leaders of all windows in a block of texts, and hashes of any string in it."""

    def __init__(self, span: int, seed: int):
        self.span, self.seed, self.reach = span, seed, span - seed
        self.one, self.two = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)

    def read(self, data: np.ndarray, offsets: np.ndarray, second: bool = True) -> None:
        codes = data.astype(np.uint64) + np.uint64(1)
        self.sums = self.one.prefix(codes)
        self.sums2 = self.two.prefix(codes) if second else None
        self.begin, self.end = offsets[:-1], offsets[1:]
        n = len(data)
        if n > PLACE:
            raise ValueError(f"a text of {n} bytes is longer than places can number")
        if n < self.span:
            self.seeds = np.zeros(0, np.uint64)
            self.at = self.low = self.high = self.doc = np.zeros(0, np.int64)
            return
        at = np.arange(n - self.seed + 1)
        self.seeds = mixed(self.one.spans(self.sums, at, at + self.seed))
        key = (self.seeds & ~PLACE) | at.astype(np.uint64)
        lead = (sliding(key, self.reach + 1) & PLACE).astype(np.int64)
        doc = np.repeat(np.arange(len(self.begin)), np.diff(offsets))[:len(lead)]
        first = np.flatnonzero(np.arange(len(lead)) + self.span <= self.end[doc])
        lead, doc = lead[first], doc[first]
        turn = np.flatnonzero(np.concatenate([[True], lead[1:] != lead[:-1]])) if len(lead) else np.zeros(0, np.int64)
        last = np.concatenate([turn[1:], [len(lead)]]) - 1 if len(lead) else turn
        self.at, self.doc = lead[turn], doc[turn]
        self.high, self.low = self.at - first[turn], self.at - first[last]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        salt = mixed((salt.astype(np.uint64) << np.uint64(32)) + (ends - starts).astype(np.uint64))
        a = mixed(self.one.spans(self.sums, starts, ends) ^ salt)
        b = mixed(self.two.spans(self.sums2, starts, ends) + salt)
        return a.view(np.int64), (b >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def nodes(self, keep: np.ndarray):
        """The steps of the leaders `keep`: which leader, step, and the range of distances
        from window start to leader, whole and as far as windows fit in the text."""
        step = np.arange(self.reach // STEP + 1)
        whole_low, whole_high = step * STEP, np.minimum(step * STEP + STEP - 1, self.reach)
        use = (whole_low[None, :] <= self.high[keep][:, None]) & (whole_high[None, :] >= self.low[keep][:, None])
        k, j = np.nonzero(use)
        k = keep[k]
        low = np.maximum(whole_low[j], self.at[k] + self.span - self.end[self.doc[k]])
        high = np.minimum(whole_high[j], self.at[k] - self.begin[self.doc[k]])
        return k, j, whole_low[j], whole_high[j], low, high


def keyed(docs: DataFrame) -> DataFrame:
    raw = bytes_of()
    return docs.select("doc_id", raw.alias("raw")).withColumn("own", F.xxhash64("doc_id", "raw"))


def ranges(offsets: np.ndarray):
    """Row ranges to answer at once, each as the ranges to read at once."""
    for lo, hi in blocks(offsets, SENT):
        yield [(lo + a, lo + b) for a, b in blocks(offsets[lo:hi + 1], READ)]


def together(pieces: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pieces)], names)


def leaders_of(texts: DataFrame, span: int, seed: int) -> DataFrame:
    """`rank, own, at` of every leader."""
    def scan(batches):
        reader = Leaders(span, seed)
        for batch in batches:
            data, offsets = flat(batch.column("raw"))
            own = batch.column("own").to_numpy()
            for group in ranges(offsets):
                found = []
                for lo, hi in group:
                    reader.read(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], second=False)
                    found.append((reader.seeds[reader.at].view(np.int64), own[lo:hi][reader.doc], (reader.at - reader.begin[reader.doc]).astype(np.int32)))
                yield together(found, ["rank", "own", "at"])
    return texts.filter(F.length("raw") >= span).select("own", "raw").mapInArrow(scan, "rank long, own long, at int")


def long_strings(texts: DataFrame, span: int, seed: int) -> DataFrame:
    """Round 2: strings around shared leaders. A leader's windows start 0 to span - seed
    bytes before it; for each step of such starts there is the string that all its windows
    have in common and the one that they cover together."""
    def scan(batches):
        reader = Leaders(span, seed)
        for batch in batches:
            data, offsets = flat(batch.column("raw"))
            own, ids = batch.column("own").to_numpy(), batch.column("id").to_numpy()
            leads = batch.column("leads")
            marked, upto = leads.values.to_numpy().astype(np.int64), leads.offsets.to_numpy()
            for group in ranges(offsets):
                found = []
                for lo, hi in group:
                    reader.read(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                    ranked = marked[upto[lo]:upto[hi]] + np.repeat(offsets[lo:hi] - offsets[lo], np.diff(upto[lo:hi + 1]))
                    k, j, whole_low, whole_high, low, high = reader.nodes(np.flatnonzero(np.isin(reader.at, ranked)))
                    at = reader.at[k]
                    doc = reader.doc[k]
                    found.append((*reader.hashes(at - whole_low, at - whole_high + span, j * 2), *reader.hashes(at - high, at - low + span, j * 2 + 1),
                                  own[lo:hi][doc], ids[lo:hi][doc], (at - reader.begin[doc]) << 3 | j))
                yield together(found, ["c1", "c2", "v1", "v2", "own", "id", "place"])
    return texts.mapInArrow(scan, "c1 long, c2 int, v1 long, v2 int, own long, id long, place long")


def judged_steps(strings: DataFrame) -> DataFrame:
    """`own, id, full, open`: the steps of each text whose cover is shared, so that all their
    windows are, and those whose windows have to be ranked one by one: where several
    places share a common string, those under a cover of their own, and of each shared
    cover one place that stands for all."""
    strings = strings.withColumn("pick", F.xxhash64("own", "id", "place"))
    covers = settle(strings.groupBy("c1", "c2", "v1", "v2").agg(F.count("*").alias("n"), F.min("pick").alias("least_pick")), "covers")
    split = settle(covers.groupBy("c1", "c2").agg(F.sum("n").alias("all"), F.min("n").alias("least")).filter("all > 1 AND least = 1").select("c1", "c2", F.lit(True).alias("open")), "split")
    judged = settle(covers.join(split, ["c1", "c2"], "left").filter("n > 1 OR open").select("c1", "c2", "v1", "v2", "least_pick", (F.col("n") > 1).alias("whole"), F.coalesce("open", F.lit(False)).alias("open")), "judged")
    discard(covers, split)
    steps = settle(strings.join(judged, ["c1", "c2", "v1", "v2"]).groupBy("own", "id").agg(
        F.collect_set(F.when(F.col("whole"), F.col("place"))).alias("full"), F.collect_set(F.when(F.col("open") & (F.col("pick") == F.col("least_pick")), F.col("place"))).alias("open")), "steps")
    discard(judged)
    return steps


def whole_windows(texts: DataFrame, span: int, seed: int) -> DataFrame:
    """Round 3: the windows of the open steps."""
    def scan(batches):
        reader = Leaders(span, seed)
        for batch in batches:
            data, offsets = flat(batch.column("raw"))
            own, ids = batch.column("own").to_numpy(), batch.column("id").to_numpy()
            for lo, hi in blocks(offsets, 1 << 19):
                reader.read(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                open_steps = []
                for i in range(lo, hi):
                    open_steps.append(np.asarray(batch.column("open")[i].as_py(), np.int64) + ((offsets[i] - offsets[lo]) << 3))
                codes = np.concatenate(open_steps)
                k, j = np.searchsorted(reader.at, codes >> 3), codes & 7
                low, high = np.maximum(j * STEP, reader.low[k]), np.minimum(np.minimum(j * STEP + STEP - 1, reader.reach), reader.high[k])
                count = np.maximum(high - low + 1, 0)
                distance = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                start = np.repeat(reader.at[k], count) - distance
                doc = np.repeat(reader.doc[k], count)
                r1, r2 = reader.hashes(start, start + span, np.full(len(start), 99))
                yield pa.RecordBatch.from_arrays([pa.array(r1), pa.array(r2), pa.array(own[lo:hi][doc]), pa.array(ids[lo:hi][doc]), pa.array(start - reader.begin[doc])], ["r1", "r2", "own", "id", "place"])
    return texts.mapInArrow(scan, "r1 long, r2 int, own long, id long, place long")


def without_repeats(text: bytes, steps, windows, span: int, seed: int) -> tuple[bytes, int, int]:
    """What is left of a text, and the bytes and runs removed."""
    edge = np.zeros(len(text) + 1, np.int64)
    codes = np.asarray(steps or [], np.int64)
    at, j = codes >> 3, codes & 7
    low = np.maximum(j * STEP, at + span - len(text))
    high = np.minimum(np.minimum(j * STEP + STEP - 1, span - seed), at)
    np.add.at(edge, at - high, 1)
    np.add.at(edge, at - low + span, -1)
    start = np.asarray(windows or [], np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + span, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return kept, int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def repeated_strings(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """`own, id, n_removed, n_spans, kept_sha256` of the texts that lose bytes; `own` is a hash
    of doc_id and text, `id` the doc_id (the least long for null)."""
    if not 0 < span - seed < 8 * STEP:
        raise ValueError("span - seed must be below 8 steps")
    texts = keyed(docs)
    found = settle(leaders_of(texts, span, seed), "found")
    shared = settle(found.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").select("rank"), "seeds")
    leads = settle(found.join(shared, "rank", "left_semi").groupBy("own").agg(F.collect_set("at").alias("leads")), "leads")
    discard(shared, found)
    least = -(1 << 63)
    live = settle(texts.join(leads, "own").select("own", F.coalesce("doc_id", F.lit(least)).alias("id"), "raw", "leads"), "live")
    discard(leads)
    steps = judged_steps(long_strings(live, span, seed))
    single = whole_windows(live.select("own", "id", "raw").join(steps.filter(F.size("open") > 0).select("own", "id", "open"), ["own", "id"]), span, seed)
    twice = settle(single.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2"), "twice")
    windows = settle(single.join(twice, ["r1", "r2"], "left_semi").groupBy("own", "id").agg(F.collect_set("place").alias("windows")), "windows")
    discard(twice)

    def cut(batches):
        for batch in batches:
            rows = [without_repeats(raw.as_py(), s.as_py(), w.as_py(), span, seed) for raw, s, w in zip(batch.column("raw"), batch.column("full"), batch.column("windows"))]
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("id"), pa.array([n for _, n, _ in rows], pa.int64()), pa.array([k for _, _, k in rows], pa.int64()),
                                              pa.array([hashlib.sha256(t).hexdigest() for t, _, _ in rows], pa.string())], ["own", "id", "n_removed", "n_spans", "kept_sha256"])
    cuts = live.select("own", "id", "raw").join(steps.select("own", "id", "full"), ["own", "id"]).join(windows, ["own", "id"], "left")
    out = settle(cuts.mapInArrow(cut, "own long, id long, n_removed long, n_spans long, kept_sha256 string").filter("n_removed > 0").dropDuplicates(["own", "id"]), "cut")
    discard(live, steps, windows)
    return out


def dedup(docs: DataFrame, span: int = SPAN, seed: int = SEED) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256` for every row of docs(doc_id, text).

    A byte goes if a string of `span` bytes that covers it starts at another place too, in
    the same row or another; a repeated row is another row. A null or empty text, and any
    shorter than `span`, loses nothing; one over 256 MB raises an error. An empty table gives no rows; extra columns are
    ignored. Texts are bytes throughout, so what is left need not be valid UTF-8.
    """
    cut = repeated_strings(docs, span, seed)
    rows = keyed(docs).select("doc_id", "own", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.length("raw").cast("long").alias("n_bytes"), F.sha2("raw", 256).alias("sha"))
    return rows.join(cut, ["own", "id"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                                                        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
