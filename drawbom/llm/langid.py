"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the bag of its lower-cased byte n-grams, hashed into buckets. Each bucket
has an embedding; the mean embedding of a text goes through one linear layer. Both
are trained together by stochastic gradient descent in numpy on a bounded sample of
labelled texts, a temperature and a rejection threshold are set on a held-back part of
the sample. For prediction, embeddings and layer are multiplied out to one score per
bucket and language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drawbom.llm.shared import blocks, bytes_of, flat, lists

GRAMS = (1, 2, 3)
BUCKETS = 1 << 14
LOWER = np.arange(256, dtype=np.uint32)
LOWER[65:91] += 32


def bags(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    """(row, bucket) of each n-gram that stays within a row, one order at a time."""
    codes = LOWER[data] + np.uint32(1)
    n = len(codes)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    h = np.zeros(n, np.uint32)
    for k in range(1, max(GRAMS) + 1):
        if k > n:
            return
        h = h[:n - k + 1] * np.uint32(0x01000193) ^ codes[k - 1:] * np.uint32(0x9E3779B1)
        if k in GRAMS:
            inside = np.arange(n - k + 1) + k <= offsets[1:][row[:n - k + 1]]
            x = h ^ (h >> np.uint32(15)) ^ np.uint32(k * 0x5BD1E995 & 0xFFFFFFFF)
            yield row[:n - k + 1][inside], ((x * np.uint32(0x85EBCA6B)) >> np.uint32(16) & np.uint32(buckets - 1))[inside]


@dataclass
class Model:
    langs: list
    table: np.ndarray      # score of each bucket and language
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of each row."""
        rows = len(offsets) - 1
        logits, total = np.zeros((rows, len(self.langs))), np.zeros(rows)
        for row, bucket in bags(data, offsets, len(self.table)):
            total += np.bincount(row, minlength=rows)
            for j in range(len(self.langs)):
                logits[:, j] += np.bincount(row, weights=self.table[:, j][bucket], minlength=rows)
        z = (logits / np.maximum(total, 1)[:, None] + self.bias) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def counted(docs: DataFrame) -> DataFrame:
    """`lang, part, idx, cnt`: bucket counts of whole texts (part 0) and of a short slice (part 1)."""
    def scan(batches):
        for batch in batches:
            data, offsets = flat(batch.column("raw"))
            for lo, hi in blocks(offsets, 1 << 18):
                base = offsets[lo:hi + 1] - offsets[lo]
                block = data[offsets[lo]:offsets[hi]]
                short = np.concatenate([[0], np.cumsum(np.minimum(np.diff(base), 40))])
                at = (base[:-1] + np.maximum(0, np.diff(base) - 40) // 2).astype(np.int64)
                pick = np.concatenate([np.arange(a, a + n) for a, n in zip(at, np.diff(short))]) if hi > lo else np.zeros(0, np.int64)
                for part, (d, o) in enumerate(((block, base), (block[pick], short))):
                    key = np.concatenate([r * BUCKETS + b for r, b in bags(d, o)] or [np.zeros(0, np.int64)]).astype(np.int64)
                    found, cnt = np.unique(key, return_counts=True)
                    per = np.bincount(found // BUCKETS, minlength=hi - lo)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("lang").slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)),
                                                      lists((found % BUCKETS).astype(np.int32), per), lists(cnt.astype(np.int32), per)], ["doc_id", "lang", "part", "idx", "cnt"])
    return docs.select("doc_id", "lang", bytes_of().alias("raw")).mapInArrow(scan, "doc_id long, lang string, part int, idx array<int>, cnt array<int>")


def fit(labelled: DataFrame, per_lang: int = 500, dim: int = 16, epochs: int = 12, rate: float = 4.0, batch: int = 32, seed: int = 5, refuse: float = 0.001) -> Model | None:
    """Train on about `per_lang` texts of each language of labelled(doc_id, text, lang),
    chosen by a hash of doc_id; None without labelled text.

    A text reaches the driver as counts over the buckets, so the sample is bounded by
    per_lang * languages * BUCKETS whatever the corpus. The threshold refuses at most
    the share `refuse` of held-back texts, and never a confidence above one half.
    """
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL AND text RLIKE '\\\\p{L}'")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, per_lang / n))])
    sample = counted(rows.filter(share < wanted[F.col("lang")])).toPandas().sort_values(["doc_id", "lang", "part"], kind="stable").reset_index(drop=True)
    langs = sorted(totals)
    y = np.array([langs.index(x) for x in sample["lang"]])
    rng = np.random.default_rng(seed)
    E, W, b = rng.normal(0, 0.1, (BUCKETS, dim)), np.zeros((dim, len(langs))), np.zeros(len(langs))
    held = (np.arange(len(y)) // 2) % 5 == 4 if len(y) > 50 else np.zeros(len(y), bool)
    train = np.flatnonzero(~held)

    def dense(which):
        x = np.zeros((len(which), BUCKETS), np.float32)
        for i, k in enumerate(which):
            x[i, sample["idx"][k]] = sample["cnt"][k]
        return x / np.maximum(x.sum(axis=1, keepdims=True), 1)

    def probabilities(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    weight = len(train) / (len(langs) * np.maximum(np.bincount(y[train], minlength=len(langs)), 1))
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(train)
        for at in range(0, len(order), batch):
            which = order[at:at + batch]
            x = dense(which)
            used = np.flatnonzero(x.any(axis=0))
            x = x[:, used]
            hidden = x @ E[used]
            g = probabilities(hidden @ W + b)
            g[np.arange(len(which)), y[which]] -= 1
            g *= (weight[y[which]] / len(which))[:, None]
            back = g @ W.T
            W -= lr * hidden.T @ g
            b -= lr * 0.1 * g.sum(axis=0)
            E[used] -= lr * x.T @ back * 8
    table = E @ W
    temperature, threshold = 1.0, 0.0
    check = np.flatnonzero(held)
    if len(check):
        z = np.concatenate([dense(check[i:i + 256]) @ table + b for i in range(0, len(check), 256)])
        loss = lambda t: -np.log(np.maximum(probabilities(z / t)[np.arange(len(check)), y[check]], 1e-12)).mean()
        temperature = min(np.geomspace(0.05, 5, 60), key=loss)
        whole = probabilities(z / temperature)[sample["part"].to_numpy()[check] == 0].max(axis=1)
        threshold = float(min(0.5, np.quantile(whole, refuse) if len(whole) else 0.5))
    return Model(langs, np.ascontiguousarray(table), b, float(temperature), threshold)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with `lang_pred`, `score` and `accepted`, which replace columns of these names.

    A text that is null or has no letter is `und` with score 0 and not accepted, as is
    every text if there is no model. Other texts get a learned language; they are
    accepted if the calibrated score reaches the model's threshold.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    names = docs.columns
    spoken = docs.withColumns({"_raw": bytes_of(), "_letters": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))})
    # Plain values: a broadcast object would make executors import this module.
    shared = docs.sparkSession.sparkContext.broadcast(model and (model.langs, model.table, model.bias, model.temperature, model.threshold))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, accepted boolean"

    def scan(batches):
        m = shared.value and Model(*shared.value)
        for batch in batches:
            data, offsets = flat(batch.column("_raw"))
            n = len(offsets) - 1
            best, score = np.full(n, -1), np.zeros(n)
            letters = batch.column("_letters").to_numpy(zero_copy_only=False)
            if m is not None:
                for lo, hi in blocks(offsets, 1 << 19):
                    p = m.scores(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                    best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            best[~letters] = -1
            score = np.where(best < 0, 0.0, np.minimum(score, 1.0))
            langs = pa.array([*(m.langs if m else []), "und"])
            keep = (best >= 0) & (score >= (m.threshold if m else 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), langs.take(pa.array(np.where(best < 0, len(langs) - 1, best))), pa.array(score), pa.array(keep)],
                                             [*names, "lang_pred", "score", "accepted"])
    return spoken.mapInArrow(scan, schema)


def held_out(column: str, parts: int, part: int):
    """Rows whose crc32 of the id as text falls into this part; null ids never do."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))
