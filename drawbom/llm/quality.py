"""Quality scores by a sparse ensemble of rules.

Shallow trees are grown on text statistics, every path of theirs is a conjunctive
rule, a lasso logistic regression keeps few of the rules, and the kept ones become
Spark column expressions over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from drawbom.llm.shared import bytes_of

STATS = ["n_bytes", "n_words", "word_len", "upper", "digit", "punct", "symbol", "space", "high", "distinct", "n_lines", "line_len", "repeat_lines", "top_word", "stops", "capital"]
CLASS = np.full(256, 4)          # 0 lower, 1 upper, 2 digit, 3 plain punctuation, 4 other symbols, 5 space, 6 beyond ASCII
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 6
CLASS[[ord(c) for c in ".,;:'\"?-()"]] = 3
CLASS[[9, 10, 11, 12, 13, 32]] = 5


def statistics(text: bytes) -> list[float]:
    """The figures of STATS of a whole text; all zero for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [float(n)] + [0.0] * (len(STATS) - 1)
    share = np.bincount(CLASS[np.frombuffer(text, np.uint8)], minlength=7) / n
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x]
    k = len(words)
    short = sum(c for w, c in seen.items() if len(w) <= 3)
    capital = sum(c for w, c in seen.items() if 65 <= w[0] <= 90)
    return [float(n), float(k), (n - k) / k, share[1], share[2], share[3], share[4], share[5], share[6], len(seen) / k, float(len(lines)), n / len(lines),
            1 - len(set(lines)) / len(lines), max(seen.values()) / k, short / k, capital / k]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the statistics of every row."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema) + "".join(f", {s} double" for s in STATS)

    def scan(batches):
        for batch in batches:
            table = np.array([statistics(t.as_py()) for t in batch.column("_raw")], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(table[:, i]) for i in range(len(STATS)))], [*keep, *STATS])
    return docs.select(*keep, bytes_of().alias("_raw")).mapInArrow(scan, schema)


@dataclass
class Rules:
    terms: list      # (weight, [(statistic, at most?, cut)])
    bias: float

    def score(self) -> Column:
        """Probability of label 1 as a column over the statistics."""
        def rule(tests):
            return reduce(lambda a, b: a & b, [(F.col(s) <= c) if low else (F.col(s) > c) for s, low, c in tests])
        logit = reduce(lambda a, b: a + b, [F.when(rule(t), F.lit(w)).otherwise(F.lit(0.0)) for w, t in self.terms], F.lit(self.bias))
        return 1 / (1 + F.exp(-logit))


def paths(x: np.ndarray, g: np.ndarray, depth: int, columns: np.ndarray, cuts: list[np.ndarray]) -> list[tuple]:
    """Rules of a regression tree on targets g: the tests on the way to every node."""
    out = []

    def grow(rows, tests):
        if tests:
            out.append(tuple(tests))
        if len(tests) == depth or len(rows) < 20:
            return
        total, n, best = g[rows].sum(), len(rows), (1e-9, None)
        for j in columns:
            at = np.searchsorted(cuts[j], x[rows, j], "left")
            cnt = np.cumsum(np.bincount(at, minlength=len(cuts[j]) + 1))[:-1]
            s = np.cumsum(np.bincount(at, weights=g[rows], minlength=len(cuts[j]) + 1))[:-1]
            use = (cnt >= 5) & (n - cnt >= 5)
            if use.any():
                gain = np.where(use, s ** 2 / np.maximum(cnt, 1) + (total - s) ** 2 / np.maximum(n - cnt, 1) - total ** 2 / n, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = gain[k], (j, cuts[j][k])
        if best[1]:
            j, c = best[1]
            low = x[rows, j] <= c
            grow(rows[low], [*tests, (int(j), True, float(c))])
            grow(rows[~low], [*tests, (int(j), False, float(c))])
    grow(np.arange(len(x)), [])
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, trees: int = 40, depth: int = 3, penalty: float = 0.002, steps: int = 400, seed: int = 3) -> Rules:
    """Rules from docs(doc_id, text) and labels(doc_id, quality).

    About `sample` labelled documents, chosen by a hash of doc_id, are measured and sent
    to the driver as their statistics. Several labels of one document count each, null
    labels do not. Without both labels, or where no statistic tells them apart, the score is constant.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    chosen = share < min(1.0, sample / max(known.count(), 1))
    joined = docs.select("doc_id", "text").filter(chosen).join(known.filter(chosen), "doc_id")
    rows = measured(joined, ["doc_id", "quality"]).toPandas().sort_values(["doc_id", "quality", *STATS], kind="stable")
    x, y = rows[STATS].to_numpy(float).reshape(-1, len(STATS)), rows["quality"].to_numpy(float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) < 20 or y.min() == y.max():
        return Rules([], float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    found, margin = {}, np.full(len(y), np.log(prior / (1 - prior)))
    for _ in range(trees):
        pick = rng.choice(len(y), len(y) // 2, replace=False)
        residual = y - 1 / (1 + np.exp(-margin))
        columns = rng.choice(len(STATS), 8, replace=False)
        for rule in paths(x[pick], residual[pick], depth, columns, cuts):
            hit = np.ones(len(y), bool)
            for j, low, c in rule:
                hit &= (x[:, j] <= c) == low
            if hit.any() and not hit.all():
                found.setdefault(hit.tobytes(), (rule, hit))
                if len(rule) == depth:
                    margin[hit] += 0.1 * residual[hit].mean() / max(prior * (1 - prior), 0.05)
    if not found:
        return Rules([], float(np.log(prior / (1 - prior))))
    rules = [r for r, _ in found.values()]
    R = np.array([h for _, h in found.values()], np.float32).T
    scale = R.std(axis=0) + 1e-6
    Z = (R - R.mean(axis=0)) / scale
    w, v, b, t = np.zeros(Z.shape[1]), np.zeros(Z.shape[1]), np.log(prior / (1 - prior)), 1.0
    rate = 4.0 / (np.linalg.norm(Z, 2) ** 2 / len(y) + 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(Z @ v + b)))
        new = v - rate * (Z.T @ (p - y) / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        b -= rate * 0.25 * (p - y).mean() * 4
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    used = np.flatnonzero(np.abs(w) > 1e-4)
    weights = w[used] / scale[used]
    bias = float(b - (weights * R[:, used].mean(axis=0)).sum())
    return Rules([(float(c), [(STATS[j], low, cut) for j, low, cut in rules[k]]) for c, k in zip(weights, used)], bias)


def rate(docs: DataFrame, rules: Rules, keep: list[str], cut: float = 0.3) -> DataFrame:
    """The columns `keep`, `score` and `predicted` for every row; a null text counts as empty."""
    scored = measured(docs, keep).select(*keep, rules.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
