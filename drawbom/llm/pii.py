"""Personal data in text: fixed formats, and candidates judged by boosted trees.

Everything is a Spark expression. High-recall generators propose spans, which may
overlap; features of their format and context are small integers, so all candidates
of the corpus fit one table of counts by feature values. Trees are boosted on those
that touch no fixed format, as only they can be added; labels are known secrets and
context words of the candidate's own kind. The threshold is set for a wanted precision,
and trees and threshold go back into expressions. Fixed formats always stay.

Work per text grows with its length and, by a logarithm more, with its spans: positions
come from prefix sums in doubling passes, what a candidate touches from a binary search,
and text is cut from parts of equal length, never from its start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from drawbom.llm.shared import settle

KINDS = ["email", "ip", "card", "phone", "key"]
# Runs can only start where a run of their characters starts, or where a match ended:
# the matches are those of the plain patterns, without retries inside long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PARTS = r"^0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(\.0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
# Generators: anything like a number, an address, an opaque token.
# A number gives back what follows its last digit; a local part stops before [at].
NUMBER = r"(?<![0-9A-Za-z.(+-])[+(]?[0-9][0-9\x20().-]{6,29}[0-9](?![0-9A-Za-z])"
ADDRESS = r"(?<![^\s@])(?![\[(]at[\])]|[\s@])[^\s@(\[]*+(?:[(\[](?!at[\])])[^\s@(\[]*+)*+(?:@|[(\[]at[\])])[^\s@]++"
TOKEN = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+"
KEY = r"^(AKIA[0-9A-Z]{16}|[0-9a-f]{40}|gh[pousr]_[A-Za-z0-9]{36})$"
CONTEXT = r"(?i)(tel|phone|call|fax|mobile|card|visa|mail|contact|token|key|secret|passw|login|user|addr|ssn|iban)[^\n]{0,12}$"
# Words ahead that name a kind, as whole words; which candidates they may confirm is in `seed`.
NAMES = {"phone": "tel|telephone|phone|call|fax|mobile|cell", "card": "card|visa|mastercard", "id": "ssn|social security|iban",
         "mail": "e-?mail|mail|contact|write to", "secret": "token|key|secret|password|passwd"}
PART = 8                              # texts are cut in parts of 2 ** PART code points
FEATURES = ["gen", "size", "digits", "lower", "upper", "marks", "luhn", "plus", "hint", "groups"]


def let(value: str, name: str, body: str) -> str:
    """SQL for `body` with `name` standing for `value`, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def levels(n: str) -> str:
    """SQL for the array 0, 1, ... of the powers of two below n."""
    return f"CASE WHEN {n} > 1 THEN sequence(0, CAST(ceil(log2({n})) AS INT) - 1) ELSE CAST(array() AS array<int>) END"


def running(values: str, step: str) -> str:
    """SQL for the prefix sums or maxima of an array; `step` combines x and y."""
    return let(values, "v", f"aggregate({levels('size(v)')}, v, (acc, j) -> transform(acc, (x, i) -> CASE WHEN i >= shiftleft(1, j) THEN "
               + let("acc[i - shiftleft(1, j)]", "y", step) + " ELSE x END))")


def parts(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{1 << PART}}}', 0)"


def cut(pieces: str, a: str, b: str) -> str:
    """SQL for the code points a to b (exclusive) of a text given in `parts`."""
    return (f"CASE WHEN {b} > {a} THEN substr(array_join(transform(sequence(shiftright({a}, {PART}), shiftright({b} - 1, {PART})), q -> {pieces}[q]), ''), "
            f"({a} & {(1 << PART) - 1}) + 1, {b} - {a}) ELSE '' END")


def matches(text: str, pattern: str) -> str:
    """SQL for an array of (start, end, m) of a pattern's matches, leftmost and without
    overlaps; positions are code points. The gaps come from splitting by the pattern."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    ends = running(f"zip_with(m, split({text}, '{p}', -1), (a, b) -> length(a) + length(b))", "x + y")
    placed = let(ends, "e", "transform(m, (a, i) -> struct(e[i] - length(a) AS start, e[i] AS end, a AS m))")
    return (f"CASE WHEN {text} RLIKE '{p}' THEN {let(f"regexp_extract_all({text}, '{p}', 0)", 'm', placed)} "
            "ELSE CAST(array() AS array<struct<start:int,end:int,m:string>>) END")


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(d: str) -> str:
    """SQL for whether the digits d pass; no number of more than 64 digits does."""
    digit = "CAST(substr(r, i, 1) AS INT)"
    return (f"(length({d}) BETWEEN 2 AND 64 AND " + let(f"reverse({d})", "r", "aggregate(sequence(1, greatest(1, length(r))), 0, "
            f"(acc, i) -> acc + CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0") + ")")


def base_spans(text: str = "_text") -> Column:
    """Array of (start, k, end) of the fixed formats, k by KINDS."""
    def kind(k: int, pattern: str, valid: str = "true", guard: str = "true") -> str:
        return f"CASE WHEN {guard} THEN transform(filter({matches(text, pattern)}, x -> {valid}), x -> struct(x.start AS start, {k} AS k, x.end AS end)) ELSE CAST(array() AS array<struct<start:int,k:int,end:int>>) END"
    ip_parts = IP_PARTS.replace("\\", "\\\\")
    return F.expr("sort_array(concat(" + ", ".join([
        kind(0, EMAIL, guard=f"contains({text}, '@')"), kind(1, IP, f"x.m RLIKE '{ip_parts}'"), kind(2, CARD, luhn(digits("x.m"))),
        kind(3, PHONE, f"length({digits('x.m')}) BETWEEN 10 AND 15", f"contains({text}, '+')")]) + "))")


def named(ahead: str, *kinds: str) -> str:
    """SQL for whether a word of one of the kinds stands close before the end of `ahead`."""
    return f"({ahead} RLIKE '(?i)(?<![a-z])({'|'.join(NAMES[k] for k in kinds)})(?![a-z])[^\\\\n0-9]{{0,12}}$')"


def seed(gen: int) -> str:
    """SQL for whether the context names the kind of candidate x, and its form allows that kind."""
    nd = "length(x.d)"
    if gen == 0:
        return f"({nd} BETWEEN 7 AND 15 AND {named('x.ahead', 'phone')} OR {nd} BETWEEN 13 AND 19 AND x.luhn AND {named('x.ahead', 'card')} OR ({nd} = 9 OR {nd} >= 12) AND {named('x.ahead', 'id')})"
    if gen == 1:
        return named("x.ahead", "mail")
    return f"(x.m RLIKE '[A-Za-z]' AND {named('x.ahead', 'secret')} OR {nd} >= 12 AND {named('x.ahead', 'id')})"


def free(x: str) -> str:
    """SQL for whether x touches no span of `base`: of the spans that begin before its end,
    counted by binary search, the farthest end (`_reach`) is not past its start."""
    bit = "shiftleft(1, j)"
    before = (f"aggregate(reverse({levels('size(base) + 1')}), 0, (acc, j) -> CASE WHEN acc + {bit} <= size(base) AND base[acc + {bit} - 1].start < {x}.end "
              f"THEN acc + {bit} ELSE acc END)")
    return let(before, "n", f"CASE WHEN n = 0 THEN true ELSE _reach[n - 1] <= {x}.start END")


def proposals(text: str = "_text") -> Column:
    """Array of candidates: start, end, FEATURES, `label`, whether it is a known form of
    key or its context names its kind, and `free`, whether it touches no fixed format."""
    key, context = KEY.replace("\\", "\\\\"), CONTEXT.replace("\\", "\\\\")

    def made(gen: int, pattern: str, guard: str) -> str:
        size, nd = "length(x.m)", "length(x.d)"
        read = f"transform({matches(text, pattern)}, x -> struct(x.start AS start, x.end AS end, x.m AS m, {cut('_parts', 'greatest(0, x.start - 28)', 'x.start')} AS ahead, {digits('x.m')} AS d))"
        read = f"transform({read}, x -> struct(x.start AS start, x.end AS end, x.m AS m, x.ahead AS ahead, x.d AS d, {luhn('x.d')} AS luhn))"
        return (f"CASE WHEN {guard} THEN transform({read}, x -> struct(x.start AS start, x.end AS end, {gen} AS gen, "
                f"CASE WHEN {size} <= 10 THEN 0 WHEN {size} <= 13 THEN 1 WHEN {size} <= 16 THEN 2 WHEN {size} <= 20 THEN 3 WHEN {size} <= 36 THEN 4 ELSE 5 END AS size, "
                f"CASE WHEN {nd} < 6 THEN 0 WHEN {nd} < 10 THEN 1 WHEN {nd} < 12 THEN 2 WHEN {nd} < 14 THEN 3 WHEN {nd} < 20 THEN 4 ELSE 5 END AS digits, "
                f"CAST(x.m RLIKE '[a-z]' AS INT) AS lower, CAST(x.m RLIKE '[A-Z]' AS INT) AS upper, least(3, length(regexp_replace(x.m, '[^.@]', ''))) AS marks, "
                f"CAST(x.luhn AS INT) AS luhn, CAST(startswith(x.m, '+') AS INT) AS plus, CASE WHEN {named('x.ahead', *NAMES)} THEN 2 WHEN x.ahead RLIKE '{context}' THEN 1 ELSE 0 END AS hint, "
                f"least(5, size(split(x.m, '[^0-9A-Za-z]+'))) AS groups, CAST(x.m RLIKE '{key}' OR {seed(gen)} AS INT) AS label, {free('x')} AS free)) "
                "ELSE CAST(array() AS array<struct<start:int,end:int," + ",".join(f"{f}:int" for f in FEATURES) + ",label:int,free:boolean>>) END")
    digit = f"{text} RLIKE '[0-9]'"
    return F.expr("concat(" + ", ".join([made(0, NUMBER, digit), made(1, ADDRESS, f"{text} RLIKE '@|[\\\\[(]at[\\\\])]'"), made(2, TOKEN, digit)]) + ")")


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `base`, the spans of fixed formats, and `found`, the candidates; null text is
    empty. Columns `base`, `found`, `_text`, `_parts` and `_reach` of docs are replaced or dropped."""
    read = docs.withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("base", base_spans())
    return read.withColumns({"_parts": F.expr(parts("_text")), "_reach": F.expr(running("transform(base, b -> b.end)", "greatest(x, y)"))}).withColumn("found", proposals()).drop("_text", "_parts", "_reach")


@dataclass
class Trees:
    leaves: list      # (value, [(feature, at most?, cut)]) of all trees
    bias: float
    threshold: float

    def score(self, x: str) -> str:
        """SQL for the logit of a candidate x."""
        terms = [f"CASE WHEN {' AND '.join(f'{x}.{f} {'<=' if low else '>'} {c}' for f, low, c in tests)} THEN {v!r}D ELSE 0D END" for v, tests in self.leaves]
        return " + ".join([f"{self.bias!r}D", *terms])


def fit(table: DataFrame, trees: int = 20, depth: int = 3, rate: float = 0.3, precision: float = 0.98) -> Trees:
    """Boosted trees on the counts of the candidates that touch no fixed format, by feature values.

    The counts have at most one row per combination of the features' few levels. The
    threshold is the least score above which a share `precision` of these candidates is
    confirmed by its label; without candidates or labels nothing is added.
    """
    rows = table.select(F.explode(F.expr("filter(found, c -> c.free)")).alias("c")).groupBy(*[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.sum("c.label").alias("p")).collect()
    rows = sorted(tuple(r) for r in rows)
    if not rows:
        return Trees([], -9.0, 9.0)
    data = np.array(rows, float)
    x, n, p = data[:, :-2], data[:, -2], data[:, -1]
    share = min(max(p.sum() / n.sum(), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    margin, leaves, stumps = np.full(len(n), bias), [], []

    def grow(at, tests, g, h):
        best, split = 1e-6, None
        if len(tests) < depth:
            G, H = g[at].sum(), h[at].sum()
            for j in range(x.shape[1]):
                for c in np.unique(x[at, j])[:-1]:
                    low = x[at, j] <= c
                    a, b = g[at][low].sum(), h[at][low].sum()
                    gain = a * a / (b + 1) + (G - a) ** 2 / (H - b + 1) - G * G / (H + 1)
                    if gain > best:
                        best, split = gain, (j, c)
        if split is None:
            value = rate * g[at].sum() / (h[at].sum() + 1)
            margin[at] += value
            if tests:
                leaves.append((float(value), list(tests)))
            else:
                stumps.append(float(value))
            return
        j, c = split
        low = x[at, j] <= c
        grow(at[low], [*tests, (FEATURES[j], True, int(c))], g, h)
        grow(at[~low], [*tests, (FEATURES[j], False, int(c))], g, h)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(n)), [], p - n * q, n * q * (1 - q))
    order = np.argsort(-margin, kind="stable")
    right, total, threshold = np.cumsum(p[order]), np.cumsum(n[order]), np.inf
    for i in range(len(order)):
        last = i == len(order) - 1 or margin[order[i + 1]] < margin[order[i]] - 1e-9
        if last and right[i] >= precision * total[i]:
            threshold = margin[order[i]] - 1e-6
    return Trees(leaves, bias + sum(stumps), float(min(threshold, 1e6)))


def decide(table: DataFrame, trees: Trees) -> DataFrame:
    """`table` with `spans`: the fixed formats and the accepted candidates that touch none of them."""
    kind = "CASE WHEN c.gen = 1 THEN 0 WHEN c.gen = 2 THEN 4 WHEN c.marks = 3 AND c.groups = 4 THEN 1 WHEN c.digits >= 4 THEN 2 ELSE 3 END"
    added = (f"transform(filter(found, c -> c.free AND {trees.score('c')} >= {trees.threshold!r}D), "
             f"c -> struct(c.start AS start, {kind} AS k, c.end AS end))")
    return table.withColumn("spans", F.expr(let(f"sort_array(concat(base, {added}))", "s", "filter(s, (x, i) -> i = 0 OR x != s[i - 1])")))


def written(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at({names}, s.k + 1), ':', s.start, ':', s.end)), ',')")


def report(decided: DataFrame) -> DataFrame:
    """`doc_id`, counts and digest of the fixed formats, and all spans as text."""
    counts = [F.expr(f"CAST(size(filter(base, s -> s.k = {k})) AS BIGINT)").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return decided.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def masked(spans: str) -> Column:
    """`text` with each span replaced by its kind in brackets, overlapping ones together."""
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    heads = (f"filter(transform({spans}, (s, i) -> struct(s.start AS start, s.k AS k, CASE WHEN i = 0 THEN 0 ELSE reach[i - 1] END AS since, i = 0 AS leads)), h -> h.leads OR h.start >= h.since)")
    joined = f"array_join(transform({heads}, h -> concat({cut('p', 'h.since', 'h.start')}, element_at({names}, h.k + 1))), '')"
    rest = let("element_at(reach, -1)", "at", cut("p", "at", "length(text)"))
    rebuilt = let(parts("text"), "p", let(running(f"transform({spans}, s -> s.end)", "greatest(x, y)"), "reach", f"concat({joined}, {rest})"))
    return F.when(F.expr(f"size({spans}) > 0"), F.expr(rebuilt)).otherwise(F.col("text"))


def redact(docs: DataFrame, trees: Trees, again: int = 2) -> DataFrame:
    """docs with every span of `text` replaced by its kind; a null text stays null.

    A number that was part of a longer run can become a fixed format when its
    neighbour is gone, so changed texts are read `again` times for fixed formats.
    """
    out = decide(candidates(docs), trees).withColumn("text", masked("spans")).drop("base", "found")
    for _ in range(again):
        out = out.withColumn("_text", F.when(F.size("spans") > 0, F.col("text")).otherwise("")).withColumn("spans", base_spans()).drop("_text").withColumn("text", masked("spans"))
    return out.drop("spans")


def detect(docs: DataFrame) -> DataFrame:
    """The report over every row of docs(doc_id, text); repeated rows each give a row, an
    empty table none, and extra columns are ignored."""
    table = settle(candidates(docs.select("doc_id", "text")).drop("text"), "candidates")
    return report(decide(table, fit(table)))
