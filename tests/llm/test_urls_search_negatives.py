"""URL rules, ranked search and hard negatives against brute force, with awkward rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawbom.llm import hardneg, quality, queries, ranked, urlrules
from helpers import awkward, empty

PAGES = "page_id long, url string, html string"


def pages(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        name, tld, lang = rng.choice(["pills", "news", "shop", "blog"]), rng.choice(["net", "com", "org"]), rng.choice(["en", "de", "fr", "es"])
        rows.append((i, f"http{rng.choice(['', 's'])}://www.{name}.example.{tld}/{lang}/{i}{rng.choice(['', '/', '.html'])}{rng.choice(['', '?a=1&b', '#top'])}", "x"))
    rows += [(500, None, None), (501, "", ""), (502, "no scheme/net/", ""), (503, "HTTP://A.NET/De", ""), (504, "x://net?q", ""), (505, "x://Net/", ""), (506, "x://ornet/", ""),
             (507, "http://e.example.net/en/" + "a/" * 50000, ""), (508, "a://b://example.com/de/", ""), (509, "x://É.ORG/fr/", ""), (510, "x://y.com/%20?", None), (3, rows[3][1], "x"), (3, rows[3][1], "x"), (None, rows[5][1], ""), (None, None, None)]
    return spark.createDataFrame(rows, PAGES)


def by_hand(url):
    """(host, path, rule, verdict)."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = [r for r in urlrules.FIXED if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best and best[1] + best[2], best and best[0]


def test_fixed_rules(spark):
    data = pages(spark).withColumn("rule", F.lit("clash")).withColumn("tokens", F.lit("clash")).withColumn("copies", F.lit(7))
    none = spark.createDataFrame([], urlrules.MINED)
    got = urlrules.judge(data, none).collect()
    want = sorted(((p, *by_hand(u)) for p, u, _ in pages(spark).collect()), key=repr)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got), key=repr) == want
    assert {r["verdict"] for r in got if not r["rule"]} == {"allow"}
    assert urlrules.judge(data.limit(0), none).count() == 0


def brute_rules(rows, support, confidence, one_source):
    """Every token combination counted outright."""
    total, n, by, by_source = len(rows), Counter(), Counter(), Counter()
    for tokens, verdict, source in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                n[c] += 1
                by[c, verdict] += 1
                by_source[c, source] += 1
    least = math.ceil(support * total)
    restated = {c for (c, s), m in by_source.items() if m >= least and m / n[c] >= one_source}
    rules = {(c, v): m / n[c] for (c, v), m in by.items() if m >= least and m / n[c] >= confidence and c not in restated}
    return {(c, v): p for (c, v), p in rules.items() if not any(rules.get((s, v), -1) >= p for k in range(1, len(c)) for s in combinations(c, k))}


def labelled(spark):
    rng = random.Random(8)
    rows = []
    for i in range(600):
        name, lang, key = rng.choice(["pills", "news", "shop"]), rng.choice(["en", "de"]), rng.choice(["ref", "page"])
        bad = (name == "pills" and key == "ref") or (lang == "de" and name == "shop")
        rows.append((f"http://{name}.com/{lang}/{i}?{key}=1", "block" if bad != (rng.random() < 0.03) else "allow", rng.choice("ab")))
    rows += [("http://news.com/en/1", None, "a"), (None, "block", "a"), ("nothing", "block", None), ("http://news.com/en/2?page=1", "allow", None)]
    return spark.createDataFrame(rows, "url string, verdict string, source string")


def test_mined_rules_and_index(spark):
    data = labelled(spark).withColumn("token", F.lit("clash")).withColumn("n", F.lit(1))
    mined = urlrules.mine(data, min_support=0.02, min_confidence=0.85, width=20)
    rows = [(r["t"], r["verdict"], r["source"] or "") for r in data.select(urlrules.tokens_of().alias("t"), "verdict", "source").collect() if r["verdict"] and r["t"]]
    want = brute_rules(rows, 0.02, 0.85, 0.95)
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in mined.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert (("h:pills", "q:ref"), "block") in got and any(len(c) == 2 for c, _ in got)
    urls = [("http://pills.com/en/9?ref=2",), ("http://news.com/en/9?ref=2",), ("http://shop.com/de/1",), ("http://unknown.info/",), (None,)]
    judged = {r["page_id"]: (r["verdict"], r["confidence"]) for r in urlrules.judge(spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "page_id long, url string"), mined, rules=[]).collect()}
    for i, (u,) in enumerate(urls):
        tokens = set(spark.createDataFrame([(u,)], "url string").select(urlrules.tokens_of()).first()[0])
        fits = [p for (c, _), p in want.items() if set(c) <= tokens]
        assert judged[i][1] == (pytest.approx(max(fits)) if fits else None)
    assert judged[0][0] == judged[2][0] == "block" and judged[1][0] == judged[3][0] == judged[4][0] == "allow"


def test_one_source_is_no_evidence(spark):
    rows = [(f"http://a.com/es/{i}", "block", "net/") for i in range(50)] + [(f"http://b.com/en/{i}", "allow", "org/") for i in range(50)]
    assert urlrules.mine(spark.createDataFrame(rows, "url string, verdict string, source string")).count() == 0
    assert urlrules.mine(spark.createDataFrame([], "url string, verdict string, source string")).count() == 0


def test_wide_urls_do_not_explode(spark):
    wide = "http://x.com/" + "/".join(f"part{chr(97 + i)}" for i in range(26)) + "/"
    rows = [(wide, "block", "ab"[i % 2]) for i in range(200)]
    mined = urlrules.mine(spark.createDataFrame(rows, "url string, verdict string, source string"))
    assert 1 <= mined.count() <= 12 and mined.filter("size(antecedent) > 1").count() == 0


def brute_ranking(docs, items, k):
    terms = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in counts if c]
    N, L, df = len(held), sum(n for _, _, n in held), Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 20 * (50 + 50 * n * N // L))) for w in set(terms(text)) if c[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, block, shard, parts", [(50, 1000, 1 << 21, 1), (3, 2, 300, 5), (7, 1000, 1, 3)])
def test_ranking(spark, k, block, shard, parts):
    docs = awkward(spark).repartition(parts)
    texts = docs.select("doc_id", "text").collect()
    items = [(1, texts[0]["text"]), (2, "The HOUSE of old"), (3, None), (4, ""), (5, "zzz nothing"), (6, "é"), (7, "x" * 200000), (8, "word word"), (9, " ".join(r["text"] or "" for r in texts)[:60000])]
    got = ranked.ranked(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")), k=k, block=block, shard=shard)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_ranking([tuple(r) for r in texts], items, k)


def test_ranking_of_nothing(spark):
    items = spark.createDataFrame([(1, "house")], "item_id long, text string")
    assert ranked.ranked(empty(spark), items).count() == 0 and ranked.ranked(awkward(spark), items.limit(0)).count() == 0


def test_words_in_pieces():
    text = ("Ab1 é\u0085x _" + "long" * 50 + "-").encode() * 7
    whole = [w for ws in ranked.words_of(text) for w in ws]
    assert all([w for ws in ranked.words_of(text, step) for w in ws] == whole for step in (1, 2, 3, 17, 64, 300))


def test_lists_are_read_until_all_is_settled():
    rng = np.random.default_rng(3)
    for trial in range(60):
        n, k = int(rng.integers(1, 400)), int(rng.integers(1, 12))
        lists, total = [], np.zeros(n, np.int64)
        for _ in range(int(rng.integers(1, 9))):
            places = rng.permutation(n)[:int(rng.integers(1, n + 1))]
            impacts = -np.sort(-rng.integers(1, int(rng.choice([3, 1000])), len(places)))
            lists.append((places, impacts))
            total[places] += impacts
        floor = int(rng.choice([0, np.sort(total)[-1], np.median(total)]))
        places, scores = ranked.read_lists(lists, n, k, floor, depth=2)
        assert (total[places] == scores).all()
        bar = max(floor, 1, np.sort(total)[-k] if n >= k else 0)
        assert set(np.flatnonzero(total >= bar)) <= set(places)


def vectors(spark, n=260, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, dims))
    rows = [(i, [float(x) for x in np.float32((middle[i % 5] + 0.4 * rng.normal(size=dims)) / 2)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n + i, rows[0][1], i % 3) for i in range(120)]                      # one common vector
    rows += [(900, None, 1), (901, [None] * dims, 1), (902, [float("nan")] * dims, 1), (903, [float("inf")] * dims, 0), (904, [0.0] * dims, 0), (905, [0.5], 1), (906, [], 2), (907, rows[1][1], None),
             (None, rows[2][1], 1), (20, rows[20][1], rows[20][2]), (1000, [-x for x in rows[0][1]], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute_negatives(rows, every, k):
    kept = {}
    for i, x, label in rows:
        if i is not None and x is not None and label is not None and all(c is not None and math.isfinite(c) for c in x):
            kept[i, tuple(math.floor(256 * c) for c in x), label] = None
    out = []
    for a, x, label in kept:
        if a % every:
            continue
        dot = lambda y: sum(p * q for p, q in zip(x, y))
        near = sorted((-dot(y), i) for i, y, m in kept if m == label and i != a)[:k]
        for p, i in near:
            fits = sorted((-dot(y), j) for j, y, m in kept if m != label and 80 * -p <= 100 * dot(y) <= 100 * -p)[:k]
            out += [(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("leaf, fan, sample", [(4096, 16, 20000), (20, 4, 20000), (8, 3, 50)])
def test_hard_negatives(spark, leaf, fan, sample):
    data = vectors(spark)
    got = hardneg.hard_negatives(data.withColumn("v", F.lit("clash")).withColumn("leaf", F.lit("clash")), F.col("vec_id") % 4 == 0, leaf=leaf, fan=fan, sample=sample)
    assert sorted(map(tuple, got.collect())) == brute_negatives([tuple(r) for r in data.collect()], 4, 5)


def test_hard_negatives_of_little(spark):
    data = vectors(spark)
    assert hardneg.hard_negatives(data.limit(0), F.col("vec_id") % 4 == 0).count() == 0
    assert hardneg.hard_negatives(data.filter("label = 1"), F.col("vec_id") % 4 == 0).count() == 0
    with pytest.raises(Exception, match="too large"):
        hardneg.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 4 == 0).count()


def test_tree_eliminates_leaves(spark):
    """On clustered vectors most leaves are ruled out, without losing a row (see above)."""
    rng = np.random.default_rng(2)
    middle = 4 * rng.normal(size=(12, 8))
    x = np.floor(256 * (middle[np.arange(3000) % 12] + 0.02 * rng.normal(size=(3000, 8)))).astype(np.int32)
    points = spark.createDataFrame([(bytes(v.tobytes()), 0, [i]) for i, v in enumerate(x)], "v binary, label long, ids array<long>")
    nodes = hardneg.grow(x[:600].astype(float), len(x), 100, 6)
    homed = hardneg.dealt(points, nodes, 8).cache()
    table, norms = hardneg.ranges(homed, nodes, 8)
    top = int((x[0].astype(int) ** 2).sum())
    asked = spark.createDataFrame([(1, bytes(x[0].tobytes()), 0, [(int(top * 0.98), None)])], "query long, v binary, label long, windows array<struct<low:long,high:long>>")
    reached = {r["leaf"] for r in hardneg.routed(asked, nodes, table, norms, 8, False).collect()}
    every = {r["leaf"] for r in homed.select("leaf").distinct().collect()}
    assert reached < every and len(reached) <= len(every) / 2
    fits = {r["leaf"] for r, v in zip(homed.collect(), x) if int((v.astype(int) * x[0]).sum()) >= int(top * 0.98)}
    assert fits <= reached


def test_native(spark, tmp_path):
    data = pages(spark)
    plan = urlrules.judge(data, urlrules.mine(urlrules.labels_of(data)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert {"op11_url_rules", "op12_ranked_search", "op13_hard_negatives"} <= queries.QUERIES.keys()


def test_quality_of_ties_and_few_labels(spark):
    """Equal texts with both labels, and 30 different ones: no rule is found, the score is constant."""
    for texts in (["the same words"] * 200, [f"word{'x' * i} and more" for i in range(30)]):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int")
        scores = {r["score"] for r in quality.rate(docs, quality.fit(docs, labels), ["doc_id"]).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1


def test_url_rules_use_every_token_of_long_urls(spark):
    """A URL of thirty frequent tokens: each of them finds the verdict, also alone."""
    parts = [f"part{chr(97 + i)}" for i in range(26)]
    rows = [(f"http://a.org/{'/'.join(parts)}/tail/k{i % 3}", "block", f"s{i % 4}") for i in range(60)] + [(f"http://b.org/k{i % 3}", "allow", f"s{i % 4}") for i in range(60)]
    mined = urlrules.mine(spark.createDataFrame(rows, "url string, verdict string, source string"), min_support=0.02)
    assert {len(r.antecedent) for r in mined.filter("verdict = 'block'").collect()} == {1}
    urls = [(i, f"ftp://c.net/{p}/x") for i, p in enumerate([*parts, "tail"])] + [(99, "ftp://c.net/other")]
    judged = {r.page_id: (r.verdict, r.confidence) for r in urlrules.judge(spark.createDataFrame(urls, "page_id long, url string"), mined, rules=[]).collect()}
    assert judged.pop(99) == ("allow", None) and len(judged) == 27 and set(judged.values()) == {("block", 1.0)}
