"""URL filters by association rules. Native: DataFrame functions and Spark's FP-growth.

A URL is a set of tokens (scheme, host labels, path segments, query keys; digits in
segments become `#`). FP-growth mines token combinations together with the verdict of
labelled URLs; combinations of enough support and confidence become rules, rules that
a shorter one already implies are pruned. A URL is matched through an inverted index
that lists every rule under its rarest token. Fixed rules (host, path) come first.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from drawbom.llm.shared import settle

# Verdict, host, path.
FIXED = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MINED = "antecedent array<string>, verdict string, confidence double, support double, sides map<string,array<string>>, token string"
SALTS = 8


def host_of(url: str = "url") -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str = "url") -> Column:
    """From the end of the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=FIXED) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. A rule fits its
    host and all subdomains where the path starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: str = "url") -> Column:
    """The distinct tokens of a URL; none for null or a text without `://`."""
    said = lambda mark, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))
    folder = F.transform(F.split(path_of(url), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    keys = F.transform(F.split(F.regexp_extract(url, r"(?s)^[^?#]*+\?([^#]*+)", 1), "&"), lambda x: F.substring_index(x, "=", 1))
    scheme = F.array(F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    every = F.concat(said("s:", scheme), said("h:", F.split(host_of(url), r"\.")), said("p:", folder), said("q:", keys))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, one_source: float = 0.95, width: int = 12) -> DataFrame:
    """Rules `antecedent, verdict, confidence, support, token` from labelled(url, verdict,
    source), source naming who gave the label.

    A transaction holds all frequent tokens of a URL, its verdict and its source. Where some
    URL has more than `width` of them, tokens that occur in just the same URLs are mined as one:
    two of them in one rule say no more than one, so no rule is lost, and what such URLs repeat
    adds no subsets. A row then stands for a rule with each of them, listed by token of the
    antecedent in `sides`. Pruned are rules below
    the support or confidence, rules whose URLs nearly all (`one_source`) carry labels of
    one source, as they would only restate it, and rules with a shorter one inside that has the
    same verdict and at least their confidence. `token` is the rarest of a rule. Rows
    with a null verdict or without tokens do not count; an empty table gives no rules.
    Order, repeats and extra columns do not matter beyond the counts.
    """
    spark = labelled.sparkSession
    rows = settle(labelled.filter("verdict IS NOT NULL").select(
        tokens_of().alias("t"), F.concat(F.lit("verdict:"), "verdict").alias("v"), F.concat(F.lit("source:"), F.coalesce("source", F.lit(""))).alias("o")).filter("size(t) > 0").withColumn("k", F.monotonically_increasing_id()), "url-labels")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], MINED)
    least = max(1, round(min_support * total))
    seen = rows.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # At most tokens-per-URL / min_support rows, whatever the size of the table.
    known = settle(seen.filter(F.col("n") >= least), "url-tokens")
    # Equal sums of two hashes of the URLs: equal sets of URLs.
    frequent = settle(rows.select("k", "v", "o", F.explode("t").alias("token")).join(known.select("token"), "token"), "url-frequent")
    long_ = frequent.groupBy("k").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    sums = [F.sum(F.xxhash64("k", F.lit(i)).cast("decimal(38,0)")).alias(f"_{i}") for i in (0, 1)]
    sets = frequent.groupBy("token").agg(F.count("*").alias("n"), *sums) if (long_ or 0) > width else known.select("token", F.col("token").alias("n"), F.lit(0).alias("_0"), F.lit(0).alias("_1"))
    classes = settle(sets.groupBy("n", "_0", "_1").agg(F.min("token").alias("lead"), F.collect_list("token").alias("members")).select("lead", "members"), "url-classes")
    kept = frequent.join(classes.select(F.col("lead").alias("token")), "token", "left_semi").groupBy("k", "v", "o").agg(F.collect_list("token").alias("best"))
    baskets = kept.select(F.concat("best", F.array("v", "o")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min(min_confidence, one_source)).fit(baskets)
    to = F.col("consequent")[0]
    plain = ~F.exists("antecedent", lambda x: x.startswith("verdict:") | x.startswith("source:"))
    found = settle(model.associationRules.filter(plain & (to.startswith("verdict:") | to.startswith("source:"))).select(
        F.array_sort("antecedent").alias("antecedent"), to.alias("to"), "confidence", "support"), "url-rules")
    restated = found.filter(to_source := F.col("to").startswith("source:")).filter(F.col("confidence") >= one_source).select("antecedent")
    rules = found.filter(~to_source & (F.col("confidence") >= min_confidence)).join(restated, "antecedent", "left_anti").select(
        F.monotonically_increasing_id().alias("rule"), "antecedent", F.substring("to", 9, 1 << 30).alias("verdict"), "confidence", "support")
    rules = settle(rules, "url-rules")
    # A shorter rule inside a longer one is found under one of its own tokens.
    short = rules.select(F.col("antecedent").alias("inner"), "verdict", F.col("confidence").alias("c"), F.col("antecedent")[0].alias("token"))
    implied = (rules.select("rule", "antecedent", "verdict", "confidence", F.explode("antecedent").alias("token")).join(short, ["token", "verdict"])
               .filter((F.size("inner") < F.size("antecedent")) & (F.size(F.array_except("inner", "antecedent")) == 0) & (F.col("c") >= F.col("confidence"))).select("rule").distinct())
    left = rules.join(implied, "rule", "left_anti")
    sides = left.select("rule", F.explode("antecedent").alias("lead")).join(classes, "lead").groupBy("rule").agg(F.map_from_entries(F.collect_list(F.struct("lead", "members"))).alias("sides"))
    left = settle(left.join(sides, "rule"), "url-sides")
    rarest = left.select("rule", F.explode("antecedent").alias("token")).join(known, "token").groupBy("rule").agg(F.min(F.struct("n", "token")).token.alias("token"))
    return settle(left.join(rarest, "rule").drop("rule"), "url-index")


def judge(pages: DataFrame, mined: DataFrame, rules=FIXED, default: str = "allow") -> DataFrame:
    """`page_id, host, path, rule, verdict, confidence` for every row of pages(page_id, url).

    The longest fixed rule decides; else the mined rule of the highest confidence, then
    support, then length (then the smallest texts) whose tokens the URL has; else `default`, with null
    confidence. Null URLs and texts without `://` have empty host and path. Repeated
    rows are returned as often as they occur, and null page_ids are kept. Extra columns are ignored.
    """
    same = pages.groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    host, path = host_of(), path_of()
    rule, said = fixed_rule(host, path, rules)
    seen = settle(same.select("page_id", "url", "copies", host.alias("host"), path.alias("path"), rule.alias("rule"), said.alias("said"), tokens_of().alias("tokens")), "urls")
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))
    index = mined.withColumn("token", F.explode(F.element_at("sides", F.col("token")))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    open_ = seen.filter("rule IS NULL").select("page_id", "url", "tokens", salt.alias("salt"), F.explode("tokens").alias("token"))
    met = F.array_sort(F.transform("antecedent", lambda t: F.array_max(F.array_intersect(F.element_at("sides", t), "tokens"))))
    hits = open_.join(index, ["salt", "token"]).withColumn("met", met).filter(~F.exists("met", lambda t: t.isNull()))
    order = F.struct("confidence", "support", F.size("antecedent").alias("n"), F.array_join("met", " ").alias("name"), "verdict")
    best = hits.groupBy(F.col("page_id").alias("_page"), F.col("url").alias("_url")).agg(F.max(order).alias("best"))
    joined = seen.join(best, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("url") == F.col("_url")), "left")
    out = joined.select("page_id", "host", "path", "rule", F.coalesce("said", "best.verdict", F.lit(default)).alias("verdict"), F.col("best.confidence").alias("confidence"), "copies")
    return out.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def labels_of(pages: DataFrame, rules=FIXED) -> DataFrame:
    """`url, verdict, source`: what the fixed rules say, as labels to mine."""
    rule, said = fixed_rule(host_of(), path_of(), rules)
    return pages.select("url", said.alias("verdict"), rule.alias("source")).filter("verdict IS NOT NULL")
