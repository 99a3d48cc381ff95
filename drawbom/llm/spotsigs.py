"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

A signature is the chain of the next content words after a run of anchors. The
fingerprint of a text is the set of its signatures. Sets whose sizes differ too much
cannot be alike, so comparisons are pruned, and pairs are only looked for between
neighbouring partitions of set size. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from drawbom.llm.shared import settle

# Common words of English, German, French and Spanish.
ANCHORS = ("the of and to in is that for was with it on a by "
           "der die und das den von zu mit ist ein eine des "
           "le la de les et un en que une est dans pour "
           "el y los se del las por es con para").split()
CHAIN, RUN = 3, 8


def signed(df: DataFrame, column: str, name: str, chain: int = CHAIN, anchors: list[str] = ANCHORS, run: int = RUN) -> DataFrame:
    """df with `name`, the sorted set of 32-bit signatures of a text column.

    The start of a text counts as an anchor, and so does every `run`-th word of a
    stretch without one, so that texts with few common words have signatures too. A
    text without words, or null, has none.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"[^\p{L}\p{N}]++", " "))
    parts = F.split(F.concat(F.lit(" "), words, F.lit(" ")), " (?:(?:" + "|".join(anchors) + ") )++")
    cut = "(?<![^ ])((?:[^ ]++ ){%d}[^ ]++) " % (run - 1)
    short = F.transform(parts, lambda p: F.when(F.length(p) < 2 * run, F.array(F.trim(p))).otherwise(F.split(F.regexp_replace(F.trim(p), cut, "$1\x1e"), "\x1e")))
    spots = F.filter(F.flatten(short), lambda p: p != "")
    chains = F.transform(F.sequence(F.lit(1), F.size("_spots")), lambda i: F.hash(F.substring_index(F.array_join(F.slice(F.col("_spots"), i, chain), " "), " ", chain)))
    signs = F.when(F.size("_spots") == 0, F.array().cast("array<int>")).otherwise(F.array_sort(F.array_distinct(chains)))
    return df.withColumn("_spots", spots).withColumn(name, signs).drop("_spots")


def written(signs: Column) -> Column:
    return F.array_join(F.transform(signs, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard of two sets, 1 for two empty ones, null if one is null. Pairs whose sizes rule out `floor` give 0
    without a comparison."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(large == 0, F.lit(1.0)).when((small == 0) | (small < large * floor), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def following(docs: DataFrame) -> DataFrame:
    """`doc_id, next_id, half`: the next larger doc_id, after the last the first, and half the
    characters of the document. Ids are sorted in ranges; only the first id of each range
    is looked at across ranges."""
    ids = settle(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce(F.length("text"), F.lit(0))).alias("n"), F.max(F.coalesce(F.length("text"), F.lit(0))).alias("m"))
                 .repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "ids")
    firsts = ids.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), F.min("first").over(order)).alias("after"))
    own = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return settle(ids.withColumn("own", own).join(after, "part").select("doc_id", F.coalesce("own", "after").alias("next_id"), F.expr("m div 2").cast("int").alias("half")), "following")


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """`doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`
    for every row of docs(doc_id, text).

    The edited text has its last half replaced by as many first characters of the next
    document. A null text is empty. A repeated doc_id gives a row each; as a next
    document it stands for the least of its texts. A row without doc_id has no next
    document: the replaced half is left out and near_next is null. An empty table gives
    no rows; extra columns are ignored.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = texts.filter("doc_id IS NOT NULL")
    nexts = following(known)
    wanted = nexts.select(F.col("doc_id").alias("owner"), F.col("next_id").alias("doc_id"), "half")
    heads = known.join(wanted, "doc_id").select("owner", F.expr("substr(text, 1, half)").alias("head"), "text")
    if known.count() > nexts.count():
        heads = heads.groupBy("owner").agg(F.min("text").alias("text"), F.min("head").alias("head"))
    heads = signed(heads, "text", "next_signs", chain).select(F.col("owner").alias("doc_id"), "head", "next_signs")
    alone = texts.filter("doc_id IS NULL").select("doc_id", "text", F.lit("").alias("head"), F.lit(None).cast("array<int>").alias("next_signs"))
    rows = known.join(heads, "doc_id").select("doc_id", "text", "head", "next_signs").unionByName(alone)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(F.expr("substr(text, 1, CAST(n_chars - n_chars div 2 AS INT))"), F.expr("substr(head, 1, CAST(n_chars div 2 AS INT))"))
    both = signed(signed(rows.withColumn("edited", edited), "text", "a", chain), "edited", "b", chain)
    return both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("a")).alias("fingerprint"), written(F.col("b")).alias("edited_fingerprint"),
                       likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_signs")).alias("near_next"))


def near_pairs(docs: DataFrame, floor: float = 0.8, chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints of likeness `floor` or more, and the members.

    Returns pairs(a, b, likeness) over class ids, a < b, and members(doc_id, class_id); a
    class holds the documents of one fingerprint under its smallest doc_id. Sets fall into
    partitions of size by powers of 1 / floor, so alike sets are in one or in neighbouring
    partitions. Two such sets share one of their |s| - ceil(floor |s|) + 1 rarest
    signatures, which alone are joined. Rows without doc_id or signatures are left out.
    """
    sets = settle(signed(docs.filter("doc_id IS NOT NULL").select("doc_id", "text"), "text", "signs", chain).drop("text").filter(F.size("signs") > 0)
                  .withColumn("print", F.sha2(F.array_join(F.col("signs").cast("array<string>"), ","), 256)), "sets")
    classes = settle(sets.groupBy("print").agg(F.min("doc_id").alias("class_id")), "classes")
    members = settle(sets.select("doc_id", "print").join(classes, "print").select("doc_id", "class_id"), "members")
    firsts = settle(sets.join(classes, "print").filter("doc_id = class_id").select("class_id", "signs").dropDuplicates(["class_id"]), "firsts")
    held = firsts.select("class_id", F.size("signs").alias("n"), F.explode("signs").alias("s"))
    seen = settle(held.groupBy("s").agg(F.count("*").alias("uses")), "uses")
    ranked = held.join(seen, "s").groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("uses", "s"))).alias("rare"))
    keep = F.col("n") - F.ceil(F.col("n") * floor - 1e-9).cast("int") + 1
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / floor) + 1e-9).cast("int")
    probes = settle(ranked.select("class_id", "n", size_class.alias("part"), F.explode(F.slice("rare", F.lit(1), keep)).alias("r")).select("class_id", "n", "part", "r.s"), "probes")
    left = probes.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = probes.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "s", "part")
    met = left.join(right, ["s", "part"]).filter((F.least("na", "nb") >= F.greatest("na", "nb") * floor) & (F.col("a") != F.col("b")))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = (met.join(firsts.select(F.col("class_id").alias("a"), F.col("signs").alias("x")), "a").join(firsts.select(F.col("class_id").alias("b"), F.col("signs").alias("y")), "b")
             .select("a", "b", likeness(F.col("x"), F.col("y"), floor).alias("likeness")).filter(F.col("likeness") >= floor))
    return pairs, members
