"""The queries of this subpackage and, where SQL can express one, its checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from drawbom.llm import decontaminate, hardneg, langid, licenses, packing, pii, quality, ranked, simhash, spotsigs, suffixes, urlrules, warc

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return keep


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WINDOWS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
cover AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)"""


@query("op1_suffix_array_dedup")
def op1(spark, sf_dir):
    return suffixes.dedup(table(spark, sf_dir, "documents"))


ARCHIVES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
g AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(sha, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM g"""


@query("op2_warc_round_trip", ARCHIVES_SQL)
def op2(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def licences_sql() -> str:
    """The scan in SQL, from the same fixed sentences and rules."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    normal = lambda x: f"trim(regexp_replace({lower.format(x)}, '[^a-z0-9]+', ' ', 'g'))"
    pairs = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    steps, last = [], "r"
    for k, (name, rule) in enumerate(licenses.RULES):
        steps.append(f"r{k} AS (SELECT doc_id, regexp_replace(rest, '{rule}', '', 'g') AS rest, CASE WHEN regexp_matches(rest, '{rule}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"r{k}"
    return rf"""
WITH known(s, id) AS (VALUES {pairs}),
cut AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\n\f\r]+', '\1' || chr(30), 'g'), '\n[ \t]*\n[ \t\n\f\r]*', chr(30), 'g'), chr(30)),
  lambda x: regexp_matches(x, '[0-9A-Za-z]')) AS f FROM documents),
each AS (SELECT doc_id, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM cut),
looked AS (SELECT doc_id, i, coalesce(a.id, b.id) AS id FROM each LEFT JOIN known a ON {normal('x')} = a.s
  LEFT JOIN known b ON contains(x, chr(10)) AND {normal("string_split(x, chr(10))[-1]")} = b.s),
ids AS (SELECT doc_id, list(id ORDER BY i) AS ids FROM looked WHERE id IS NOT NULL GROUP BY doc_id),
r AS (SELECT doc_id, '<' || array_to_string(ids, '><') || '>' AS rest, CAST([] AS VARCHAR[]) AS names FROM ids),
{", ".join(steps)}
SELECT c.doc_id, CAST(len(c.f) AS BIGINT) AS n_sentences, CAST(coalesce(len(ids.ids), 0) AS BIGINT) AS n_known, coalesce(array_to_string(ids.ids, ','), '') AS sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licences
FROM cut c LEFT JOIN ids USING (doc_id) LEFT JOIN {last} USING (doc_id)"""


@query("op3_license_scan", licences_sql())
def op3(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination", WINDOWS_SQL)
def op4(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


@query("op5_best_fit_packing")
def op5(spark, sf_dir):
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op6_language_id")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out("doc_id", 4, 2)
    model = langid.fit(docs.filter(~held))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


@query("op7_personal_data")
def op7(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out("doc_id", 5, 0)
    rules = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held))
    return quality.rate(docs, rules, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op9_spotsigs_fingerprints")
def op9(spark, sf_dir):
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query("op10_simhash_near_dedup")
def op10(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op11_url_rules")
def op11(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages, urlrules.mine(urlrules.labels_of(pages)))


RANKED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS ll FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, t, any_value(n) AS n, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM b) GROUP BY doc_id, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM p JOIN f USING (t) JOIN b USING (t), c GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50"""


@query("op12_ranked_search", RANKED_SQL)
def op12(spark, sf_dir):
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


NEGATIVES_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_sum(list_transform(range(1, len(b.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hardneg.hard_negatives(rows, F.col("vec_id") % 100 == 0)
