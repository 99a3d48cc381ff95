"""Page triage: which pages of a drawing set carry schedules.

Input is one row per recognised token. Page and PDF level facts are partial
aggregates, so a PDF or page holding much of the corpus shrinks before any
shuffle; page text is only ever assembled in bounded chunks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from drawbom.functions.text import alnum_tokens, clean_text, let, sheet_class
from drawbom.operators.spread import along, any_of, held

# Fixed values -------------------------------------------------------------
LABEL_PATTERNS = [
    ("panel_schedules", r"\bpanel\s*schedules?\b"),
    ("panel_schedules", r"\bpanelboard\s*schedules?\b"),
    ("panel_schedules", r"\bpanel[\s\-]+schedules?\b"),
    ("single_one_line", r"\bsingle[\s\-]?line\b"),
    ("single_one_line", r"\bone[\s\-]?line\b"),
    ("single_one_line", r"\b1[\s\-]?line\b"),
    ("single_one_line", r"\b(?:one|single)[\s\-]?line\s*diagram\b"),
    ("riser", r"\briser\b"),
    ("riser", r"\briser\s*diagram\b"),
    ("diagram_generic", r"\belectrical\s*diagrams?\b"),
    ("diagram_generic", r"\bdiagrams?\b"),
    ("diagram_generic", r"\bdrawings?\b"),
    ("schedules_generic", r"\bschedules?\b"),
]
BUCKET_WEIGHTS = {"panel_schedules": 4.5, "single_one_line": 4.5, "riser": 3.5,
                  "diagram_generic": 2.0, "schedules_generic": 1.0}
PLURAL_BONUS = 0.4
CONF_MULT = 1.2
FUZZY_VOCAB = [("schedule", 2), ("schedules", 2), ("panel", 1), ("panelboard", 2), ("line", 1), ("single", 1),
               ("one", 1), ("1", 0), ("riser", 1), ("diagram", 2), ("diagrams", 2), ("drawing", 2),
               ("drawings", 2), ("schematic", 2), ("schematics", 2)]
CORNER = (0.88, 0.92, 0.98, 0.98)
STATUS_PATTERNS = [
    ("existing", r"\(\s*E\s*\)"), ("existing", r"\bEXIST(ING|G)?\b"), ("existing", r"\bEXSTG\b"),
    ("demo", r"\bDEMO\b"), ("demo", r"\bDEMOLISH(ED|ING)?\b"), ("demo", r"\bREMOVE(D|)\b"),
    ("demo", r"\bTO\s+BE\s+REMOVED\b"),
]
SKIP_NAMES = ["MSB", "SWBD", "SWITCHBOARD"]
SKIP_PARTS = ["EXIST", "EXISTING", "DEMO", "DEMOLISH", "REMOVE", "FUTURE", "ABANDON", "NOT IN SCOPE"]
# --------------------------------------------------------------------------


def corner_tokens(tokens: DataFrame, page_sizes: DataFrame, frac=CORNER, tall: float = 4.0,
                  right: float = 0.02) -> DataFrame:
    """Tokens whose centre lies in the title block column of their page."""
    x0, y0, x1, y1 = frac
    w, h = F.col("width"), F.col("height")
    top = F.greatest(F.lit(0.0), h * round(y0 - (tall - 1) * (y1 - y0), 6))
    xc, yc = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = xc.between(w * x0, F.least(w, w * round(x1 + right, 6))) & yc.between(top, h * y1)
    return tokens.join(page_sizes, "page_id").filter(inside).select(*tokens.columns)


def page_pass_a(tokens: DataFrame, pages: DataFrame | None = None, min_non_e_conf: float = 0.70) -> DataFrame:
    """E, nonE or undecided per page from the sheet numbers on it.

    With `pages(pdf_id, page_id)` a page without any token is undecided.
    """
    cls = tokens.select("pdf_id", "page_id", "conf", sheet_class(F.col("text")).alias("c"))
    flags = cls.groupBy("pdf_id", "page_id").agg(
        F.bool_or(F.col("c") == "E").alias("e"),
        F.bool_or((F.col("c") == "nonE") & (F.col("conf") >= min_non_e_conf)).alias("n"))
    if pages is not None:
        flags = pages.select("pdf_id", "page_id").join(flags.drop("pdf_id"), "page_id", "left")
    return flags.select("pdf_id", "page_id", F.when(F.col("e"), "E").when(F.col("n"), "nonE")
                        .otherwise("undecided").alias("decision"))


def page_chunks(tokens: DataFrame, size: int = 256, tail: int = 16) -> DataFrame:
    """Page text in chunks of `size` positions, each with the first `tail` words of
    the next chunk, so that a phrase across the cut is seen once whole.

    Tokens of nothing but dashes and blanks only separate words and are not counted, as a
    phrase may hold any number: a chunk of fewer than `tail` words is joined to the one
    before it. Only chunks are ordered, never the tokens of a page.
    """
    word = F.coalesce(F.col("text").rlike(r"[^\s\-—–]"), F.lit(False))
    lists = tokens.groupBy("page_id", F.floor(F.col("pos") / size).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "text", word.alias("word")))).alias("ws"))
    at = F.filter(F.transform("ws", lambda w, i: F.when(w["word"], i + 1)), lambda i: i.isNotNull())
    joined = lambda ws: F.array_join(F.transform(ws, lambda w: w["text"]), " ")
    head = F.slice("ws", F.lit(1), F.coalesce(F.get("at", F.lit(tail - 1)), F.size("ws")))
    blocks = held(lists.withColumn("at", at).select("page_id", "block", F.size("at").alias("words"), joined(F.col("ws")).alias("text"), joined(head).alias("head")))

    def starts(rows: DataFrame, run) -> DataFrame:
        first = run(rows, {"_before": ("sum", F.lit(1).cast("long"), False)})
        return first.withColumn("_s", F.when((F.col("_before") == 0) | (F.col("words") >= tail), 1).otherwise(0).cast("long"))
    cut = along(blocks, ["page_id"], [F.col("block")], starts, lambda rows, run: run(
        rows, {"chunk": ("sum", F.col("_s"), True), "spill": ("next", F.when(F.col("_s") == 1, F.col("head")), False)}))
    own = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda b: b["text"]), " ")
    chunks = cut.groupBy("page_id", "chunk").agg(own.alias("text"), F.max("spill").alias("spill"))
    return chunks.select("page_id", "chunk", clean_text(F.concat_ws(" ", "text", "spill")).alias("text"), clean_text(F.coalesce("spill", F.lit(""))).alias("spill"))


def match_label_buckets(tokens: DataFrame, patterns=LABEL_PATTERNS) -> DataFrame:
    """Hits per page, bucket, pattern and matched phrase; overlapping patterns
    of one bucket all count."""
    def hits(i: int, bucket: str, pattern: str) -> Column:
        # the letter that a pattern begins with is looked for before the edge of a word, which costs more
        first = re.match(r"\\b([A-Za-z0-9])(?![?*{|])", pattern)
        rx = F.lit("(?i)" + (f"(?={first[1]})" if first and "|" not in re.sub(r"\([^()]*\)", "", pattern) else "") + pattern)
        late = F.when(F.col("spill") == "", 0).otherwise(F.size(F.regexp_extract_all("spill", rx, F.lit(0))))
        return let(F.regexp_extract_all("text", rx, F.lit(0)), lambda found: F.when(F.size(found) > 0, F.transform(
            F.slice(found, F.lit(1), F.greatest(F.size(found) - late, F.lit(0))),
            lambda m: F.struct(F.lit(bucket).alias("bucket"), F.lit(i).alias("ord"), F.lower(m).alias("phrase")))))

    every = F.flatten(F.array_compact(F.array(*[hits(i, b, p) for i, (b, p) in enumerate(patterns)])))
    return (page_chunks(tokens).select("page_id", F.explode(every).alias("h"))
            .groupBy("page_id", "h.bucket", "h.ord", "h.phrase").agg(F.count("*").alias("hits")))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")


def match_confidence(tokens: DataFrame, matches: DataFrame) -> DataFrame:
    """Mean confidence of the tokens that have a word inside a matched phrase.

    A word has no blanks, so it lies in a phrase only if it lies in one of the phrase's own
    words, of which a pattern list gives few. Texts without such a word are left out before
    tokens are summed up per page and text, and only these sums meet the phrases of a page.
    """
    phrases = held(matches.select("page_id", "phrase").distinct())
    pieces = held(phrases.select(F.explode(F.split("phrase", r"\s+")).alias("piece")).distinct())
    texts = tokens.select("text").distinct().select("text", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    near_texts = held(texts.join(pieces, F.contains("piece", "word")).select("text").distinct())
    scaled = F.when(F.col("conf").between(0, 1), F.col("conf")).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf") / 100)))
    sums = (tokens.select("page_id", "text", scaled.cast("decimal(12,6)").alias("c")).join(near_texts, "text", "left_semi")
            .groupBy("page_id", "text").agg(F.sum("c").alias("c"), F.count("*").alias("n")))
    sets = phrases.groupBy("page_id").agg(F.collect_set("phrase").alias("phrases"))
    near = (sums.join(sets, "page_id").withColumn("words", _words(F.col("text")))
            .select("page_id", "c", "n", F.explode(F.filter(
                "phrases", lambda p: F.exists("words", lambda w: F.contains(p, w)))).alias("phrase"))
            .groupBy("page_id", "phrase").agg((F.sum("c").cast("double") / F.sum("n")).alias("conf")))
    return (phrases.join(near, ["page_id", "phrase"], "left")
            .select("page_id", "phrase", F.coalesce("conf", F.lit(0.9)).alias("conf")))


def fuzzy_vocab_hit(tokens: DataFrame, vocab=FUZZY_VOCAB) -> DataFrame:
    """Per page, whether some word is within the edit distance of each target.

    Each distinct text is compared once; tokens meet the few that are close to a target.
    """
    def close(target: str, dist: int) -> Column:
        d = F.when(F.abs(F.length("word") - len(target)) <= dist,
                   F.levenshtein(F.col("word"), F.lit(target), dist) if dist else
                   F.when(F.col("word") == target, 0))
        return F.coalesce(d.between(0, dist), F.lit(False))

    likes = [f"like_{t}" for t, _ in vocab]
    texts = tokens.select("text").distinct().select("text", F.explode(alnum_tokens(F.col("text"))).alias("word"))
    words = texts.select("text", *[close(t, d).alias(n) for n, (t, d) in zip(likes, vocab)]).filter(any_of([F.col(n) for n in likes]))
    near = held(words.groupBy("text").agg(*[F.bool_or(n).alias(n) for n in likes]))
    spoken = tokens.filter(F.lower("text").rlike("[a-z0-9]")).select("page_id", "text")
    return spoken.join(near, "text", "left").groupBy("page_id").agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in likes])


def score_page_labels(tokens: DataFrame) -> DataFrame:
    """Score and sorted tags per page."""
    matches = held(match_label_buckets(tokens))
    rated = matches.join(match_confidence(tokens, matches), ["page_id", "phrase"])
    weights = F.create_map(*[F.lit(x) for kv in BUCKET_WEIGHTS.items() for x in kv])

    weight = weights[F.col("bucket")] + F.when(F.contains("phrase", F.lit("schedules")), PLURAL_BONUS).otherwise(0.0)
    term = F.round(weight * F.col("conf") * CONF_MULT * F.col("hits"), 9).cast("decimal(18,9)")
    by_page = rated.groupBy("page_id").agg(F.sum(term).alias("base"), F.collect_set("bucket").alias("found"))
    like = lambda *ts: any_of([F.col(f"like_{t}") for t in ts])
    found = lambda b: F.array_contains("found", b)
    sched = like("schedule", "schedules")
    boosts = [
        ("panel_schedules", sched & like("panel", "panelboard") & ~found("panel_schedules")),
        ("schedules_generic", sched & ~like("panel", "panelboard") & ~found("schedules_generic") & ~found("panel_schedules")),
        ("single_one_line", like("single", "one", "1") & F.col("like_line") & ~found("single_one_line")),
        ("riser", F.col("like_riser") & ~found("riser")),
        ("diagram_generic", like("diagram", "diagrams", "drawing", "drawings", "schematic", "schematics") & ~found("diagram_generic")),
    ]
    extra = sum((F.when(c, BUCKET_WEIGHTS[b]).otherwise(0.0) for b, c in boosts), F.lit(0.0))
    tags = F.array_union("found", F.array_compact(F.array(*[F.when(c, b) for b, c in boosts])))
    both = fuzzy_vocab_hit(tokens).join(by_page, "page_id", "left").withColumn(
        "found", F.coalesce("found", F.array().cast("array<string>")))
    score = F.round(F.coalesce("base", F.lit(0).cast("decimal(28,9)")) + extra.cast("decimal(18,9)"), 3)
    return both.select("page_id", score.cast("double").alias("score"), F.sort_array(tags).alias("tags"))


def select_pages(scores: DataFrame, hard: float = 6.5, soft: float = 3.0) -> DataFrame:
    """Pages kept per PDF, from `pdf_id, page_id, score, tags` of its E pages."""
    has = lambda t: F.array_contains("tags", t)
    rows = scores.select("pdf_id", "page_id", "score", has("panel_schedules").alias("panel"),
                         (~has("panel_schedules") & has("schedules_generic")).alias("sched"),
                         (has("single_one_line") | has("riser") | has("diagram_generic")).alias("other"))
    pdf = rows.groupBy("pdf_id").agg(F.bool_or("panel").alias("any_panel"), F.bool_or("sched").alias("any_sched"),
                                     F.bool_or("other").alias("any_other"), F.max("score").alias("best"))
    some = F.col("any_panel") | F.col("any_sched") | F.col("any_other")
    reason = (F.when(F.col("panel"), "panel schedule")
              .when(F.col("sched") & ~F.col("any_panel"), "generic schedule")
              .when(F.col("other"), "diagram")
              .when(~some & (F.col("best") >= hard) & (F.col("score") >= hard), "strong labels")
              .when(~some & (F.col("best") < hard) & (F.col("best") >= soft) & (F.col("score") >= soft), "weak labels")
              .when(~some & (F.col("best") < soft), "sheet number only"))
    return (rows.join(pdf, "pdf_id").select("pdf_id", "page_id", reason.alias("reason"))
            .filter("reason IS NOT NULL"))


def qualify_footprints(footprints: DataFrame, w_range=(0.10, 0.55), h_range=(0.10, 0.60),
                       min_rect: float = 0.70, border: int = 4) -> DataFrame:
    """Number of table-shaped voids per page."""
    inside = any_of([F.col(c) <= border for c in ("left_px", "top_px", "right_px", "bottom_px")])
    ok = (F.col("bbox_w_frac").between(*w_range) & F.col("bbox_h_frac").between(*h_range)
          & (F.col("rectangularity") >= min_rect) & ~inside)
    return footprints.filter(ok).groupBy("page_id").agg(F.count("*").alias("footprints"))


def select_pages_fallback(decisions: DataFrame, footprints: DataFrame, min_count: int = 2) -> DataFrame:
    """For PDFs without any E page: undecided pages with enough voids."""
    no_e = decisions.groupBy("pdf_id").agg(F.bool_or(F.col("decision") == "E").alias("has_e")).filter(~F.col("has_e"))
    counts = qualify_footprints(footprints).filter(F.col("footprints") >= min_count)
    return (decisions.filter(F.col("decision") == "undecided").join(no_e, "pdf_id", "left_semi")
            .join(counts, "page_id").select("pdf_id", "page_id", "footprints"))


def pages_or_all(selected: DataFrame, all_pages: DataFrame) -> DataFrame:
    """A PDF that kept nothing is processed whole."""
    empty = all_pages.select("pdf_id", "page_id").join(selected.select("pdf_id").distinct(), "pdf_id", "left_anti")
    return (selected.select("pdf_id", "page_id", F.lit(True).alias("selected"))
            .unionByName(empty.select("pdf_id", "page_id", F.lit(False).alias("selected"))))


def panel_status_filter(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Pages whose panel is new work: `names(page_id, name)` without those that
    are marked existing or demolished, or are named like skipped gear."""
    status = any_of([F.upper("text").rlike(p) for _, p in STATUS_PATTERNS])
    marked = tokens.filter(status).select("page_id").distinct()
    name = F.upper(F.trim("name"))
    skip = name.isin(*SKIP_NAMES) | any_of([F.contains(name, F.lit(p)) for p in SKIP_PARTS])
    return names.filter(~F.coalesce(skip, F.lit(False))).join(marked, "page_id", "left_anti")


def page_audit_log(decisions: DataFrame, scores: DataFrame, selected: DataFrame, fallback: DataFrame) -> DataFrame:
    """One row per page: kept or dropped, why, with which score and tags."""
    kept = selected.select("page_id", "reason").withColumn("e", F.lit(True))
    fb = fallback.select("page_id", "footprints")
    with_e = decisions.groupBy("pdf_id").agg(F.bool_or(F.col("decision") == "E").alias("has_e"))
    reason = (F.when(F.col("reason").isNotNull(), F.col("reason"))
              .when(F.col("has_e"), "not selected after label prioritisation")
              .when(F.col("decision") == "nonE", "confident other discipline")
              .when(F.col("footprints").isNotNull(), "footprints")
              .otherwise("no qualifying footprints"))
    keep = F.col("reason").isNotNull() | (~F.col("has_e") & F.col("footprints").isNotNull())
    e_only = F.col("decision") == "E"
    return (decisions.join(with_e, "pdf_id").join(kept, "page_id", "left").join(fb, "page_id", "left")
            .join(scores, "page_id", "left")
            .select("pdf_id", "page_id", F.when(keep, "KEEP").otherwise("DROP").alias("decision"),
                    reason.alias("why"), F.when(e_only, F.col("score")).alias("label_score"),
                    F.when(e_only, F.array_join("tags", ",")).alias("label_tags")))
