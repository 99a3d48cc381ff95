"""Inputs of the library derived from a generic star schema and documents.

Each table is one SELECT, rendered for Spark or for the checking database, so
both sides of a comparison start from the same rows. All integer arithmetic.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from drawbom.session import shared_base
from drawbom.sources.catalogs import CATALOGS, values_sql

# Words that recognised schedule pages carry, with slips.
PAGE_WORDS = ["PANEL", "SCHEDULE", "SCHEDULES", "PANE1", "SCHEDUIE", "E-101", "E2O1", "M-201", "RISER",
              "SINGLE", "LINE", "DIAGRAM", "DRAWING", "CKT", "DESCRIPTION", "TRIP", "POLES", "AMPS", "BUS",
              "MAIN", "MCB", "MLO", "AIC", "65KA", "35000", "225A", "400 AMPS", "120/208V", "480Y/277",
              "LP-1", "20A/1P", "NOTES"]
BUS_SIZES = [100, 125, 225, 250, 400, 600, 800, 1200]
SPACE_READS = [16, 18, 20, 30, 32, 42, 44, 54, 56, 66, 68, 72, 74, 84, 86]
KA_READS = [10, 14, 18, 22, 25, 30, 35, 42, 65, 100, None]
LABEL_READS = ["TRLP AMP.", "POLE", "CLRCULT NO.", "DESCRLPTION", "BRKR AMP .", "CKT NO", "AMP, POLES", "A B C",
               "3B", "120V", "LOAD DESIGNATION", "C1RCUIT", "TRIP(A)", "BKR/POLE", "20 A", "NAME", "AMP POLES"]
CELL_WORDS = ["BRKR", "AMP.", "POLES", "CKT", "NO.", "DESCRIPTION", "NOTES", "AMP", "SIZE"]
ROW_TEXTS = ["SPARE", "SPARES", "SPACE", "BLANK", "12", "1 2", "A", "LTG RM 101", "RECEPT.", "FILLER", "EMPTY", "-"]
NUMBER_TEXTS = ["12.7", "-3", "abc", "", "NONE", "1e3", "114A", "1,200", " none ", "40", "7.0", "x"]


@dataclass(frozen=True)
class Dialect:
    spark: bool

    @property
    def text(self) -> str:
        return "STRING" if self.spark else "VARCHAR"

    def t(self, name: str) -> str:
        return "{" + name + "}" if self.spark else name

    def div(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def pick(self, values: list, index: str) -> str:
        lits = ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values)
        n = len(values)
        return (f"element_at(array({lits}), CAST(({index}) % {n} AS INT) + 1)" if self.spark
                else f"([{lits}])[CAST(({index}) % {n} AS INT) + 1]")

    def words(self) -> str:
        pattern = r"[ \n\t\r]+"
        if self.spark:
            return f"SELECT doc_id, posexplode(split(text, '{pattern}')) AS (pos, word) FROM {self.t('documents')}"
        return (f"SELECT doc_id, CAST(unnest(range(0, len(w))) AS INT) AS pos, unnest(w) AS word FROM "
                f"(SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS w FROM documents)")

    def millis(self, c: str) -> str:
        return f"unix_millis(CAST({c} AS TIMESTAMP))" if self.spark else f"(epoch_us({c}) // 1000)"


def _panels(d):
    return f"""SELECT o_orderkey AS panel_id, o_custkey AS job_id, CAST(o_orderkey AS BIGINT) AS ord,
      concat('LP-', CAST(o_orderkey % 7 AS {d.text})) AS raw_name,
      {d.pick([120, 208, 240, 480, 600], d.div('o_orderkey', '7'))} AS voltage,
      {d.pick(BUS_SIZES, 'o_custkey')} AS bus_amps,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN {d.pick(BUS_SIZES, 'o_custkey')} END AS main_amps,
      {d.pick(KA_READS, 'o_orderkey + o_custkey')} AS int_rating,
      {d.pick(SPACE_READS, 'o_orderkey')} AS spaces
    FROM {d.t('orders')}"""


def _breakers(d):
    return f"""SELECT l_orderkey AS panel_id, l_linenumber % 4 AS poles,
      CAST(l_quantity AS INT) * (CASE WHEN l_linenumber = 7 THEN 25 ELSE 5 END) AS amperage,
      CAST(1 + l_suppkey % 3 AS INT) AS cnt,
      CASE WHEN l_returnflag = 'R' THEN 'GFI' ELSE '' END AS special_features,
      CAST(row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ord
    FROM {d.t('lineitem')}"""


def _tokens(d):
    vocab = d.pick(PAGE_WORDS, "doc_id * 5 + pos * pos + pos * 3")
    return f"""SELECT page_id, pdf_id, pos, text, conf, x1, y1, x1 + 8 * length(text) AS x2, y1 + 14 AS y2
    FROM (SELECT doc_id AS page_id, {d.div('doc_id', '20')} AS pdf_id, pos,
        CASE WHEN (pos + {d.div('pos', '12')}) % 2 = 0 THEN {vocab} ELSE regexp_replace(word, '[^ -~]', 'e'{'' if d.spark else ", 'g'"}) END AS text,
        CAST(30 + (doc_id * 7 + pos * 13) % 70 AS DOUBLE) / 100 AS conf,
        CAST((pos % 12) * 90 AS BIGINT) AS x1,
        CAST({d.div('pos', '12')} * 20 + (doc_id + pos) % 5 AS BIGINT) AS y1
      FROM ({d.words()}) w WHERE word <> '') t"""


def _page_sizes(d):
    return f"""SELECT doc_id AS page_id, CAST(1080 AS BIGINT) AS width,
      CAST({d.div('max(pos)', '12')} * 20 + 40 AS BIGINT) AS height FROM ({d.words()}) w GROUP BY doc_id"""


def _ruled_lines(d):
    return f"""SELECT page_id, line_no, CAST(18 * line_no + (k % 5) * 2 AS BIGINT) AS y_center,
      CAST(k % 40 AS BIGINT) AS x_left, CAST(k % 40 + 300 + (k % 7) * 100 AS BIGINT) AS x_right,
      CAST(1 + k % 6 AS BIGINT) AS thickness
    FROM (SELECT o_custkey AS page_id, o_orderkey AS k,
        CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS line_no FROM {d.t('orders')}) a"""


def _boxes(d):
    return f"""SELECT page_id, box_id, x1, y1, x1 + 60 + 4 * q AS x2, y1 + 40 + 3 * q AS y2
    FROM (SELECT l_orderkey AS page_id,
        CAST(row_number() OVER (PARTITION BY l_orderkey
          ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS box_id,
        (l_partkey % 8) * 10 AS x1, (l_suppkey % 6) * 10 AS y1, CAST(l_quantity AS BIGINT) AS q
      FROM {d.t('lineitem')}) a"""


def _job_events(d):
    return f"""SELECT event_id, ts, user_id AS owner_id, user_id * 20 + event_id % 20 AS job_id,
      CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'rendering'
        WHEN 'click' THEN 'parsing' WHEN 'purchase' THEN 'done' ELSE 'error' END AS state,
      {d.millis('ts')} AS ts_ms
    FROM {d.t('events')}"""


def _stamps(d):
    key = f"CAST(o_orderkey AS {d.text})"
    return f"""SELECT read_id, sheet_text, amps, ka,
      CASE WHEN read_id % 5 = 0 THEN translate(volt_text, '0', 'O') WHEN read_id % 7 = 0
        THEN translate(volt_text, '/', 'I') ELSE volt_text END AS volt_text,
      CASE WHEN read_id % 4 = 0 THEN translate(amp_text, '0', 'O') ELSE amp_text END AS amp_text,
      ka_text, label_text, row_text, number_text, note_text, setting_text, ms, submitted, w1, w2, w3, w4
    FROM (SELECT o_orderkey AS read_id,
      concat({d.pick(['E-', 'e ', 'EP_', 'M-', 'P.', 'A', 'XS', '', 'E-1'], 'o_orderkey')},
        translate({key}, '0158', {d.pick(['0158', 'OISB', 'OL58', 'O|5B'], 'o_custkey')}),
        {d.pick(['', '-', ' B', '.O1'], 'o_orderkey + o_custkey')}) AS sheet_text,
      (o_orderkey % 130) * 10 AS amps, {d.pick(KA_READS[:-1], 'o_custkey')} AS ka,
      concat({d.pick(['120', '208', '480', '240', '600', '277'], 'o_orderkey')},
        {d.pick(['/', 'Y/', 'Y', '', ',', ' / '], 'o_custkey')},
        {d.pick(['208', '120V', '277', '3', '', '240 V', '480'], d.div('o_orderkey', '6'))}) AS volt_text,
      concat(CAST((o_orderkey % 130) * 10 AS {d.text}),
        {d.pick(['A', ' A', ' AMPS', '', 'OA', 'kA', ' BUS'], 'o_custkey')}) AS amp_text,
      concat(CAST({d.pick(KA_READS[:-1], 'o_custkey')} AS {d.text}),
        {d.pick(['kA', ',000', '000 A', '', ' A', ' KAIC', 'K', '0'], 'o_orderkey')}) AS ka_text,
      {d.pick(LABEL_READS, 'o_orderkey + o_custkey')} AS label_text,
      {d.pick(ROW_TEXTS, 'o_orderkey + o_custkey')} AS row_text,
      {d.pick(NUMBER_TEXTS, 'o_orderkey')} AS number_text,
      concat('job_name=', o_orderpriority, ' No ', {key}, ' | user=u=', CAST(o_custkey AS {d.text}),
        {d.pick(['', ' | tz_offset_min = 60', ' | noise', ' | user=late'], 'o_orderkey')}) AS note_text,
      {d.pick(['true', 'False ', '12', 'FLUSH', ' 007', 'x1'], 'o_orderkey')} AS setting_text,
      (o_orderkey * 7919 + o_custkey) % 9000000 - 50 AS ms,
      o_orderdate AS submitted,
      {d.pick(CELL_WORDS, 'o_orderkey')} AS w1, {d.pick(CELL_WORDS, 'o_custkey')} AS w2,
      {d.pick(CELL_WORDS, 'o_orderkey + o_custkey')} AS w3, {d.pick(CELL_WORDS, d.div('o_orderkey', '9'))} AS w4
    FROM {d.t('orders')}) s"""


def _combos(d):
    a, p = f"CAST(amperage AS {d.text})", f"CAST(poles AS {d.text})"
    shapes = [f"concat({a}, '/', {p}, 'P')", f"concat({p}, 'P-', {a}, 'A')", f"concat({a}, 'A', {p}, 'P')",
              f"concat({a}, '/I')", f"concat({a}, ' ', {p}, 'P')", "'AMP, POLES'", f"concat({p}, '/', {a})",
              f"concat('SPARE ', {a}, '-', {p}, 'P')", f"concat('SPACE ', {p})", f"concat({a}, '.5')", a]
    cases = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(shapes))
    return f"""SELECT panel_id, ord, poles, amperage,
      CASE (panel_id + ord) % {len(shapes)} {cases} END AS text FROM {d.t('breakers')}"""


def _pages(d):
    return f"""SELECT doc_id AS page_id, {d.div('doc_id', '20')} AS pdf_id FROM {d.t('documents')}"""


def _footprints(d):
    return f"""SELECT page_id, box_id, CAST(x2 - x1 AS DOUBLE) / 1000 AS bbox_w_frac,
      CAST(y2 - y1 AS DOUBLE) / 800 AS bbox_h_frac, CAST(50 + (page_id + box_id * 17) % 50 AS DOUBLE) / 100 AS rectangularity,
      x1 AS left_px, y1 AS top_px, 1000 - x2 AS right_px, 800 - y2 AS bottom_px
    FROM {d.t('boxes')}"""


def _pole_reads(d):
    return f"""SELECT panel_id, CASE WHEN ord % 2 = 1 THEN 'L' ELSE 'R' END AS side,
      {d.div('ord + 1', '2')} AS i, CASE WHEN (panel_id + ord) % 9 = 0 THEN NULL ELSE poles END AS poles
    FROM {d.t('breakers')}"""


def _trip_reads(d):
    return f"""SELECT panel_id, CASE WHEN ord % 2 = 1 THEN 'L' ELSE 'R' END AS side,
      {d.div('ord + 1', '2')} AS i, CASE WHEN (panel_id + ord) % 11 = 0 THEN NULL ELSE amperage END AS amps
    FROM {d.t('breakers')}"""


def _digit_probs(d):
    sources = [("ocr", 0, 3), ("template", 1, 7), ("ink", 2, 11)]
    each = (f"explode(array({', '.join(f"named_struct('source', '{n}', 'shift', {a}, 'mult', {b})" for n, a, b in sources)}))" if d.spark
            else f"unnest([{', '.join(f"{{'source': '{n}', 'shift': {a}, 'mult': {b}}}" for n, a, b in sources)}])")
    return f"""SELECT b.panel_id, b.ord AS i, b.s.source, CAST(1 + (b.amperage + b.poles * b.s.shift) % 3 AS INT) AS digit,
      CAST(20 + (b.amperage * b.s.mult + b.panel_id) % 80 AS DOUBLE) / 100 AS p,
      (b.panel_id + b.s.shift) % 7 = 0 AS abstain
    FROM (SELECT *, {each} AS s FROM {d.t('breakers')}) b"""


def _disconnect_items(d):
    return f"""SELECT o_orderkey AS item_id,
      {d.pick(['GENERAL_DUTY', 'HEAVY_DUTY', None], 'o_orderkey')} AS switch_type,
      {d.pick(['NEMA1', 'NEMA3R', 'NEMA4X', None], 'o_custkey')} AS enclosure,
      CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS fusible,
      CAST(2 + o_custkey % 2 AS INT) AS poles,
      {d.pick([120, 208, 240, 480, 600, 700], d.div('o_orderkey', '5'))} AS voltage,
      CAST((1 + o_orderkey % 70) * 10 AS INT) AS amps,
      CASE WHEN o_custkey % 2 = 0 THEN CAST((1 + o_orderkey % 70) * 10 - o_custkey % 5 AS INT) END AS fuse_amps,
      o_custkey % 3 > 0 AS ground, o_orderkey % 4 > 0 AS neutral
    FROM {d.t('orders')}"""


def _transformer_items(d):
    return f"""SELECT o_orderkey AS item_id,
      CAST({d.pick([10, 15, 20, 25, 30, 37, 45, 50, 75, 80, 112, 150, 200, 225, 300, 400, 500], 'o_orderkey')} AS DOUBLE) AS kva,
      {d.pick([480, 208, 240, 600, 277], 'o_custkey')} AS primary_volts,
      {d.pick([120, 208, 240, 480], d.div('o_orderkey', '17'))} AS secondary_volts,
      {d.pick(['ALUMINUM', 'COPPER', None], d.div('o_orderkey', '5'))} AS core,
      {d.pick([150, 115, 80, None], 'o_orderkey + o_custkey')} AS temperature,
      o_custkey % 2 = 0 AS weathershield,
      {d.pick(['FLOOR', 'WALL', 'CEILING', None], 'o_custkey')} AS mounting,
      {d.pick(['3PHASESTANDARD', 'K13', '1PHASESTANDARD', None, 'RESIN'], 'o_orderkey')} AS type
    FROM {d.t('orders')}"""


def _settings(d):
    return f"""SELECT 'item' AS scope, o_orderkey AS scope_id,
      {d.pick(['*', 'panelboards', 'transformers', 'disconnects'], 'o_orderkey')} AS domain,
      {d.pick(['enclosure', 'trimStyle', 'material', 'mounting', 'default_enclosure', 'nema', 'rating_type'], 'o_orderkey + o_custkey')} AS key,
      {d.pick(['NEMA3R', 'SURFACE', 'COPPER', 'WALL', 'true', '5'], 'o_custkey')} AS value,
      o_orderkey AS ord FROM {d.t('orders')}
    UNION ALL
    SELECT 'job' AS scope, c_custkey AS scope_id,
      {d.pick(['*', 'panelboards', 'transformers'], 'c_custkey')} AS domain,
      {d.pick(['panelRatingType', 'allowPlugOn', 'enclosure', 'material', 'temperature_rating'], 'c_custkey')} AS key,
      {d.pick(['SERIES_RATED', 'false', 'NEMA1', 'COPPER', '115'], 'c_custkey')} AS value,
      c_custkey AS ord FROM {d.t('customer')}"""


def _cancels(d):
    return f"""SELECT DISTINCT user_id * 20 + event_id % 20 AS job_id FROM {d.t('events')}
    WHERE value > 150"""


def _page_refs(d):
    return f"""SELECT page_id, CAST(30 + page_id % 60 AS BIGINT) AS header_y, CAST(120 + page_id % 200 AS BIGINT) AS footer_y,
      CAST(1000 AS BIGINT) AS width, CAST(900 AS BIGINT) AS height FROM {d.t('ruled_lines')} GROUP BY page_id"""


def _row_cover(d):
    steps = (f"SELECT page_id, y_center, x_right - x_left AS cover, explode(sequence(0, CAST(thickness AS INT) - 1)) AS dy FROM {d.t('ruled_lines')}"
             if d.spark else "SELECT page_id, y_center, x_right - x_left AS cover, unnest(range(0, thickness)) AS dy FROM ruled_lines")
    return f"SELECT page_id, y_center + dy AS y, max(cover) AS cover FROM ({steps}) r GROUP BY page_id, y_center + dy"


def _vlines(d):
    return f"""SELECT DISTINCT page_id, CAST((x_left * 7 + line_no * 83) % 980 + 10 AS BIGINT) AS x FROM {d.t('ruled_lines')}"""


HEADER_LABELS = ["TRIP", "AMP, POLES", "BRKR AMP", "CKT NO", "POLES", "DESCRIPTION", "TRIP (A) POLE", "NOTES", "P", "CIRCUIT DESCRIPTION", "TRLP",
                 "LOAD DESIGNATION", "SIZE", "ROOM", "BKR SIZE"]


def _header_cands(d):
    return f"""SELECT page_id, ord, role, text, x1, x1 + 20 + 9 * length(text) AS x2, sim, conf FROM (
      SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS ord,
        {d.pick(['trip', 'poles', 'ckt', 'description'], 'l_linenumber + l_suppkey')} AS role, {d.pick(HEADER_LABELS, 'l_partkey + l_suppkey')} AS text,
        (l_partkey * 37 + l_suppkey) % 900 AS x1, CAST(40 + (l_partkey + l_suppkey * 7) % 60 AS DOUBLE) / 100 AS sim,
        CAST(30 + (l_partkey * 3) % 70 AS DOUBLE) / 100 AS conf FROM {d.t('lineitem')}) h"""


BASE = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations"}
# name -> (builder, direct inputs)
DERIVED = {
    "panels": (_panels, ["orders"]), "breakers": (_breakers, ["lineitem"]),
    "tokens": (_tokens, ["documents"]), "page_sizes": (_page_sizes, ["documents"]),
    "ruled_lines": (_ruled_lines, ["orders"]), "boxes": (_boxes, ["lineitem"]),
    "job_events": (_job_events, ["events"]), "cancels": (_cancels, ["events"]),
    "stamps": (_stamps, ["orders"]), "page_refs": (_page_refs, ["ruled_lines"]), "vlines": (_vlines, ["ruled_lines"]), "header_cands": (_header_cands, ["lineitem"]), "row_cover": (_row_cover, ["ruled_lines"]),
    "combos": (_combos, ["breakers"]), "pdf_pages": (_pages, ["documents"]),
    "footprints": (_footprints, ["boxes"]), "pole_reads": (_pole_reads, ["breakers"]),
    "trip_reads": (_trip_reads, ["breakers"]), "digit_probs": (_digit_probs, ["breakers"]),
    "disconnect_items": (_disconnect_items, ["orders"]),
    "transformer_items": (_transformer_items, ["orders"]),
    "settings": (_settings, ["orders", "customer"]),
}
DERIVED.update({name: (lambda d, n=name: values_sql(n, d.spark), []) for name in CATALOGS})


# Tables that many queries read and that cost much to derive: written once per session, in buckets
# of their pages, so that what is grouped, ordered or joined by page needs no shuffle. There are as
# many buckets as keep each at about `BUCKET` characters of text, whatever the layout of the source.
WRITTEN = {"tokens": ("doc_id", "page_id"), "page_sizes": ("doc_id", "page_id")}
BUCKET = 1_000_000
STORED = "bucket_page"    # a column that is renamed on reading is known as one by unions, which so keep rows by page
_written: dict[tuple[str, str, str], str] = {}
# Tables numbered by a window: dealt by its key into parts of about `PART` rows of their source, so
# that what a task sorts stays small however large the table is. Up to `STRAIGHT` parts are written
# without a sort in the memory of the writing task, so there are more only where parts would exceed `MOST` rows.
DEALT = {"boxes": "l_orderkey"}
PART, STRAIGHT, MOST = 250_000, 200, 4_000_000


def parts_of(rows: int, least: int) -> int:
    return max(least, min(-(-rows // PART), STRAIGHT), -(-rows // MOST))


def buckets_of(chars: int, least: int) -> int:
    return max(least, -(-chars // BUCKET))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or derived table of the data directory."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    build, inputs = DERIVED[name]
    read = {i: table(spark, sf_dir, i) for i in inputs}
    if name in DEALT:
        read = {i: df.repartition(parts_of(df.count(), spark.sparkContext.defaultParallelism), DEALT[name]) for i, df in read.items()}
    if name not in WRITTEN:
        return spark.sql(build(Dialect(True)), **read)
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _written:
        source, page = WRITTEN[name]
        parts = buckets_of(read["documents"].agg(F.sum(F.length("text"))).first()[0] or 0, spark.sparkContext.defaultParallelism)
        spread = {i: df.repartition(parts, source) for i, df in read.items()}
        mark = f"{name}_{os.urandom(6).hex()}"
        (spark.sql(build(Dialect(True)), **spread).withColumnRenamed(page, STORED).write.bucketBy(parts, STORED)
         .options(path=f"{shared_base(spark)}/{mark}", compression="zstd").saveAsTable(mark))
        _written[key] = mark
    return spark.table(_written[key]).withColumnRenamed(STORED, WRITTEN[name][1])


def _ctes(name: str, seen: dict) -> None:
    if name in BASE or name in seen:
        return
    build, inputs = DERIVED[name]
    for i in inputs:
        _ctes(i, seen)
    seen[name] = build(Dialect(False))


def with_tables(names: str, body: str) -> str:
    """Checking SQL: the derived tables as CTEs in front of `body`.

    `body` is a SELECT, or further CTEs followed by a SELECT.
    """
    seen: dict = {}
    for n in names.split():
        _ctes(n, seen)
    ctes = [f"{n} AS ({sql})" for n, sql in seen.items()]
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes + [body[15:]])
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes + [body[5:]])
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
