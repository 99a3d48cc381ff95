"""Normalisers and parsers for recognised text (Column -> Column).

All of them are built-in expressions, so they stay inside generated code and
need no shuffle. Missing input gives a missing result.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values -------------------------------------------------------------
SHEET_E = r"^E[A-Z\-]{0,5}.*\d.*\d"
SHEET_OTHER = r"^(?:P|M|C|A|F|S|X)[A-Z\-]{0,5}.*\d.*\d"
SHEET_MAYBE = r"^[ _.]*[EPMCAFSX][^0-9]*[0-9]"
HEADER_WORDS = ["CKT", "CCT", "TRIP", "POLES", "AMP", "AMPS", "BREAKER", "BKR", "SIZE",
                "DESCRIPTION", "DESIGNATION", "NAME", "LOADDESCRIPTION", "CIRCUITDESCRIPTION"]
HEADER_TYPOS = {
    "TRLP": "TRIP", "POLE": "POLES", "CLRCULT": "CIRCUIT", "DESCRLPTION": "DESCRIPTION",
    "DESCRLPTLON": "DESCRIPTION", "DESCRLPTLN": "DESCRIPTION", "DESARLPTBN": "DESCRIPTION",
    "DESARLPTION": "DESCRIPTION", "RECEPTACK": "RECEPTACLE", "RECEPTACKE": "RECEPTACLE",
}
PHRASE_ORDER = ["BRKR", "AMP", "POLES", "CKT", "NO", "DESCRIPTION", "NOTES"]
BLANK_TERMS = ["SPACE", "BLANK", "EMPTY", "FILLER"]
SPARE_TERMS = ["SPARE", "SPARES"]
EMPTY_ROW_TOKENS = ["SPACE", "PROVISION", "EMPTY", "BLANK", "UNUSED", "OPEN"]
NOTE_KEYS = ["job_name", "submitted_at_utc", "submitted_local", "tz_offset_min", "user"]
# --------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """Compute `value` once and use it many times inside `body`."""
    return F.transform(F.array(value), body)[0]


def _upper(c: Column) -> Column:
    return F.upper(c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def repair_sheet_token(c: Column) -> Column:
    """Letters that stand next to a digit of the cleaned text become digits.

    Marks stand in for the new digits until all four classes are done, so a
    repaired letter never makes its neighbour look like one beside a digit.
    """
    s = F.translate(F.regexp_replace(F.trim(_upper(c)), "[—–]", "-"), "_ .", "")
    for letters, mark in (("O", "\u0001"), ("[IL|]", "\u0002"), ("S", "\u0003"), ("B", "\u0004")):
        s = F.regexp_replace(s, f"(?<=[0-9]){letters}|{letters}(?=[0-9])", mark)
    return F.translate(s, "\u0001\u0002\u0003\u0004", "0158")


def sheet_class(c: Column) -> Column:
    """Only texts that have a digit and begin with a letter of some class are repaired; a
    repair makes digits beside digits alone, and never such a letter."""
    s = F.regexp_replace(repair_sheet_token(c), "-$", "")
    classes = let(s, lambda t: F.when(t.rlike(SHEET_E), "E").when(t.rlike(SHEET_OTHER), "nonE").otherwise("none"))
    return F.when(_upper(c).rlike(SHEET_MAYBE), classes).otherwise("none")


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "[—–]", "-"))


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def fold_confusables(c: Column) -> Column:
    return F.regexp_replace(F.translate(_upper(c), "0Q1LJ!|5$28", "OOIIIIISSZB"), "[^A-Z0-9]", "")


def norm_header_word(c: Column) -> Column:
    return F.regexp_replace(F.translate(_upper(c), "10", "IO"), "[^A-Z0-9]", "")


def norm_header_text(c: Column) -> Column:
    s = F.trim(_upper(c))
    for old, new in (("AMP.", "AMP"), ("AMP .", "AMP"), ("AMP ", "AMP"), ("NO.", "NO")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return F.regexp_replace(s, r"\s+", " ")


def fix_header_typos(c: Column) -> Column:
    typos = F.create_map(*[F.lit(x) for kv in HEADER_TYPOS.items() for x in kv])
    return F.array_join(F.transform(F.split(collapse(_upper(c)), " "),
                                    lambda w: F.coalesce(F.try_element_at(typos, w), w)), " ")


def norm_header_label(c: Column) -> Column:
    """Word-level spelling repair first, then the abbreviation clean-up."""
    return norm_header_text(fix_header_typos(c))


def canonical_header_phrase(words: Column) -> Column:
    """One phrase for the words stacked in a header cell."""
    def tidy(w: Column) -> Column:
        w = collapse(_upper(w))
        w = F.replace(F.replace(w, F.lit("AMP ."), F.lit("AMP")), F.lit("AMP."), F.lit("AMP"))
        return F.regexp_replace(w, "[^A-Z0-9_ ]+", "")

    toks = F.array_distinct(F.filter(F.transform(words, tidy), lambda w: w != ""))
    has = lambda w: F.array_contains(toks, w)
    known = F.filter(F.array(*[F.lit(w) for w in PHRASE_ORDER]), lambda w: F.array_contains(toks, w))
    return (F.when(has("DESCRIPTION"), "DESCRIPTION")
            .when(has("CKT") & has("NO"), "CKT NO")
            .when(has("BRKR") & has("NOTES"), "BRKR NOTES")
            .when(has("BRKR") & has("AMP") & has("POLES"), "BRKR AMP, POLES")
            .when(F.size(toks) <= 3, F.array_join(toks, " "))
            .when(F.size(known) == 0, F.array_join(toks, " "))
            .when(has("AMP") & has("POLES") & ~has("BRKR"), "AMP, POLES")
            .otherwise(F.array_join(known, " ")))


def is_phase_or_numeric(c: Column) -> Column:
    s = F.trim(c)
    letters = F.regexp_extract_all(_upper(s), F.lit("[A-Z]+"), F.lit(0))
    return ((s == "") | s.rlike("[0-9]")
            | ((F.size(letters) > 0) & F.forall(letters, lambda w: w.isin("A", "B", "C"))))


def header_like(c: Column, min_alpha: float = 0.40) -> Column:
    """Enough letters, not a phase crumb, not a bare rating."""
    s = collapse(F.regexp_replace(_upper(c), r"[\[\]():.,/_\-]+", " "))
    phase_words = F.forall(F.split(s, " "), lambda w: w.isin("A", "B", "C"))
    crumb = (F.length(s) <= 3) & s.rlike("[ABC]")
    alpha = F.length(F.regexp_replace(c, "[^A-Za-z]", "")) / F.greatest(F.lit(1), F.length(c))
    rating = c.rlike(r"(?i)^[0-9]+(?:\.[0-9]+)?\s*(A|AMP|AMPS)?$")
    return (alpha >= min_alpha) & ~((s != "") & (phase_words | crumb)) & ~rating


def is_header_word(c: Column) -> Column:
    return norm_header_word(c).rlike("|".join(HEADER_WORDS))


def fix_digit_ocr(c: Column) -> Column:
    s = F.regexp_replace(c, "(?<=[0-9])[Oo](?=[0-9])", "0")
    return F.regexp_replace(s, r"(?i)(?<=[0-9])O(?=\s*(?:A|AMPS?)\b)", "0")


def fix_voltage_text(c: Column) -> Column:
    s = F.regexp_replace(_upper(c), "(?<=[0-9])[IL](?=[0-9])", "/")
    s = F.regexp_replace(s, "(?<=[0-9])O(?=[0-9])", "0")
    return F.regexp_replace(F.translate(s, ",.", "  "), r"\s+", " ")


def parse_combo(c: Column) -> Column:
    """Amps and poles of a combined cell such as 20/1P, 1P-20A, 20A1P, 20/I."""
    u = F.regexp_replace(_upper(c), "[^ -ILP]", " ")
    u = F.regexp_replace(collapse(u), "-+", "/")
    return let(u, lambda t: let(F.struct(t.rlike("[0-9]").alias("digits"), F.regexp_replace(t, r"\b[IL]\b", "1").alias("t")), _combo_parts))


def _plausible_amps(a: Column) -> Column:
    return a.between(15, 250) & (a % 5 == 0)


def _combo_parts(s: Column) -> Column:
    amps_first = r"^([0-9]{2,3})A?(?:\s*/\s*([123])P?|\s*([123])P)$"
    poles_first = r"^([123])(?:P?\s*/\s*|P\s*)([0-9]{2,3})A?$"
    num = lambda p, i: F.nullif(F.regexp_extract(s["t"], p, i), F.lit("")).try_cast("int")
    read = F.struct(
        s["digits"].alias("digits"), F.coalesce(num(amps_first, 1), num(poles_first, 2)).alias("a"),
        F.coalesce(num(amps_first, 2), num(amps_first, 3), num(poles_first, 1)).alias("p"),
        F.transform(F.regexp_extract_all(s["t"], F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int")).alias("nums"))
    return let(read, _combo_result)


def _combo_result(r: Column) -> Column:
    strict = F.coalesce(_plausible_amps(r["a"]), F.lit(False))
    loose_a = F.get(F.filter(r["nums"], _plausible_amps), F.lit(0))
    loose_p = F.get(F.filter(r["nums"], lambda x: x.isin(1, 2, 3)), F.lit(0))
    return F.struct(
        F.when(r["digits"], F.when(strict, r["a"]).otherwise(loose_a)).alias("amps"),
        F.when(r["digits"], F.when(strict, r["p"]).otherwise(loose_p)).alias("poles"),
        F.when(~r["digits"], "nodigits").when(strict, "regex").otherwise("digits").alias("method"))


# Combined-cell patterns as (pattern, amps group, poles group).
COMBO_PATTERNS = [
    (r"\b([0-9]{1,3})\s*/\s*([123])\b", 1, 2),
    (r"\b([123])\s*P(?:OLES?)?\s*[-/]?\s*([0-9]{1,3})\s*A?\b", 2, 1),
    (r"\b([0-9]{1,3})\s*A?\s*[-/ ]\s*([123])\s*P\b", 1, 2),
    (r"\b([0-9]{1,3})\s*[A]?\s*/\s*([123])\s*[P]\b", 1, 2),
]


def parse_combo_lexicon(c: Column, patterns=COMBO_PATTERNS) -> Column:
    """First matching pattern wins; blank rows carry no breaker, spares do."""
    u = _upper(c)
    group = lambda which: F.coalesce(*[
        F.nullif(F.regexp_extract(u, p, (a, b)[which]), F.lit("")).try_cast("int") for p, a, b in patterns])
    word = lambda terms: r"\b(?:" + "|".join(terms) + r")\b"
    return F.struct(
        group(0).alias("amps"), group(1).alias("poles"),
        F.when(u.rlike(word(SPARE_TERMS)), "spare").when(u.rlike(word(EMPTY_ROW_TOKENS)), "empty")
        .otherwise("device").alias("row_kind"))


def describe_row_flags(c: Column) -> Column:
    s = collapse(F.regexp_replace(_upper(c), "[^A-Z0-9 ]", " "))
    letters = F.length(F.regexp_replace(s, "[^A-Z]", ""))
    return (F.when(s.isin(*SPARE_TERMS), "spare")
            .when(s.isin(*BLANK_TERMS), "blank")
            .when(s.rlike("^[0-9 ]*$"), "numeric")
            .when(letters < 2, "short")
            .otherwise("load"))


def safe_int(c: Column, default: int = 0) -> Column:
    d = c.cast("string").try_cast("double")
    return F.coalesce(d.try_cast("int"), F.lit(default))


def digits_int(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "").try_cast("int")


def comma_int(c: Column) -> Column:
    """Whole numbers with thousands separators; anything else is missing."""
    s = F.trim(F.translate(c, ",", ""))
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("int"))


def scrub_none(df, columns: list[str] | None = None):
    """Every `NONE` text of the frame becomes a null."""
    texts = columns or [n for n, t in df.dtypes if t == "string"]
    return df.withColumns({n: F.when(F.upper(F.trim(n)) != "NONE", F.col(n)) for n in texts})


def render_scalar(c: Column) -> Column:
    """Output form: nulls as NONE, whole numbers without a fraction."""
    s = F.trim(c)
    number = F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))
    whole = F.when(number == F.floor(number), F.floor(number).cast("string"))
    return (F.when(s.isNull() | (F.upper(s) == "NONE"), "NONE")
            .otherwise(F.coalesce(whole, number.cast("string"), s)))


def coerce_scalar(c: Column) -> Column:
    """Numeric value of a text attribute, NONE and words are missing."""
    s = F.trim(c)
    return F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))


def coerce_setting(c: Column) -> Column:
    """Typed reading of a setting: its kind and its canonical text."""
    s = F.lower(F.trim(c))
    return F.struct(
        F.when(s.isin("true", "false"), "bool").when(s.rlike("^[0-9]+$"), "int").otherwise("text").alias("kind"),
        F.when(s.isin("true", "false"), s)
        .when(s.rlike("^[0-9]+$"), F.coalesce(s.try_cast("bigint").cast("string"), c)).otherwise(c).alias("value"))


def parse_job_note(c: Column) -> Column:
    """`k=v | k=v` to a struct of the known keys; the last repeat wins."""
    pairs = F.transform(F.filter(F.split(c, r"\|"), lambda p: F.contains(p, F.lit("="))),
                        lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"),
                                           F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    last = lambda k: F.try_element_at(F.filter(pairs, lambda kv: kv["k"] == k), F.lit(-1))["v"]
    return F.struct(*[last(k).alias(k) for k in NOTE_KEYS])


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.translate(F.trim(F.coalesce(c, F.lit(""))), " ", "_"), "[^A-Za-z0-9._-]+", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def job_key(name: Column, submitted: Column) -> Column:
    return F.concat(slugify(name), F.lit("__"), F.date_format(submitted, "yyyyMMdd_HHmmss"))


def format_cycle_time(ms: Column) -> Column:
    v = F.when(ms > 0, ms).otherwise(0).cast("long")
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    hours = F.floor(v / 3600000).cast("string")
    return F.concat_ws(":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours),
                       part(v / 60000 % 60, 2), part(v / 1000 % 60, 2), part(v % 1000, 3))


def format_duration(ms: Column) -> Column:
    v = F.greatest(ms.cast("long"), F.lit(0))
    whole = lambda x: F.floor(x).cast("string")
    tail = F.concat(whole(v / 1000 % 60), F.lit("."), F.lpad((v % 1000).cast("string"), 3, "0"), F.lit("s"))
    minutes = F.concat(whole(v / 60000 % 60), F.lit("m "))
    return (F.when(v >= 3600000, F.concat(whole(v / 3600000), F.lit("h "), minutes, tail))
            .when(v >= 60000, F.concat(minutes, tail)).otherwise(tail))
