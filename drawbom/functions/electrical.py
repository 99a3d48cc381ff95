"""Electrical attributes read from text, and plausibility predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from drawbom.functions.text import fix_digit_ocr

# Fixed values -------------------------------------------------------------
VOLTAGES = [120, 208, 240, 480, 600]
PAIR_VOLTAGES = [120, 208, 240, 277, 480, 600]
SMALL_KA = [10, 14, 18, 22, 25, 30, 35, 42, 50, 65, 100, 125, 200]
COMMON_TRIPS = [15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100, 125, 150, 175, 200, 225,
                250, 300, 350, 400, 450, 500, 600, 800, 1000, 1200]
PANEL_SIZES = [18, 30, 42, 54, 66, 72, 84]          # real sizes; a reading may be two off
# --------------------------------------------------------------------------

AMPS_WITH_UNIT = r"\b([6-9][0-9]|[1-9][0-9]{2,3})\s*(?:A|AMPS?)\b"
AMPS_BARE = r"(?<![0-9])([6-9][0-9]|[1-9][0-9]{2,3})(?![0-9])"


def _num(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def parse_voltage(c: Column, mode: str = "trim") -> Column:
    """System voltage of a reading.

    trim: highest known voltage found anywhere; validate: both sides of a pair,
    else a single value; legacy: largest number, 120 when 240 stands beside it.
    """
    if mode == "trim":
        s = fix_digit_ocr(F.upper(c))
        return F.greatest(*[F.when(F.contains(s, F.lit(str(v))), v) for v in VOLTAGES])
    if mode == "validate":
        alts = "|".join(map(str, PAIR_VOLTAGES))
        pair = rf"(?i)(?<![0-9])({alts})\s*[Y/]\s*({alts})(?![0-9])"
        single = rf"(?<![0-9])({'|'.join(map(str, VOLTAGES))})(?![0-9])"
        high = F.greatest(_num(F.regexp_extract(c, pair, 1)), _num(F.regexp_extract(c, pair, 2)))
        return (F.when(high.isNotNull(), F.when(high.isin(*VOLTAGES), high))
                .otherwise(_num(F.regexp_extract(c, single, 1))))
    nums = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![0-9])([0-9]{2,4})(?![0-9])"), F.lit(1)),
                       lambda x: x.cast("int"))
    return (F.when(F.array_contains(nums, 120) & F.array_contains(nums, 240), 120)
            .otherwise(F.array_max(nums)))


def parse_amps(c: Column) -> Column:
    s = fix_digit_ocr(F.upper(c))
    return F.coalesce(_num(F.regexp_extract(s, AMPS_WITH_UNIT, 1)), _num(F.regexp_extract(s, AMPS_BARE, 1)))


def parse_kaic(c: Column) -> Column:
    """Interrupting rating in kA from `65kA`, `65,000` or a known small value."""
    s = fix_digit_ocr(F.upper(c))
    tight = F.translate(s, " ", "")
    marked = F.when(F.contains(tight, F.lit("KA")), _num(F.regexp_extract(tight, r"\b([0-9]{2,3})K?A\b", 1)))
    thousands = _num(F.translate(F.regexp_extract(s, r"\b([0-9]{2,3},?[0-9]{3})\s*(?:A|KA)?\b", 1), ",", ""))
    small = _num(F.regexp_extract(s, r"(?<![0-9])([0-9]{2,3})(?![0-9])", 1))
    return F.coalesce(marked,
                      F.when(thousands.isNotNull(), F.greatest(F.lit(1), F.floor(thousands / 1000).cast("int"))),
                      F.when(small.isin(*SMALL_KA) & ~s.rlike(r"\bA(MPS?)?\b"), small))


def plausible_trip(c: Column, common_only: bool = False) -> Column:
    n = F.regexp_extract(F.trim(c), r"^([0-9]+)$", 1).try_cast("int")
    ok = n.between(10, 1200) & (n % 5 == 0)
    return F.coalesce(ok & n.isin(*COMMON_TRIPS) if common_only else ok, F.lit(False))


def plausible_poles(c: Column) -> Column:
    n = _num(F.regexp_extract(c, "([0-9]+)", 1))
    return F.coalesce(n.isin(1, 2, 3) & ~F.upper(c).contains("A") & ~F.contains(c, F.lit(".")), F.lit(False))


def valid_bus_amp(c: Column) -> Column:
    return F.coalesce(c.between(100, 1200) & (c % 5 == 0), F.lit(False))


def snap_spaces(c: Column, both_sides: bool = True) -> Column:
    """Readings two above (and, when parsing, two below) a real size.

    Between 66 and 72 both neighbours differ by less than four, so 70 goes up.
    """
    table = {}
    for size in PANEL_SIZES:
        if both_sides:
            table.setdefault(size - 2, size)
        table[size + 2] = size
    literal = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.coalesce(F.try_element_at(literal, c), c)


def breaker_desc_from_pn(c: Column) -> Column:
    """`EDB14020` -> `20A 1P`."""
    p = r"^[A-Z]+([0-9])[A-Z0-9]*?([0-9]{2,3})$"
    s = F.upper(c)
    poles, amps = _num(F.regexp_extract(s, p, 1)), _num(F.regexp_extract(s, p, 2))
    return (F.when((poles >= 1) & (amps >= 1), F.concat(amps.cast("string"), F.lit("A "), poles.cast("string"), F.lit("P")))
            .otherwise(""))


def phase_from_volts(primary: Column, secondary: Column) -> Column:
    return F.when((secondary == 120) & primary.isin(240, 277, 208, 600), "1PHASE").otherwise("3PHASE")
