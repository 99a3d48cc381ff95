"""Catalog dimensions: small sample tables, most of them built from a rule.

A catalog is an ordinary input table of the rules; these are the ones the tests
and registered queries use. Every table is a literal relation, so its size is
known to the optimiser, which broadcasts it only below the session threshold.
"""

from __future__ import annotations

# Rating ladders ---------------------------------------------
BRANCH = [10, 15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100, 110, 125, 150, 175, 200]
EFRAME = [15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100, 110, 125]
H_AMPS = [15, 20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 100, 110, 125, 150]
J_AMPS = [150, 175, 200, 225, 250]
Q_AMPS = [70, 80, 90, 100, 110, 125, 150, 175, 200, 225, 250]
LL_AMPS = [125, 150, 175, 200, 225, 250, 300, 350, 400]
FUSES = [20, 25, 30, 35, 40, 45, 50, 60, 70, 75, 80, 90, 100, 110, 125, 150, 175, 200, 225, 250, 300, 350, 400,
         450, 500, 600, 800]
LOADCENTER_SPACES = [4, 8, 12, 16, 24, 32, 40, 48, 60, 80, 84, 120]
INTERRUPTING = {
    "B": {240: [25, 65, 100], 480: [18, 35, 65], 600: [14, 18, 25, 65]},
    "H": {240: [25, 65, 100, 125, 200], 480: [18, 35, 65, 100, 200], 600: [14, 18, 25, 50, 100]},
    "J": {240: [25, 65, 100, 125, 200], 480: [18, 35, 65, 100, 200], 600: [14, 18, 25, 50, 100]},
    "Q": {240: [10, 25, 65, 100]},
    "L": {240: [25, 65, 100, 125, 200], 480: [18, 35, 65, 100, 200], 600: [14, 18, 25, 50, 100]},
    "LL": {240: [42, 65], 480: [30, 35], 600: [22, 25]},
    "M": {240: [65, 100], 480: [35, 65], 600: [18, 25]},
    "P": {240: [65, 100, 125], 480: [35, 50, 65, 100], 600: [18, 25, 50]},
    "R": {240: [65, 100, 125], 480: [35, 65, 100], 600: [18, 25, 50, 65]},
}
# frame: (order, width of 2 poles, width of 3 poles, highest voltage, ratings)
FRAMES = {
    "Q": (1, 3.0, 4.5, 240, Q_AMPS), "H": (2, 4.5, 4.5, 600, H_AMPS), "J": (3, 4.5, 4.5, 600, J_AMPS),
    "LL": (4, None, 6.0, 600, LL_AMPS), "L": (5, 6.0, 6.0, 600, [250, 400, 600]), "M": (6, 9.0, 9.0, 600, [400, 600]),
    "P": (7, None, 9.0, 600, [250, 400, 600, 800, 1000, 1200]), "R": (8, None, 15.0, 600, [1000, 1200]),
}
ELECTRONIC = {"H": [60, 100, 150], "J": [250], "L": [250, 400, 600], "M": [400, 600],
              "P": [250, 400, 600, 800, 1000, 1200], "R": [1000, 1200]}
DEFAULTS = {
    "panelboards": {"bussing_material": "ALUMINUM", "allow_plug_on_breakers": "true", "rating_type": "FULLY_RATED",
                    "allow_feed_thru_lugs": "true", "default_trim_style": "FLUSH", "enclosure": "NEMA1",
                    "allow_square_d_spd": "true"},
    "transformers": {"winding_material": "ALUMINUM", "temperature_rating": "150", "default_type": "3PHASESTANDARD",
                     "weathershield": "false", "mounting": "FLOOR", "resin_enclosure": "3R"},
    "disconnects": {"allow_littlefuse": "true", "default_switch_type": "GENERAL_DUTY", "default_enclosure": "NEMA1",
                    "default_fusible": "true", "default_ground_required": "true", "default_solid_neutral": "true"},
}
SETTING_ALIASES = {"material": "bussing_material", "allowPlugOn": "allow_plug_on_breakers",
                   "panelRatingType": "rating_type", "trimStyle": "default_trim_style", "nema": "enclosure"}
SPD_PARTS = [
    ("120", 100, "HWB11"), ("120", 200, "EMB12"), ("120", 300, "HWC13"), ("120", 500, "EMD13"),
    ("208", 100, "HWB21"), ("208", 200, "EMB22"), ("208", 300, "HWC23"), ("208", 500, "EMD25"), ("208", 600, "EMD26"),
    ("240", 100, "HWB61"), ("240", 200, "EMB62"), ("240", 300, "HWC63"),
    ("480", 100, "HWB41"), ("480", 200, "EMB42"), ("480", 300, "HWC43"), ("480", 500, "EMD45"), ("480", 600, "EMD46"),
    ("480DELTA", 100, "HWB51"), ("480DELTA", 200, "EMB52"), ("480DELTA", 300, "HWC53"), ("480DELTA", 500, "EMD55"),
    ("600", 100, "HWB91"), ("600", 200, "HWC93"), ("600", 300, "HWC93"),
]
FILLERS = [("QO", "QOFP", 1), ("HOM", "HOMFP", 5), ("NQ", "NQFP15", 15), ("NF", "NFFP15", 15)]
BLANK_PACKS = [("HLW1BL", 3, 1), ("HLN1BL", 3, 1), ("HLW4EBL", 5, 3)]
NEUTRALS = [
    ("NQ", "100%", 100, "NQN1CU"), ("NQ", "100%", 225, "NQN2CU"), ("NQ", "100%", 400, "NQN6CU"), ("NQ", "100%", 600, "NQN6CU"),
    ("NQ", "200%", 100, "NQNL1"), ("NQ", "200%", 225, "NQNL2"), ("NQ", "200%", 400, "NQNL4"),
    ("NF", "100%", 100, "NFN1CU"), ("NF", "100%", 250, "NFN2CU"), ("NF", "100%", 400, "NFN6CU"), ("NF", "100%", 600, "NFN6CU"),
    ("NF", "200%", 100, "NFNL1"), ("NF", "200%", 250, "NFNL2"), ("NF", "200%", 400, "NFNL4"),
    ("I-LINE", "100%", 400, "HCW4SN"), ("I-LINE", "100%", 600, "HCW6SN"), ("I-LINE", "100%", 800, "HCW8SN"),
    ("I-LINE", "100%", 1200, "HCW12SN"),
]
# item type: (row order, selectable, included)
BOM_POLICY = {
    "Interior": (10, True, True), "Interior/Box": (10, True, True), "Box": (20, True, True),
    "Main Breaker": (25, True, True), "Main Breaker Kit": (25, True, True),
    "Trim": (30, True, True), "Cover": (30, True, True),
    "Ground Bar Kit": (40, True, True), "Neutral": (40, True, False), "Neutral (100%)": (40, True, False),
    "Neutral (200%)": (40, True, False), "Feed-Thru Lugs": (40, True, False), "SPD": (40, True, False),
    "Service Entrance Kit": (40, True, False), "Service Entrance Barrier Kit": (40, True, False),
    "Breaker": (60, True, True), "Blanks/Filler": (70, True, True),
    "Note": (90, False, False), "Skipped": (90, False, False),
}
# --------------------------------------------------------------------------


def _ladder():
    up_to = lambda top, vals: [v for v in vals if v <= top]
    vh = [v for v in BRANCH if v not in (10, 35, 45)]
    table = {}
    for plain in ("QO", "QOB"):
        table[plain] = {1: up_to(70, BRANCH), 2: BRANCH, 3: up_to(100, BRANCH)}
        table[plain + "-VH"] = {1: up_to(70, vh), 2: vh, 3: up_to(100, vh)}
    table["QOH"] = {p: [v for v in BRANCH if 40 <= v <= 125] for p in (1, 2)}
    for h in ("QH", "QHB"):
        table[h] = {p: [15, 20, 25, 30] for p in (1, 2, 3)}
    table["E"] = {1: up_to(70, EFRAME), 2: EFRAME, 3: EFRAME}
    return [(f, p, r) for f, by in table.items() for p, rs in by.items() for r in rs]


def _frames():
    return [(o, f, p, w, mv, r) for f, (o, w2, w3, mv, rs) in FRAMES.items()
            for p, w in ((2, w2), (3, w3)) if w is not None for r in rs]


def _int_ratings():
    return [(f, v, k) for f, by in INTERRUPTING.items() for v, ks in by.items() for k in ks]


def _pair_rules():
    """Which phase pairs a rating is made for: a sample rule, three in four."""
    pairs, letters = ["AB", "AC", "BA", "BC", "CA", "CB"], ["D", "G", "J", "L"]
    return [(f, l, p, a) for f, amps in (("H", H_AMPS), ("J", J_AMPS)) for i, l in enumerate(letters)
            for j, p in enumerate(pairs) for a in amps if (a // 5 + i + 2 * j) % 4]


def _panel_catalog():
    rows, ord_ = [], 0

    def add(family, main, lo, hi, spaces, volts, frames=None):
        nonlocal ord_
        for v in volts:
            ord_ += 1
            phase = "1PHASE" if v == 120 else "3PHASE"
            kit = f"{family}MB{hi}"
            rows.append((family, ord_, main, lo, hi, spaces, phase, v, f"{family}4{spaces}{'L' if main == 'MAIN LUG' else 'M'}{hi // 25}",
                         20 + spaces // 2, frames, kit if frames else None, kit + "Q" if frames else None))

    for a in (100, 225, 400, 600):
        for s in (30, 42, 54, 72, 84):
            add("NQ", "MAIN LUG", a, a, s, (120, 208))
    for a in (125, 250, 400, 600, 800):
        for s in (18, 30, 42, 54, 66, 84):
            if a > 125 or s <= 54:
                add("NF", "MAIN LUG", a, a, s, (208, 240, 480))
    for lo, hi, frames in ((60, 100, "H"), (110, 225, "Q,J"), (250, 400, "LL,L"), (450, 600, "L")):
        for s in (30, 42, 54, 84):
            add("NQ", "MAIN BREAKER", lo, hi, s, (120, 208, 240), frames)
    for lo, hi, frames in ((15, 125, "H"), (126, 250, "J"), (125, 600, "L")):
        for s in (30, 42, 54, 66):
            add("NF", "MAIN BREAKER", lo, hi, s, (208, 240, 480), frames)
    # a key that occurs twice: the later row replaces the earlier one
    for spaces, interior in ((42, "NQ442L4X"), (30, "NQ430L4X")):
        rows.append(("NQ", 900 + spaces, "MAIN LUG", 100, 100, spaces, "3PHASE", 208, interior, 99, None, None, None))
    return rows


def _iline_catalog():
    shapes = {"HCJ": ((400, 600, 800), (27, 36, 45, 72), ("ALUMINUM",)),
              "HCP": ((400, 600, 800), (36, 54, 72, 99), ("ALUMINUM", "COPPER")),
              "HCR-U": ((1200,), (63, 81, 108), ("ALUMINUM", "COPPER"))}
    rows, ord_ = [], 0
    for series, (amps, spaces, metals) in shapes.items():
        for main in ("MAIN LUG", "MAIN BREAKER"):
            for a in amps:
                for s in spaces:
                    for m in metals:
                        for encl, trim in (("NEMA1", "FLUSH"), ("NEMA1", "SURFACE"), ("NEMA3R", None)):
                            if m == "COPPER" and encl == "NEMA3R" and series == "HCP":
                                continue
                            ord_ += 1
                            rows.append((series, ord_, main, a, s, encl, m, trim,
                                         f"{series.replace('-', '')}{s}{a // 100}{main[5]}", f"HC{40 + s}"))
    return rows


def _loadcenters():
    rows = []
    for family, cover in (("HOM", "HOMC"), ("QO", "QOC")):
        for main in "LM":
            for a in (100, 125, 200, 225):
                for s in (12, 16, 24, 32, 40, 48, 60, 84):
                    for style in ("Flush", "Surface"):
                        if (a + s) % 3 or family == "QO":
                            rows.append((family, "NEMA1", "1PHASE", main, a, s, True, style, False, "Standard", False,
                                         f"{family}1{s}{main}{a}P", f"{cover}{s}{style[0]}"))
    return rows


def _disconnects():
    rows = []
    enclosure_code = {"NEMA1": "N", "NEMA3R": "NRB", "NEMA4X": "DS"}
    for family, fus, poles, volts, amps in (
            ("GENERAL_DUTY", True, 2, 240, (30, 60, 100, 200, 400, 600)), ("GENERAL_DUTY", True, 3, 240, (30, 60, 100, 200, 400, 600, 800)),
            ("GENERAL_DUTY", False, None, 240, (30, 60, 100, 200, 400, 600)),
            ("HEAVY_DUTY", True, 2, 600, (30, 60, 100)), ("HEAVY_DUTY", True, 3, 600, (30, 60, 100, 200, 400, 600, 800, 1200)),
            ("HEAVY_DUTY", False, 3, 600, (30, 60, 100, 200, 400, 600, 800, 1200))):
        for i, a in enumerate(amps):
            for encl, code in enclosure_code.items():
                if encl == "NEMA4X" and (family == "GENERAL_DUTY" or a > 400) or (a == 800 and encl == "NEMA1"):
                    continue
                letter = {"GENERAL_DUTY": "D", "HEAVY_DUTY": "H"}[family] + ("" if fus else "U")
                rows.append((family, fus, poles, volts, a, encl, f"{letter}{poles or 3}{2 if volts == 240 else 6}{i + 1}{code}",
                             f"GTK{a:04d}"[:7], f"SN{a:04d}" if a <= 600 and fus else None))
    return rows


def _transformers():
    rows = []
    three, one = (15, 30, 45, 75, 112.5, 150, 225, 300), (15, 25, 37.5, 50, 75, 100, 167)
    for t, temp, volts, kvas in (("3PHASESTANDARD", 150, ((480, 208), (480, 240)), three), ("3PHASE115DEGREE", 115, ((480, 208),), three[:6]),
                                 ("3PHASE80DEGREE", 80, ((480, 208),), three[:5]), ("K13", 150, ((480, 208),), three[:7]),
                                 ("1PHASESTANDARD", 150, ((240, 120), (600, 120), (208, 120), (277, 120)), one)):
        for p, s in volts:
            for core in ("ALUMINUM", "COPPER"):
                if core == "COPPER" and t == "1PHASESTANDARD":
                    continue
                for k in kvas:
                    if core == "ALUMINUM" and t == "3PHASESTANDARD" and k == 300:
                        continue
                    phase = "S" if t == "1PHASESTANDARD" else "T"
                    rows.append((t, p, s, core, temp, float(k), f"EX{int(k)}{phase}{p // 16}H{'CU' if core == 'COPPER' else ''}{temp if temp < 150 else ''}"))
    for p, s in ((480, 208), (480, 240), (240, 120), (208, 120)):
        for core in ("3R", "SS", "4X"):
            for k in (3, 6, 9, 15, 30):
                rows.append(("RESIN", p, s, core, 115, float(k), f"{k}S{p // 16}{core}"))
    for temp in (115, 80):
        for k in one[:6]:
            rows.append(("WATCHDOG", 240, 120, "ALUMINUM", temp, float(k), f"EE{int(k)}SW{temp}"))
    return rows


# name -> (column specs, rows)
CATALOGS = {
    "ladder": ("family:s poles:i rating:i", _ladder()),
    "frames": ("ord:i frame:s poles:i width:d max_volts:i rating:i", _frames()),
    "int_ratings": ("frame:s voltage:i ka:i", _int_ratings()),
    "pair_rules": ("frame:s letter:s pair:s amps:i", _pair_rules()),
    "panel_catalog": ("family:s ord:i main:s min_amps:i max_amps:i spaces:i phase:s voltage:i interior:s box:i frames:s kit:s kit_q:s", _panel_catalog()),
    "iline_catalog": ("series:s ord:i main:s amps:i spaces:i enclosure:s material:s trim:s interior:s box:s", _iline_catalog()),
    "loadcenters": ("family:s enclosure:s phasing:s main:s amps:i spaces:i plug_on:b cover_style:s value_pack:b application:s quik_grip:b product:s cover:s", _loadcenters()),
    "disconnects": ("family:s fusible:b poles:i volts:i amps:i enclosure:s product:s ground_kit:s neutral_kit:s", _disconnects()),
    "transformers": ("type:s primary_volts:i secondary_volts:i core:s temperature:i kva:d product:s", _transformers()),
    "default_settings": ("domain:s key:s value:s", [(d, k, v) for d, kv in DEFAULTS.items() for k, v in kv.items()]),
    "spd_parts": ("service:s ka:i product:s", SPD_PARTS),
    "fillers": ("panel_type:s product:s pack_size:i", FILLERS),
    "blank_packs": ("product:s pack_size:i spaces_each:i", BLANK_PACKS),
    "neutrals": ("family:s size:s amps:i product:s", NEUTRALS),
    "bom_policy": ("item_type:s ord:i selectable:b include:b", [(t, *v) for t, v in BOM_POLICY.items()]),
}
_TYPES = {"s": ("STRING", "VARCHAR"), "i": ("INT", "INTEGER"), "d": ("DOUBLE", "DOUBLE"), "b": ("BOOLEAN", "BOOLEAN")}


def values_sql(name: str, spark: bool) -> str:
    specs, rows = CATALOGS[name]
    cols = [c.split(":") for c in specs.split()]

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return f"'{v}'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {_TYPES[t][0 if spark else 1]}) AS {c}" for c, t in cols)
    return f"SELECT {casts} FROM (VALUES {body}) AS v({', '.join(c for c, _ in cols)})"
