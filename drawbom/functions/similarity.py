"""Ratcliff-Obershelp similarity, the one text measure Spark lacks.

Arrow batches come in, each distinct text of a batch is scored once, and a
bounded per-worker cache carries scores from batch to batch. There is no
shuffle, so a word that makes up a third of the corpus costs nothing extra.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed values -------------------------------------------------------------
ROLE_VOCAB = {
    "ckt": ["CKT", "CCT", "CKT NO", "CKT NO.", "CIRCUIT NO"],
    "description": ["CIRCUIT DESCRIPTION", "DESCRIPTION", "LOAD DESCRIPTION", "DESIGNATION", "LOAD DESIGNATION", "NAME"],
    "trip": ["TRIP", "AMPS", "AMP", "BREAKER", "BKR", "SIZE", "BRKR", "BRKR AMP", "BRKR AMPS"],
    "poles": ["POLES", "POLE", "P", "AMP, POLES", "AMPS, POLES", "BRKR POLES"],
}
NOTE_WORDS = ["NOTE", "NOTES", "REMARK", "REMARKS", "COMMENT", "COMMENTS"]
CKT_WORDS = ["CKT", "CCT", "NO", "NO."]
DESC_WORDS = ["DESCRIPTION", "CIRCUIT DESCRIPTION", "LOAD DESCRIPTION", "DESIGNATION", "LOAD DESIGNATION", "NAME"]
TRIP_HEROES = [(5, ["AMP", "AMPS"]), (4, ["TRIP", "TRIPPING"]), (3, ["LOAD"]), (2, ["SIZE"]), (1, ["BREAKER", "BKR", "BRKR", "CB"])]
POLE_HEROES = ["POLE", "POLES", "PO.", "PO"]
HEADER_NAMES = ["SCHEDULE", "DESIGNATION", "DESIGN", "PANELBOARD", "PANEL"]
_FOLD = str.maketrans({**dict.fromkeys("0Q", "O"), **dict.fromkeys("1LJ!|", "I"), "5": "S", "$": "S", "2": "Z", "8": "B"})
# --------------------------------------------------------------------------
CACHE = 200_000


def fold(word: str) -> str:
    return "".join(c for c in word.upper().translate(_FOLD) if c.isascii() and c.isalnum())


def norm_label(text: str) -> str:
    """Label text with abbreviations and punctuation evened out."""
    s = " ".join(text.upper().split())
    for old in ("AMP .", "AMP.", "AMP "):
        s = s.replace(old, "AMP")
    return " ".join("".join(" " if c in "[]():.,/_-" else c for c in s).split())


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@lru_cache(maxsize=None)
def _matcher(target: str) -> SequenceMatcher:
    """What a matcher has to know of a target, learnt once."""
    return SequenceMatcher(None, "", target)


def at_least(word: str, target: str, threshold: float) -> bool:
    """ratio(word, target) >= threshold; its cheap upper bounds come first."""
    m = _matcher(target)
    m.set_seq1(word)
    return m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold


@lru_cache(maxsize=CACHE)
def _like(word: str, targets: tuple, base: float, short: float, short_len: int) -> bool:
    return any(at_least(word, t, max(base, short) if len(t) <= short_len else base) for t in targets)


def _folded(words: list[str]) -> tuple:
    return tuple(fold(w) for w in words)


@lru_cache(maxsize=CACHE)
def header_word_facts(raw: str) -> tuple:
    """(notes, ckt, description, trip rank, poles rank) of one header word."""
    w = fold(raw)
    if not w or not any(c.isalpha() for c in w):
        return (False, False, False, 0, 0)
    like = lambda targets, base: _like(w, _folded(targets), base, 0.88, 3)
    hero = lambda targets: _like(w, _folded(targets), 0.75, 0.90, 4)
    trip = next((rank for rank, ws in TRIP_HEROES if hero(ws)), 0)
    poles = 4 if hero(POLE_HEROES) else 1 if w == "P" else 0
    return (like(NOTE_WORDS, 0.80), like(CKT_WORDS, 0.95), like(DESC_WORDS, 0.70), trip, poles)


@lru_cache(maxsize=CACHE)
def best_role_scores(label: str) -> tuple:
    a = norm_label(label)
    return tuple(max(ratio(a, norm_label(v)) for v in words) for words in ROLE_VOCAB.values())


@lru_cache(maxsize=CACHE)
def _folded_ratio(a: str, b: str) -> float:
    return ratio(fold(a), fold(b))


@lru_cache(maxsize=None)
def _matchers(vocab: tuple) -> list:
    return [SequenceMatcher(None, "", fold(v)) for v in vocab]


@lru_cache(maxsize=CACHE)
def _best_of(text: str, vocab: tuple) -> tuple:
    """Most similar word, the first on ties; cheap upper bounds come first."""
    a, top, score = fold(text), 0, -1.0
    for i, m in enumerate(_matchers(vocab)):
        m.set_seq1(a)
        if m.real_quick_ratio() > score and m.quick_ratio() > score:
            r = m.ratio()
            if r > score:
                top, score = i, r
    return vocab[top], score


def _by_distinct(texts: pd.Series, fn, columns: list[str]) -> pd.DataFrame:
    codes, uniques = pd.factorize(texts.fillna(""))
    table = pd.DataFrame([fn(u) for u in uniques], columns=columns)
    return table.iloc[codes].reset_index(drop=True)


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts after folding look-alike characters."""
    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        (left, ps), (right, qs) = pd.factorize(x.fillna("")), pd.factorize(y.fillna(""))
        codes, pairs = pd.factorize(left.astype("int64") * max(len(qs), 1) + right)
        table = pd.Series([_folded_ratio(ps[k // len(qs)], qs[k % len(qs)]) for k in pairs.tolist()], dtype=float)
        return table.iloc[codes].reset_index(drop=True)
    return score(a, b)


def best_vocab_match(c: Column, vocab: list[str]) -> Column:
    """Struct of the most similar vocabulary word and its score."""
    @F.pandas_udf("word string, score double")
    def best(x: pd.Series) -> pd.DataFrame:
        return _by_distinct(x, lambda text: _best_of(text, tuple(vocab)), ["word", "score"])
    return best(c)


def header_facts(c: Column) -> Column:
    @F.pandas_udf("notes boolean, ckt boolean, description boolean, trip int, poles int")
    def facts(x: pd.Series) -> pd.DataFrame:
        return _by_distinct(x, header_word_facts, ["notes", "ckt", "description", "trip", "poles"])
    return facts(c)


def role_scores(c: Column) -> Column:
    """Best similarity of a label to the words of each column role."""
    @F.pandas_udf("ckt double, description double, trip double, poles double")
    def scores(x: pd.Series) -> pd.DataFrame:
        return _by_distinct(x, best_role_scores, list(ROLE_VOCAB))
    return scores(c)


@lru_cache(maxsize=CACHE)
def _header_name(text: str, threshold: float) -> tuple:
    base = "".join(ch for ch in text.upper() if "A" <= ch <= "Z")
    return (bool(base) and any(at_least(base, w, threshold) for w in HEADER_NAMES),)


def looks_like_header_word(c: Column, threshold: float = 0.74) -> Column:
    """Near misses of words such as SCHEDULE, which are never names."""
    @F.pandas_udf("boolean")
    def guard(x: pd.Series) -> pd.Series:
        return _by_distinct(x, lambda t: _header_name(t, threshold), ["hit"])["hit"]
    return guard(c)
