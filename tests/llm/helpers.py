"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the house of old river and green stone in light winter that runs quiet over field was bread with open window on market day".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice("aeiou") * rng.randint(0, 2)) for _ in range(n))


def awkward(spark, extra: bool = True):
    """Documents with every awkward case; `extra` adds columns whose names operators use inside."""
    rows = [(i, prose(i, 5 + 7 * i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100, None, None, None), (101, "", "en", ""), (102, " \n\t ", None, "s"), (103, "?!", "de", "s"), (104, prose(4, 33), "en", "s"), (105, "word", "en", "s"),
             (106, prose(1, 20000), "en", "s"), (107, "x" * 200000, None, None), (108, "é😀 " * 400, "fr", "s"), (3, prose(3, 26), "en", "s0"), (3, prose(3, 26), "en", "s0"), (None, prose(77, 40), "en", "s"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], DOCS)
    if extra:
        from pyspark.sql import functions as F
        for name in ("row", "raw", "own", "id", "fp", "spans", "base", "found", "_text", "accepted", "score", "lang_pred", "n", "nth", "_nth", "rid", "part", "rank"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)
