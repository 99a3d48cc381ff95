"""Licence scans by sentence rules.

A text is cut into sentences, each normalised sentence is looked up among known licence
sentences, and the sequence of their identifiers is matched against ordered rules; a
rule takes what it matches out of the sequence. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Normalised sentences of published licences and of notices that name them,
# cut as `sentences` cuts them. The value of an SPDX tag ends with its line.
SENTENCES = {
    "this work is licensed under the gnu general public license version 3": "GPL3named",
    "this program is licensed under the gnu general public license version 2": "GPL2named",
    "licensed under cc by nc 4 0": "CCBYNC4named",
    "licensed under cc by 4 0": "CCBY4named",
    "licensed under cc by sa 4 0": "CCBYSA4named",
    "licensed under the apache license version 2 0": "Apache2named",
    "licensed under the apache license version 2 0 the license": "Apache2the",
    "released under the mit license": "MITnamed",
    "licensed under the mit license": "MITnamed",
    "released under the bsd license": "BSDnamed",
    "you may not use this file except in compliance with the license": "Apache2use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "Apache2copy",
    "you may obtain a copy of the license at": "CopyAt",
    "http www apache org licenses license 2 0": "Apache2url",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDname",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCgrant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2later",
    "this program is free software": "GPLfree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GPLterms",
    "either version 3 of the license or at your option any later version": "GPL3either",
    "either version 2 of the license or at your option any later version": "GPL2either",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3rest",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2rest",
    "spdx license identifier mit": "MITnamed",
    "spdx license identifier apache 2 0": "Apache2named",
    "spdx license identifier gpl 3 0 only": "GPL3named",
}
# Ordered rules over "<id><id>": each takes what it matches out of the sequence.
RULES = [
    ("MIT", "<MITgrant><MITnotice>"), ("BSD-3-Clause", "<BSDgrant><BSDsource><BSDbinary><BSDname>"), ("BSD-2-Clause", "<BSDgrant><BSDsource><BSDbinary>"),
    ("Apache-2.0", "<Apache2the><Apache2use>(<Apache2copy>|<CopyAt><Apache2url>)?"), ("ISC", "<ISCgrant>"),
    ("GPL-3.0-or-later", "<GPL3later>|<GPLfree>(<GPL3rest>|<GPLterms><GPL3either>)"), ("GPL-2.0-or-later", "<GPL2later>|<GPLfree>(<GPL2rest>|<GPLterms><GPL2either>)"),
    ("GPL-3.0", "<GPL3named>"), ("GPL-2.0", "<GPL2named>"), ("Apache-2.0", "<Apache2(named|the)>"), ("CC-BY-NC-4.0", "<CCBYNC4named>"),
    ("CC-BY-SA-4.0", "<CCBYSA4named>"), ("CC-BY-4.0", "<CCBY4named>"), ("MIT", "<MIT(named|grant)>"), ("BSD", "<BSDnamed>"),
]
WORTH = "(?i)licen|permi|distribut|neither|copyright|free software"
SPACE = "[ \\t\\n\\f\\r]"


def sentences(text: Column) -> Column:
    """Sentences of a text: ended by punctuation before white space, or by a blank line."""
    ended = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"([.!?;:]){SPACE}+", "$1\x1e"), f"\\n[ \\t]*\\n{SPACE}*", "\x1e")
    return F.filter(F.split(ended, "\x1e"), lambda s: s.rlike("[0-9A-Za-z]"))


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", " "))


def identifiers(found: Column, table: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences, in order; of a sentence that runs over several
    lines, its last line is tried as well, for notices that follow an open line. What
    follows the colon of an SPDX tag is looked up by its first line."""
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def look(s: Column, i: Column) -> Column:
        last = F.substring_index(s, "\n", -1)
        whole = F.when(s.rlike(WORTH), F.element_at(known, normal(s)))
        tagged = F.when((i > 0) & F.get(found, i - 1).rlike("(?i)spdx-license-identifier:$"), F.element_at(known, F.concat(F.lit("spdx license identifier "), normal(F.substring_index(s, "\n", 1)))))
        return F.coalesce(tagged, whole, F.when(s.contains("\n") & last.rlike(WORTH), F.element_at(known, normal(last))))
    return F.filter(F.transform(found, look), lambda x: x.isNotNull())


def recognised(ids: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """(left, licences): the sequence that no rule takes, and the licences in rule order."""
    start = F.struct(F.concat(F.lit("<"), F.array_join(ids, "><"), F.lit(">")).alias("left"), F.array().cast("array<string>").alias("licences"))
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(p).alias("p")) for n, p in rules])
    return F.aggregate(table, start, lambda acc, r: F.when(F.regexp_like(acc["left"], r["p"]), F.struct(
        F.regexp_replace(acc["left"], r["p"], "").alias("left"), F.array_union(acc["licences"], F.array(r["n"])).alias("licences"))).otherwise(acc))


def scan(docs: DataFrame) -> DataFrame:
    """`doc_id, n_sentences, n_known, sentence_ids, licences` for every row of docs(doc_id,
    text): identifiers in order and licences by name, comma-joined. A null or empty text
    has no sentences; repeated rows give a row each; extra columns are ignored."""
    found = docs.select("doc_id", sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), identifiers(F.col("s")).alias("ids"))
    named = F.when(F.size("ids") > 0, F.array_join(F.array_sort(recognised(F.col("ids"))["licences"]), ",")).otherwise(F.lit(""))
    return found.select("doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", ",").alias("sentence_ids"), named.alias("licences"))
