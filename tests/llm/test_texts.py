import hashlib
import random
import re
import time

import pytest
import xxhash
from pyspark.sql import functions as F

from drawbom.llm import decontaminate, langid, licenses, pii, quality, simhash, spotsigs

from helpers import awkward, empty, prose, rows

FORMATS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def fixed_formats(text):
    out = []
    for k, (kind, p) in enumerate(FORMATS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if not (kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return ",".join(f"{list(FORMATS)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_fixed_formats_as_by_brute_force(spark):
    rng = random.Random(1)
    bits = ["a", "b.", "@", "1", "22", ".", "-", " ", "+", "(4", "é", "😀", "255", "4111 1111 1111 1111", "_", "\n", "999999"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["7" * 50000, "a" * 50000, "1." * 20000, "a@b" + ".c" * 20000, "+1" + " " * 50000, "a@" * 20000, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for r in pii.detect(df).collect():
        want = fixed_formats(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_generators_propose_numbers_and_addresses_in_running_text(spark):
    number = ["555-123-4567", "4111 1111 1111 1111", "123-45-6789", "(555) 123-4567", "555.123.4567"]
    address = ["john[at]example.com", "john.doe(at)example.org", "f(x)(at)example.org", "ann@example.org", "a" * 90 + "@example.org"]
    cases = [(f"{before}{x}{after}", [x]) for x in number for before in ("", "call ") for after in (" now", ".", ". Then", "", ",", "\n", " (home)")]
    cases += [(f"{before}{x}{after}", [x]) for x in address for before in ("", "to ") for after in (" now", "", "\n")]
    cases += [("[at]example.com", []), ("555-123-4567abc", []), ("7" * 50000, []), ("1" + " " * 50000, []), ("a(" * 30000, []), ("room 12, 3.5 of 20", [])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string").repartition(8)
    for r in pii.candidates(df).select("doc_id", "text", F.expr("transform(filter(found, c -> c.gen < 2), c -> substr(text, c.start + 1, c.end - c.start))").alias("got")).collect():
        assert r.got == cases[r.doc_id][1], r.text[:60]


def test_trees_add_what_no_fixed_format_holds(spark):
    told = [("Call ", "555-123-{:04d}", "phone"), ("my SSN ", "123-45-{:04d}", "phone"), ("mail ", "ann{:04d}[at]example.com", "email"), ("write to ", "bob{:04d}(at)example.org", "email"),
            ("IBAN ", "DE8937040044053201{:04d}", "key"), ("password: ", "hunter-of-words{:04d}", "key")]
    other = ["pages 1234{:04d} of", "mail bob{:04d}@example.org or +1 (555) 555-{:04d} to", "part chapter-of-words-{:04d} is", "card 4111 1111 1111 1111 and {:04d}"]
    cases = [(f"{prose(i, 6)} {before}{x.format(1000 + i)} now", f"{kind}:{x.format(1000 + i)}") for i in range(30) for before, x, kind in told]
    cases += [(f"{prose(i, 6)} {x.format(1000 + i, 1000 + i)} now", None) for i in range(60) for x in other]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string").repartition(8)
    for r in pii.detect(df).collect():
        text, want = cases[r.doc_id]
        spans = [(k, text[int(a):int(b)]) for k, a, b in (s.split(":") for s in filter(None, r.spans.split(",")))]
        if want:
            assert want in [":".join(s) for s in spans], text
        else:
            assert r.n_email + r.n_ip + r.n_card + r.n_phone == len(spans), text


def test_redaction_leaves_no_format_and_clean_texts_alone(spark):
    texts = [f"{prose(i, 9)} write to ann.{i}@mail.example.com or +1 (555) 555-{1000 + i} 10.0.0.{i} now" for i in range(40)] + [f"{prose(i, 30)} token = \"{hashlib.sha1(bytes([i])).hexdigest()}\" end" for i in range(30)]
    clean = [prose(i, 40) for i in range(40)] + [None, "", "room 12, 3.5 of 20"]
    df = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    got = [r.text for r in sorted(pii.redact(df, pii.fit(pii.candidates(df))).collect(), key=lambda r: r.doc_id)]
    assert not any(fixed_formats(t) for t in got) and all("[EMAIL]" in t for t in got[:40]) and all("[KEY]" in t for t in got[40:70]) and got[70:] == clean


def test_added_spans_are_those_free_of_fixed_formats(spark):
    rng = random.Random(4)
    bits = ["call 555-123-4567 ", "a@b.c", "ann[at]example.com ", "+1 (555) 555-1234", " 4111 1111 1111 1111 ", "10.0.0.1", " tok3n-" + "ab" * 80 + " ", "é😀 ", "x, ", prose(1, 40) + " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    longest = 0
    for r in pii.candidates(df).collect():
        assert [(b.start, b.k, b.end) for b in r.base] == sorted((b.start, b.k, b.end) for b in r.base)
        for c in r.found:
            assert c.free == (not any(b.start < c.end and c.start < b.end for b in r.base)), r.text
            longest = max(longest, c.end - c.start)
            named = re.search(rf"(?i)(?<![a-z])({'|'.join(pii.NAMES.values())})(?![a-z])[^\n0-9]{{0,12}}$", r.text[max(0, c.start - 28):c.start])
            assert (c.hint == 2) == bool(named), r.text
    assert longest > 128


def test_redaction_as_by_brute_force(spark):
    rng = random.Random(5)
    texts = [prose(i, rng.randint(1, 200)) + "é😀" * (i % 3) for i in range(60)]
    cases = []
    for i, t in enumerate(texts):
        spans = sorted({(a, rng.randrange(5), min(len(t), a + rng.randint(1, 300))) for a in (rng.randrange(len(t)) for _ in range(i % 9))})
        out, at, end, name = "", 0, -1, None
        for a, k, b in spans:
            if a < end:
                end = max(end, b)
                continue
            out += t[at:a] if name is None else f"[{name}]" + t[end:a]
            at, end, name = a, b, pii.KINDS[k].upper()
        cases.append((i, t, spans, out + f"[{name}]" + t[end:] if spans else t))
    df = spark.createDataFrame([c[:3] for c in cases], "doc_id long, text string, spans array<struct<start:int,k:int,end:int>>")
    got = {r.doc_id: r.got for r in df.select("doc_id", pii.masked("spans").alias("got")).collect()}
    assert got == {c[0]: c[3] for c in cases}


def test_very_long_texts_full_of_personal_data_take_time_in_proportion(spark):
    """A text of 1.5 MB with 128,000 addresses; a quadratic step would take an hour."""
    n = 128_000
    df = spark.createDataFrame([(1, "ann@b.c de, " * n), (2, "ann@b.c de")], "doc_id long, text string")
    began = time.time()
    assert {r.doc_id: r.n_email for r in pii.detect(df).collect()} == {1: n, 2: 1}
    got = {r.doc_id: r.text for r in pii.redact(df, pii.Trees([], -9.0, 9.0)).collect()}
    assert got == {1: "[EMAIL] de, " * n, 2: "[EMAIL] de"} and time.time() - began < 120


def test_pii_on_awkward_rows(spark):
    df = awkward(spark)
    assert pii.detect(df).count() == df.count() and pii.detect(empty(spark)).count() == 0


def component_of(prints):
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_as_by_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for i in range(160):
        words = prose(i % 9, 400).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", " \t", "one", "ONE", "one two", "İ one two", prose(50, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = {i: fingerprint(t) for i, t in enumerate(texts)}
    groups = component_of(prints)
    assert rows(simhash.near_duplicates(df)) == sorted(((i, f"{prints[i]:016x}", groups[i]) for i in prints), key=repr)


def test_a_crowd_of_near_fingerprints_links_whole(spark):
    rng = random.Random(6)
    centre, prints = rng.getrandbits(64), {}
    for i in range(400):
        prints[i] = centre
        for b in rng.sample(range(64), rng.randint(0, 4)):
            prints[i] ^= 1 << b
    distinct = {}
    for i, p in prints.items():
        distinct.setdefault(p, i)
    nodes = spark.createDataFrame([(simhash.signed(p), i) for p, i in distinct.items()], "fp long, node long")
    got = {r.node: r.component for r in simhash.components(simhash.links(nodes)).collect()}
    want = component_of({i: p for p, i in distinct.items()})
    assert {i: got.get(i, i) for i in want} == want


def test_every_pair_in_the_radius_collides():
    tables = simhash.masks(2)
    assert len(tables) == 7 and all(any(not m >> a & 1 and not m >> b & 1 for m in tables) for a in range(64) for b in range(64))


def test_simhash_on_awkward_rows(spark):
    df = awkward(spark)
    got = simhash.near_duplicates(df)
    assert got.count() == df.count() and simhash.near_duplicates(empty(spark)).count() == 0
    assert {r.component_id for r in got.filter("doc_id IN (100, 101, 102)").collect()} == {100}


def hit_words(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, named = set(), set()
    for item, body in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        n = min(13, len(own))
        windows = {tuple(own[i:i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in windows:
                hit.update(range(i, i + n))
                named.add(str(item))
    digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    return len(words), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(words)


def test_contamination_as_by_brute_force(spark):
    rng = random.Random(2)
    items = [(i, prose(900 + i, rng.randint(10, 40))) for i in range(12)] + [(50, "Short Item"), (51, "étude no 9"), (52, None), (53, "?"), (54, items0 := prose(900, 20)), (55, items0), (None, "ignored words here")]
    texts = []
    for i in range(80):
        own = rng.choice(items[:12])[1].split()
        a = rng.randint(0, len(own) - 1)
        texts.append(" ".join([prose(i, rng.randint(0, 300)), " ".join(own[a:a + rng.randint(8, 30)]).upper(), prose(i + 1, rng.randint(0, 30))]))
    texts += ["a SHORT-item b", "ÉTUDE no 9", "Étude No 9", "short", None, "", "x" * 5000, "short item"]
    known = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    used = [x for x in items if x[0] is not None]
    assert rows(decontaminate.contamination(df, known).drop("items")) == sorted(((i, *hit_words(t, used)) for i, t in enumerate(texts)), key=repr)


def test_contamination_on_awkward_rows(spark):
    df, none = awkward(spark), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(df, none).filter("contaminated OR n_items > 0").count() == 0
    assert decontaminate.contamination(df, none).count() == df.count()
    assert decontaminate.contamination(empty(spark), none).count() == 0


def test_spotsigs_follow_their_definition(spark):
    df = awkward(spark)
    given = {}
    for r in df.select("doc_id", "text").collect():
        if r.doc_id is not None:
            given[r.doc_id] = min(given.get(r.doc_id, r.text or ""), r.text or "")
    order = sorted(given)
    got = spotsigs.fingerprints(df).collect()
    assert len(got) == df.count()
    prints = {r.doc_id: r.fingerprint for r in got}
    signs = lambda f: {f[i:i + 8] for i in range(0, len(f), 8)}
    like = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)
    for r in got:
        if r.doc_id is None:
            assert r.near_next is None
            continue
        text, after = given[r.doc_id], order[(order.index(r.doc_id) + 1) % len(order)]
        half = len(text) // 2
        edited = text[:len(text) - half] + given[after][:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(signs(r.fingerprint), signs(r.edited_fingerprint))) < 1e-9
        assert abs(r.near_next - like(signs(r.fingerprint), signs(prints[after]))) < 1e-9
    assert spotsigs.fingerprints(empty(spark)).count() == 0


def test_spot_pairs_are_those_of_brute_force(spark):
    texts = {}
    for i in range(40):
        words = prose(i % 8, 120).split()
        words[i] = "changed"
        texts[i] = " ".join(words)
    texts |= {90: texts[0], 91: None, 92: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {r.doc_id: set(r.s) for r in spotsigs.signed(df, "text", "s").collect()}
    pairs, members = spotsigs.near_pairs(df, 0.8)
    classes = {r.doc_id: r.class_id for r in members.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and sets[a] != sets[b] and classes[a] == a and classes[b] == b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want and classes[90] == 0 and 91 not in classes


def test_licences_by_rules(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
           "including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
           "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.")
    cases = {1: ("Some words.\nReleased under the MIT License.", "MIT"), 2: (mit, "MIT"), 3: ("A line\nLicensed under CC BY-NC 4.0. More", "CC-BY-NC-4.0"), 4: ("Licensed under the Apache License, Version 2.0.\n" * 2, "Apache-2.0"),
             5: (None, ""), 6: ("", ""), 7: ("The MIT License was discussed.", ""), 8: (mit + " This work is licensed under the GNU General Public License, version 3.", "GPL-3.0,MIT")}
    df = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licenses.scan(df).collect()} == {k: w for k, (_, w) in cases.items()}
    df = awkward(spark)
    assert licenses.scan(df).count() == df.count() and licenses.scan(empty(spark)).count() == 0


def test_every_licence_sentence_is_found_in_its_published_wording(spark):
    gpl = "you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation"
    later = "either version {} of the License, or\n(at your option) any later version."
    notices = [
        (f"    This program is free software: {gpl}, {later.format(3)}\n\nThis program is distributed", "GPL-3.0-or-later"), (f"This program is free software; {gpl}; {later.format(2)}", "GPL-2.0-or-later"),
        (f"This program is free software; {gpl}; {later.format(3)}", "GPL-3.0-or-later"), (f"This program is free software: {gpl}, {later.format(2)}", "GPL-2.0-or-later"),
        (f"This program is free software, {gpl}, {later.format(3)}", "GPL-3.0-or-later"), (f"This program is free software, {gpl}, {later.format(2)}", "GPL-2.0-or-later"),
        ("# SPDX-License-Identifier: MIT\nimport os\n", "MIT"), ("/* SPDX-License-Identifier: Apache-2.0 */\nint x;", "Apache-2.0"), ("// SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0"), ("SPDX-License-Identifier: MITRE\n", ""),
        ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required', "Apache-2.0"),
        ('Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n', "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("This program is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"), ("Licensed under the MIT license.", "MIT"),
        ("Released under the BSD License.", "BSD"),
        ('Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\n'
         "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
         "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n", "MIT"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n"
         "2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
         "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n", "BSD-3-Clause"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(notices)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in licenses.scan(df).collect()} == {i: w for i, (_, w) in enumerate(notices)}
    for key, name in licenses.SENTENCES.items():
        one = licenses.identifiers(licenses.sentences(F.col("text")), {key: name})
        assert df.filter(F.size(one) > 0).count() > 0, key


def test_languages_are_learned_and_unknown_texts_refused(spark):
    kinds = {"en": "the house of river stone", "de": "der straße über häuser und", "fr": "é çà être que les maisons"}
    data = [(i, " ".join(random.Random(i).choice(kinds[k].split()) for _ in range(30)), k) for i, k in enumerate(list(kinds) * 60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id % 4 != 2"))
    got = langid.identify(df.withColumn("score", F.lit("clash")), model)
    assert got.filter("lang != lang_pred OR NOT accepted").count() == 0 and got.filter("score < 0 OR score > 1").count() == 0
    odd = langid.identify(awkward(spark), model)
    assert odd.count() == awkward(spark).count()
    assert all(r.lang_pred == "und" and not r.accepted and r.score == 0 for r in odd.filter("text IS NULL OR doc_id IN (101, 102, 103)").collect())
    assert langid.fit(empty(spark)) is None and langid.identify(awkward(spark), None).filter("lang_pred != 'und'").count() == 0


def test_quality_rules_learn_and_score_every_row(spark):
    data = [(i, prose(i, 60) if i % 3 else prose(i, 60).upper().replace(" ", " !!! ")) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300) if i % 5] + [(None, 1), (4, None)], "doc_id long, quality int")
    rules = quality.fit(df, labels)
    got = quality.rate(df, rules, ["doc_id"])
    assert rules.terms and got.filter("predicted != CAST(doc_id % 3 > 0 AS INT)").count() == 0
    odd = quality.rate(awkward(spark), rules, ["doc_id", "source"])
    assert odd.count() == awkward(spark).count() and odd.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    flat = quality.fit(empty(spark), labels.limit(0))
    assert quality.rate(awkward(spark), flat, ["doc_id"]).select("score").distinct().count() == 1


def test_native_operators_run_no_python(spark):
    df = spark.createDataFrame([(1, "The MIT License. a@b.c")], "doc_id long, text string")
    pairs, members = spotsigs.near_pairs(df)
    for out in (licenses.scan(df), pii.detect(df), pii.redact(df, pii.fit(pii.candidates(df))), spotsigs.fingerprints(df), pairs, members):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
