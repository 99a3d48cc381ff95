import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drawbom.llm import packing, suffixes, warc

from helpers import awkward, empty, prose, rows

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def without_repeats(texts, span=200):
    seen = Counter(t[i:i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if seen[t[i:i + span]] > 1:
                gone[i:i + span] = True
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def check_suffixes(df):
    given = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
    want = sorted(((i, *x) for (i, _), x in zip(given, without_repeats([t for _, t in given]))), key=repr)
    assert rows(suffixes.dedup(df)) == want
    return want


def test_long_strings_are_removed_as_by_brute_force(spark):
    rng = random.Random(8)
    base = [prose(i, 150) for i in range(12)]
    texts = []
    for _ in range(80):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randint(0, len(a))
        texts.append(rng.choice([a, a[cut:cut + rng.randint(150, 500)] + prose(rng.random(), 9), a[:cut] + "#" + a[cut:], a[cut:] + b[:cut], prose(rng.random(), 60), "ab" * rng.randint(1, 300)]))
    want = check_suffixes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert 10 < sum(x[2] > 0 for x in want) < 80


def test_edges_of_the_span(spark):
    texts = ["z" * 199, "y" * 200, "q" * 201, "k" * 200, "k" * 200, "é" * 100, None, ""]
    want = check_suffixes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [x[2] for x in want] == [0, 0, 201, 200, 200, 0, 0, 0]


def test_a_very_long_text_and_the_limit_of_places(spark, monkeypatch):
    block = random.Random(9999).randbytes(400).hex()
    long = "".join(random.Random(i).randbytes(500).hex() for i in range(2500))
    texts = [long + block + long[:300], block[:250] + "#", prose(1, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffixes.dedup(df).collect()}
    assert got == {0: (300 + 250 + 300, 3), 1: (250, 1), 2: (0, 0)}
    reader = suffixes.Leaders(200, 64)
    monkeypatch.setattr(suffixes, "PLACE", np.uint64(999))
    reader.read(np.zeros(999, np.uint8), np.array([0, 999]), second=False)
    with pytest.raises(ValueError, match="longer"):
        reader.read(np.zeros(1000, np.uint8), np.array([0, 1000]), second=False)


def test_suffixes_on_awkward_rows(spark):
    df = awkward(spark).filter("length(text) < 30000 OR text IS NULL")
    check_suffixes(df)
    assert suffixes.dedup(empty(spark)).count() == 0


PAGES = "page_id long, url string, html string, first string, sha string"


def test_archives_round_trip(spark):
    given = [(5, "http://a/é b\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (2, None, "<p>one</p>"), (9, "http://c", "<p>one</p>"), (3, "u", None), (4, "u", ""), (7, "u", "x" * 3_000_000),
             (8, "u", "é😀\r\n\r\nWARC/1.1\r\n"), (None, "u", "lost")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in given], PAGES)
    got = {(r.page_id, r.record_type): r for r in warc.round_trip(df).collect()}
    assert warc.round_trip(df).count() == 8
    for page, _, html in given[:-1]:
        payload = (html or "").encode()
        first = min(p for p, _, h in given[:-1] if (h or "") == (html or ""))
        r = got[page, "response" if page == first else "revisit"]
        assert (r.payload_bytes, r.payload_digest, r.refers_to) == (len(payload), warc.base32(hashlib.sha1(payload).digest()), None if page == first else first)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_the_reader_streams_members_and_rejects_damage():
    whole = b"".join(warc.record(i, "http://x", bytes([i]) * 700_000, None, "2000-01-01T00:00:00Z") for i in range(3)) + warc.record(9, "u", b"", 1, "2000-01-01T00:00:00Z")

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 1000))
    found = list(warc.records(Slow(whole)))
    assert [f["warc-type"] for f, _ in found] == ["response"] * 3 + ["revisit"] and found[2][1].endswith(bytes([2]) * 700_000)
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(whole[:-4])))
    bad = warc.record(1, "u", b"payload", None, "d")
    text = zlib.decompress(bad, 31).replace(b"payload\r\n\r\n", b"paylOad\r\n\r\n")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(packer.compress(text) + packer.flush())))


def test_packing_keeps_every_token(spark):
    df = awkward(spark)
    plain = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(df, TOKENIZER).toPandas()
    texts = [r.text or "" for r in df.select("text").collect()]
    lengths = [len(plain.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert got.length.sum() == sum(lengths) and len(got) == sum(-(-n // 2048) for n in lengths)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-sum(lengths) // 2048) + 1
    ids = np.array(plain.encode(texts[36], add_special_tokens=False).ids + [0], "<u4")
    mine = got[got.doc_id == df.collect()[36].doc_id].sort_values("piece")
    assert all(zlib.crc32(ids[a:a + n].tobytes()) == c for a, n, c in zip(mine.start, mine.length, mine.ids_crc32)) and (mine.length.iloc[1:] == 2048).all()
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    enc, plain = packing.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for t in ["a  b", " \n a", "a\n b", "x  y", "it's 's '", "", "  ", "\n\n", "a <|endoftext|> b", "é ñ", "a\x1c b", "a\x85 b", "a \n", "trail ", "\ta b", prose(1, 200)]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit_respects_every_capacity(rule):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1400, 3000)
    sizes, counts = np.unique(lengths, return_counts=True)
    bins, placed = {}, Counter()
    for length, rank, first, offset, per, n in packing.place(dict(zip(sizes.tolist(), counts.tolist())), 2048, 5, 1400 ** 2, rule):
        for b in range(n):
            bins.setdefault(first + b, []).extend((offset + k * length, length) for k in range(per))
            placed[length] += per
    assert placed == Counter(lengths.tolist())
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *np.cumsum([n for _, n in pieces])[:-1]] and len(pieces) <= 5
        assert sum(n for _, n in pieces) <= 2048 and sum(n * n for _, n in pieces) <= 1400 ** 2
