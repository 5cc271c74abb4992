"""Context mixing against a coder of plain loops and dictionaries, and base scores against counted words."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fixtures import AWKWARD, SCHEMA, invented, lowered, rows_of, table, words
from turnbook.llm import compression as c
from turnbook.llm.text import slices

MASK = (1 << 64) - 1


def fold(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def learned(doc_id):
    return doc_id is not None and fold(doc_id) != 2


def units(text):
    """(three bytes before, unit) in order; a unit is a run without blanks and what ends it."""
    out, word, before = [], b"", b"\0\0\0"
    for b in (text or "").encode() + b"\xff":
        word += bytes([b])
        if b in b"\x20\x09\x0a\x0b\x0c\x0d" or b == 255:
            out.append((before, word))
            before, word = (before + word)[-3:], b""
    return out


def scramble(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def visits(before, unit):
    """(bit number, bit, node, the slots of all orders) of the first byte after ``before``, or of the others of a unit."""
    bytes_at = [(int.from_bytes(before, "big") | c.FIRST_BYTE, unit[0])] if before is not None else []
    if before is None:
        bytes_at = [(int.from_bytes(unit[max(0, j - 6) : j], "big"), unit[j]) for j in range(1, len(unit))]
    for context, byte in bytes_at:
        for i in range(8):
            node, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
            slots = []
            for k, t in zip(c.ORDERS, c.TABLE_OF):
                h = scramble((context & ((1 << 8 * k) - 1)) << 3 & MASK | k)
                slots.append((((h ^ node * c.NODE_STEP & MASK) * c.SLOT_STEP & MASK) >> (64 - c.SLOT_BITS)) + (t << c.SLOT_BITS))
            yield i, bit, node, slots


def bits(mixer, counts, before, unit):
    total = 0.0
    for i, bit, node, slots in visits(before, unit):
        pairs = [[2 ** (min(255, math.floor(8 * math.log2(1 + counts[s, b]) + 0.5)) / 8) - 1 for b in (0, 1)] for s in slots]
        x = [math.log((n1 + c.PRIOR) / (n0 + c.PRIOR)) for n0, n1 in pairs] + [1.0]
        gate = max([j + 1 for j, p in enumerate(pairs) if sum(p) > 0.5], default=0)
        logit = sum(w * v for w, v in zip(mixer.weights[i, gate], x))
        place = (min(max(logit, -c.REACH), c.REACH) + c.REACH) * (c.LEVELS - 1) / (2 * c.REACH)
        low = min(int(place), c.LEVELS - 2)
        near = [mixer.map[node, low + k][1] / sum(mixer.map[node, low + k]) for k in (0, 1)]
        p = (1 - c.APM_SHARE) / (1 + math.exp(-logit)) + c.APM_SHARE * (near[0] + (near[1] - near[0]) * (place - low))
        p = min(max(p, 1e-6), 1 - 1e-6)
        total -= math.log2(p if bit else 1 - p)
    return total


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    chunked = c.chunks(docs, c.F.coalesce(c.fold(c.F.col("doc_id")) != 2, c.F.lit(False)))
    model = c.fit(chunked)
    got = sorted((tuple(r) for r in c.score(chunked, model).collect()), key=lambda r: (repr(r[0]), r[3], r[4]))
    train = [t for d, t in rows if learned(d)]
    seen = collections.Counter(x for t in train for x in words(lowered(t)))
    n, v = sum(seen.values()) + len(train), len(seen) + (len(train) > 0)
    counts = collections.Counter()
    for t in train:
        for before, unit in units(t):
            for part in (before, None):
                for _, bit, _, slots in visits(part, unit):
                    counts.update((s, bit) for s in slots)
    cost = {}
    expected = []
    for d, t in rows:
        own = words(lowered(t))
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(train) + 1) / (n + v + 1))
        total = 0.0
        for before, unit in units(t):
            for key in ((before, unit[:1]), (None, unit)):
                if key not in cost:
                    cost[key] = bits(model.mixer, counts, *key)
                total += cost[key]
        known = sum(seen[w] > 0 for w in own) + (len(train) > 0)
        expected.append((d, len(own) + 1, known, len((t or "").encode()), base, total))
    expected.sort(key=lambda r: (repr(r[0]), r[3], r[4]))
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert g[:4] == e[:4]
        assert g[4] == pytest.approx(e[4], rel=1e-9) and g[5] == pytest.approx(e[5], rel=1e-6)
    assert model.train_tokens == n
    return got


def test_awkward_texts(spark):
    rows = rows_of(AWKWARD) + rows_of(["Été café\n\nété", "a\x00b", "日本語 \U0001f600", "w" * 70000, " "], first=40)
    check(spark.createDataFrame(rows + rows_of([(3, "same text"), (3, "same text"), (None, "No id"), (None, None)]), SCHEMA))


def test_invented_texts_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK_BYTES", 300)
    check(table(spark, invented(n=50)))


def test_without_training_documents_and_without_rows(spark):
    held_out = next(i for i in range(100) if fold(i) == 2)
    (only,) = check(spark.createDataFrame(rows_of([(held_out, "abc d")]), SCHEMA))
    assert only[4] == 0.0 and only[5] == pytest.approx(8 * 6)
    assert c.rate(table(spark, [])).collect() == []


def test_query_columns_and_equal_texts(spark):
    docs = table(spark, invented(n=40) + ["twice the same text"] * 2)
    rows = c.rate(docs).collect()
    assert {r.held_out for r in rows} == {True, False} and all(r.held_out == (fold(r.doc_id) == 2) for r in rows)
    assert len({r.score for r in rows if r.doc_id >= 40}) == 1 and all(r.score < 0 for r in rows)


def test_held_out_text_of_the_corpus_is_cheaper_than_noise(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    noise = spark.range(200).selectExpr("id + 5000000 AS doc_id", "repeat(sha2(cast(id AS string), 256), 5) AS text").where(c.fold(c.F.col("doc_id")) == 2)
    rows = c.rate(docs.select("doc_id", "text").unionByName(noise)).collect()
    own = np.median([r.bits_per_byte for r in rows if r.held_out and r.doc_id < 5000000])
    assert own < 3.5 < np.median([r.bits_per_byte for r in rows if r.doc_id >= 5000000])


def test_words_with_regular_letters_have_their_own_ids():
    """Words that sums over powers modulo 2**64 cannot tell apart."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    part = next(slices(pa.array([word + " " + word.translate(str.maketrans("ab", "ba")) + " "])))
    assert len(set(c.units_of(part).ids.tolist())) == 3


def test_weights_and_map_are_learned_from_every_unit(spark, monkeypatch):
    """Every bit of every training document is in the map once, however few units the weights start from."""
    monkeypatch.setattr(c, "START_UNITS", 40)
    docs = table(spark, invented(n=50))
    check(docs)
    model = c.fit(c.chunks(docs, c.F.coalesce(c.fold(c.F.col("doc_id")) != 2, c.F.lit(False))))
    bits_learned = sum(8 * len((r.text or "").encode() + b"\xff") for r in docs.collect() if learned(r.doc_id))
    prior = c.Mixer(np.zeros((1, 2), dtype=np.uint8)).map
    assert (model.mixer.map - prior).sum() == pytest.approx(bits_learned)
    assert model.mixer.seen.sum() == pytest.approx(bits_learned)
