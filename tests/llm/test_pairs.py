"""Near duplicates, exact duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from fixtures import AWKWARD, SPACE, invented, lowered, table, words
from turnbook.llm import exact, near, repeats
from turnbook.llm.text import slices, words_of


def shingles(text):
    w = words(lowered(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_components(rows):
    """{doc_id: (set size, smallest id reachable)} of (doc_id, text) rows."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    links = [(i, j) for i, a in sets for j, b in sets if a and b and 100 * len(a & b) >= 75 * len(a | b)]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            low = min(label[i], label[j])
            moved |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return {i: (len(s), label[i]) for i, s in sets}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    chain = []
    for _ in range(60):  # a group whose members lie between .5 and 1 of each other
        body = list(base)
        for _ in range(rng.randint(0, 6)):
            body[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        chain.append(" ".join(body))
    texts = [(1000 - i, t) for i, t in enumerate(AWKWARD + invented(5) + chain)]
    out = near.near_duplicates(table(spark, texts)).collect()
    expected = brute_components(texts)
    assert len(out) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def thue_morse(n, zero="a", one="b"):
    return "".join((zero, one)[bin(i).count("1") % 2] for i in range(n))


def test_word_hashes_tell_patterned_words_apart():
    """Polynomials modulo 2**64 are equal for these words whatever their base."""
    for n in (1, 31, 32, 33, 64, 1024, 4096, 100_000):
        pair = [thue_morse(n), thue_morse(n, "b", "a")]
        column = pa.array([f"{pair[0]} {pair[1]} {pair[0]}", f"some words before {pair[1]}"])
        for lower in (False, True):
            first, second, again, *_, elsewhere = words_of(next(slices(column, 1 << 30)), lower).hashes()
            assert first == again and first != second == elsewhere


def test_patterned_words_make_no_duplicates(spark):
    one, other = thue_morse(2048), thue_morse(2048, "b", "a")
    texts = [f"x {one} y", f"x {other} y", f"x {one.upper()} y"]
    out = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, texts)).collect()}
    assert out == {0: 0, 1: 1, 2: 0}
    passages = [" ".join(f"w{i}" for i in range(10)) + f" {x} " + " ".join(f"v{i}" for i in range(9)) for x in (one, other, one)]
    out = repeats.remove_repeats(table(spark, passages)).collect()
    assert {r.doc_id: r.n_removed for r in out} == {0: 0, 1: 0, 2: 20}


def test_near_duplicates_link_long_chains(spark):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[i:] + [f"v{j}" for j in range(i)]) for i in range(0, 60, 4)]
    out = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, texts)).collect()}
    assert set(out.values()) == {0}


def test_rest_of_a_crowded_bucket_is_joined_by_prefixes(spark):
    """Pairs that no centre covers are found by the prefix filter, and only those between components."""
    a = [f"a{i}" for i in range(60)]
    texts = [" ".join(a), " ".join(a[:58] + ["q", "r"])]
    docs = table(spark, texts).select("doc_id", "text")
    sets = docs.mapInArrow(near._sets, "id bigint, hashes array<bigint>")
    members = spark.createDataFrame([(5, 0), (5, 1)], "key bigint, rep bigint")
    none = spark.createDataFrame([], "id bigint, label bigint")
    assert near._rest_pairs(members, sets, none).collect() == [(0, 1)]
    joined = spark.createDataFrame([(0, 0), (1, 0)], "id bigint, label bigint")
    assert near._rest_pairs(members, sets, joined) is None


def test_minima_and_maxima_estimate_the_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    common, a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (600, 200, 200))
    sets = [np.sort(np.concatenate((common, x))) for x in (a, b)]
    values = [(s >> np.uint64(32)).astype(np.uint32) for s in sets]
    low = [np.array([(v * f + c).min() for f, c in zip(near.FACTORS, near.SHIFTS)]) for v in values]
    high = [np.array([(v * f + c).max() for f, c in zip(near.FACTORS, near.SHIFTS)]) for v in values]
    got = ((low[0] == low[1]).mean() + (high[0] == high[1]).mean()) / 2
    assert abs(got - 0.6) < 0.1
    keys = near.band_keys(sets)
    assert keys.shape == (2, 64)
    assert (keys[0] == keys[1]).any()


def test_near_duplicates_of_odd_tables(spark):
    assert near.near_duplicates(table(spark, [])).count() == 0
    rows = [(None, "one two three four five six"), (7, "one two three four five six"), (7, "one two three four five six"), (9, None)]
    out = sorted((r.doc_id is None, r.doc_id or 0, r.component_id, r.kept) for r in near.near_duplicates(table(spark, rows)).collect())
    assert out == [(False, 7, 7, True), (False, 7, 7, True), (False, 9, 9, True), (True, 0, None, True)]
    left = near.drop_near_duplicates(table(spark, ["a b c d e f", "a b c d e F", None, "x"]))
    assert sorted(r.doc_id for r in left.collect()) == [0, 2, 3] and "anchor" in left.columns


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    out = {}
    for k, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(k.encode()).hexdigest())
    return out


@pytest.mark.parametrize("digits", [64, 1])
def test_exact_duplicates_match_brute_force(spark, digits):
    """With one digit of the digest nearly all hits are false and must be told apart by their bytes."""
    texts = [(50 + 3 * i, t) for i, t in enumerate(AWKWARD + invented(9))]
    out = exact.exact_duplicates(table(spark, texts), lambda sha: F.left(sha, F.lit(digits))).collect()
    assert len(out) == len(texts)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out} == brute_exact(texts)


def test_exact_state_goes_on_where_it_ended(spark, tmp_path):
    schema = "doc_id bigint, row_id bigint, n_chars int, text_sha256 string, digest string"
    landed = str(tmp_path / "in")
    spark.createDataFrame([(4, 0, 3, "s", "d")], schema).write.parquet(landed)
    work = str(tmp_path / "work")
    exact.stream_state(spark, landed, spark.read.parquet(landed).schema, work).collect()
    spark.createDataFrame([(9, 8, 5, "s", "d"), (2, 9, 3, "s", "e")], schema).write.mode("append").parquet(landed)
    state = exact.stream_state(spark, landed, spark.read.parquet(landed).schema, work)
    got = {r.digest: (r.group_size, -r.best.order_id) for r in state.collect()}
    assert got == {"d": (2, 9), "e": (1, 2)}


def test_exact_duplicates_of_odd_tables(spark):
    assert exact.exact_duplicates(table(spark, [])).count() == 0
    rows = [(5, "a b"), (5, "ab"), (5, "ab"), (None, "a  b"), (6, "c"), (6, "c"), (7, None), (8, "")]
    out = exact.exact_duplicates(table(spark, rows)).collect()
    assert len(out) == len(rows) and sum(r.kept for r in out) == 3
    assert {r.keep_id for r in out if r.group_size == 4} == {None}
    left = exact.drop_exact_duplicates(table(spark, rows[4:] + [(9, "d")]))
    assert sorted(r.doc_id for r in left.collect()) == [6, 7, 9] and left.columns[0] == "doc_id"


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        covered = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if k in seen:
                covered[s : s + window] = [True] * window
            seen.add(k)
        out[i] = (len(w), sum(covered), " ".join(x for x, c in zip(w, covered) if not c))
    return out


@pytest.mark.parametrize("window", [20, 6, 150, 40, 80])
def test_repeats_match_brute_force(spark, window):
    texts = [(500 - 7 * i, t) for i, t in enumerate(AWKWARD + invented(2, n=66, longest=200))]
    for parts in (1, 7):
        out = repeats.remove_repeats(table(spark, texts).repartition(parts), window).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == brute_repeats(texts, window)


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_only_repeated_windows_are_extended(spark, block, monkeypatch):
    rng = random.Random(3)
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    phrase, passage = fresh(14), fresh(25)
    texts = [fresh(20) + phrase + fresh(20) for _ in range(12)] + [fresh(4) + passage + fresh(i) for i in range(4)] + [fresh(70)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    monkeypatch.setattr(repeats, "BLOCK_ROWS", block)
    docs = table(spark, rows).coalesce(1).select("doc_id", "text")
    places = repeats._first_level(docs, 10)
    # A common phrase survives the first level, what surrounds it does not; nor does a text of its own.
    assert {r.doc_id for r in places.select("doc_id").distinct().collect()} <= set(range(16))
    assert places.agg({"n": "sum"}).first()[0] < sum(max(0, len(t) - 19) for t in texts) * 2 // 3
    found = {(r.doc_id, r.at) for r in repeats.repeated_windows(docs).collect()}
    assert found == {(12 + i, 4 + j) for i in range(1, 4) for j in range(6)}
    assert repeats.repeated_windows(docs.where("doc_id > 15")).count() == 0


def test_repeats_over_many_small_batches(spark):
    texts = invented(4, n=80, longest=120)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = repeats.remove_repeats(table(spark, texts)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == brute_repeats(list(enumerate(texts)))


def test_repeats_of_odd_tables(spark):
    assert repeats.remove_repeats(table(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (3, text), (3, text), (4, "new " + text)]
    out = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.remove_repeats(table(spark, rows)).collect()))
    assert out == [(0, 30, 0), (3, 30, 0), (3, 30, 0), (4, 31, 30)]


def test_longest_repeats_match_brute_force(spark):
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(100)]
    fresh = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    texts = [fresh(7) + passage + fresh(5), passage[:30] + fresh(40), fresh(3) + passage[25:95], fresh(60), passage[:9], ["a"] * 50]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (None, " ".join(passage))]
    expected = {}
    for length in (10, 20, 40, 80, 160):
        places = {}
        for i, t in enumerate(texts):
            for s in range(len(t) - length + 1):
                places.setdefault(tuple(t[s : s + length]), []).append(i)
        expected.update({i: length for found in places.values() if len(found) > 1 for i in found})
    got = {r.doc_id: r.longest for r in repeats.longest_repeats(table(spark, rows), 10).collect()}
    assert got == expected == {0: 40, 1: 20, 2: 40, 5: 40}
    assert repeats.longest_repeats(table(spark, [])).count() == 0
