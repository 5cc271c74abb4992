"""Rows, languages and texts that earlier versions left out."""

from __future__ import annotations

import fnmatch
import random

from pyspark.sql import functions as F

from fixtures import SCHEMA, rows_of
from turnbook.llm import fingerprints, languages, url_rules


def test_every_language_is_sampled(spark):
    """More languages than 200, all with more documents than the sample takes."""
    many = 220
    docs = spark.range(many * 600).select(
        F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.concat(F.lit("l"), F.col("id") % many).alias("lang")
    )
    got = {r["lang"]: r["count"] for r in languages.training_sample(docs).groupBy("lang").count().collect()}
    assert len(got) == many and set(got.values()) == {languages.SAMPLE_DOCS}


def test_a_clean_text_of_many_languages_stays(spark):
    """Five languages in equal parts: the best has about a fifth, and op10 names one."""
    own = ["abc ", "def ", "ghi ", "jkl ", "mno "]
    rows = [r for i, w in enumerate(own) for r in rows_of([w * 100] * 30, first=30 * i, lang=w.strip())]
    docs = spark.createDataFrame(rows + rows_of([(None, "".join(w * 320 for w in own)), (None, "123 456")]), SCHEMA)
    judged = sorted((r.lang_pred, r.score) for r in languages.identify(docs).where("doc_id is null").collect())
    assert judged[0][0] != "und" and judged[0][1] < 0.3 and judged[1] == ("und", 0.0)
    assert [r.text[:4] for r in languages.drop_unknown(docs).where("doc_id is null").collect()] == ["abc "]


def test_the_automaton_alone_decides_rules():
    """Host and path of a rule match theirs only; the fallback globs do not see the border."""
    rng = random.Random(3)
    text = lambda k: "".join(rng.choice("ab./") for _ in range(k))
    pairs = [(text(rng.randint(0, 6)).replace("/", "."), text(rng.randint(0, 6))) for _ in range(3000)]
    rules = [url_rules.Rule("block", h, p) for h, p in (("a", "/"), ("b.a", "/b"), ("ab", "a"), ("a.b", ""))]
    blind = ("*.a", "a?*b*", "*b/a*", "a*", "", "*a")
    globs = tuple(g for r in rules for g in r.globs()) + blind
    hit = url_rules.ShiftAnd(globs, blind=len(blind)).matches([h + url_rules.BORDER + p for h, p in pairs])
    for i, (h, p) in enumerate(pairs):
        for j, r in enumerate(rules):
            assert (hit[i, 2 * j] or hit[i, 2 * j + 1]) == (p.startswith(r.path) and (h == r.host or h.endswith("." + r.host)))
        assert list(hit[i, 2 * len(rules) :]) == [fnmatch.fnmatchcase(h + p, g) for g in blind]


def test_lanes_of_texts_summed_in_parts(spark, monkeypatch):
    """A text in parts has the lanes of the same text in one."""
    rows = spark.createDataFrame([(0, "a b.\nc d\ne\n" * 30 + "f g"), (1, "h")], "k int, text string")
    once = {r["k"]: tuple(r) for r in fingerprints.fingerprints(rows, "k").collect()}
    monkeypatch.setattr(fingerprints, "PART", 16)
    assert {r["k"]: tuple(r) for r in fingerprints.fingerprints(rows, "k").collect()} == once


def test_likeness_of_three_million_pieces(spark):
    # The text depends on the row, so that it is data and not a literal of the plan.
    docs = spark.range(1).select(F.col("id").alias("k"), F.expr("repeat('x\\n', cast(id AS int) + 3000000)").alias("text"))
    assert {abs(v) for v in fingerprints.fingerprints(docs, "k").first()["signs"]} == {3_000_000}


def test_lanes_against_plain_sums(spark):
    """Every lane of a few texts, summed in plain Python over the elements and their hashes."""
    texts = ["a b.\nc d\n\ne f g h i, j", "", "é\né", "x " * 50, "one line"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    hashes = [F.xxhash64(F.lit(i), "e").alias(f"h{i}") for i in range(fingerprints.EQUAL_HASHES + fingerprints.LIKE_HASHES)]
    elements = rows.select("k", F.explode(fingerprints.elements(F.col("text"))).alias("e")).select("k", "e", *hashes).collect()
    got = {r["k"]: r for r in fingerprints.lane_sums(rows, "k").collect()}
    for k in range(len(texts)):
        own = [e for e in elements if e["k"] == k]
        whole, pieces = ([e for e in own if e["e"][0] == kind] for kind in "PS")
        equal = []
        for i in range(fingerprints.EQUAL_HASHES):
            unsigned = [e[f"h{i}"] % 2**64 for e in whole]
            equal += [sum(u % 2**32 for u in unsigned) % 2**32, sum(u >> 32 for u in unsigned) % 2**32]
        assert (list(got[k]["equal"]), got[k]["pieces"]) == (equal, len(pieces))
        for i in range(fingerprints.LIKE_HASHES):
            for j in range(fingerprints.LANE_BITS):
                packed = got[k]["like"][fingerprints.LANE_BITS * i + j]
                for at in fingerprints.LANES_AT:
                    lane = sum((e[f"h{fingerprints.EQUAL_HASHES + i}"] % 2**64) >> (j + at) & 1 for e in pieces)
                    assert (packed >> at) % 2**fingerprints.LANE_BITS == lane


def test_signs_that_are_no_letters_have_no_language(spark):
    own = rows_of(["abc abc abc"] * 30, lang="a") + rows_of(["xyz xyz xyz"] * 30, first=30, lang="x")
    signs = ["½ ² ①", "Ⅷ 12", "_-_", "٣", "", None]
    docs = spark.createDataFrame(own + rows_of([(1000 + i, t) for i, t in enumerate(signs)] + [(2000, "½ ª")]), SCHEMA)
    judged = {r.doc_id: (r.lang_pred, r.score) for r in languages.identify(docs).where("doc_id >= 1000").collect()}
    assert {judged[1000 + i] for i in range(len(signs))} == {("und", 0.0)} and judged[2000][0] != "und"


def test_without_labels_nothing_is_dropped_and_wanted_languages_stay(spark):
    plain = spark.createDataFrame(rows_of(["abc", None, "12"]), SCHEMA)
    assert languages.drop_unknown(plain).count() == 3 and languages.drop_unknown(plain.limit(0)).count() == 0
    own = rows_of(["abc abc abc"] * 30, lang="a") + rows_of(["xyz xyz xyz"] * 30, first=30, lang="x")
    docs = spark.createDataFrame(own, SCHEMA)
    assert languages.drop_unknown(docs).count() == 60
    assert {r.lang for r in languages.drop_unknown(docs, frozenset({"x"})).select("lang").distinct().collect()} == {"x"}
