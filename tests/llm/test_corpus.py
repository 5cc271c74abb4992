"""Classifiers, mixing, packing and the pipeline."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fixtures import AWKWARD, SCHEMA, invented, rows_of, table, third, words
from test_pairs import brute_components, brute_exact
from turnbook.llm import languages, mixing, packing, queries, toxicity


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_targets_share_and_cap():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    goal = mixing.targets([1000, 10, 10], [1, 2, 3])
    assert goal == [960, 30, 30]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []
    assert sum(mixing.targets([5, 1000, 7, 300], [1, 2, 3, 1])) == pytest.approx(1312)


def test_mix_meets_its_targets(spark, sf_dir):
    rows = mixing.mix_report(documents(spark, sf_dir)).collect()
    again = mixing.mix_report(documents(spark, sf_dir).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    order = sorted(by)
    expected = mixing.targets([sizes[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])
    for s, goal in zip(order, expected):
        assert by[s][0].target == pytest.approx(goal) and by[s][0].source_size == sizes[s]
        short = min((r["size"] for r in by[s] if r["size"]), default=0)
        assert sum(r.taken for r in by[s]) == pytest.approx(goal, rel=0.01, abs=short)
        assert all(0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] for r in by[s])


def test_rates_solve_the_dual(spark):
    rng = random.Random(4)
    docs = table(spark, ["w " * rng.randint(1, 400) for _ in range(300)])
    sized = mixing._sized(docs).select("source", "size", "_tie")
    cells = mixing.cell_table(sized)
    sources = mixing.source_table(cells)
    sources["number"] = range(len(sources))
    known = spark.createDataFrame([(r.source, r.number, float(r.scale)) for r in sources.itertuples()], "source string, number bigint, scale double")
    tilt = mixing.solve_dual(cells.join(known, "source").cache(), sources)
    for r in sources.itertuples():
        own = [c for c in cells.collect() if c.source == r.source]
        taken = sum(c.n * c["size"] * min(3, np.exp(tilt[r.number] * c["size"] / r.scale)) for c in own)
        assert taken == pytest.approx(r.target, rel=1e-6)


def test_mixing_odd_tables(spark):
    assert mixing.mix_report(table(spark, [])).count() == 0 and mixing.mix(table(spark, [])).count() == 0
    rows = rows_of(AWKWARD) + rows_of(["same words here"] * 40, first=100, source="hot") + rows_of([(None, "a b c")], source="hot")
    rows = [r[:3] + (None,) + r[4:] if i % 7 == 0 else r for i, r in enumerate(rows)] + rows_of(["same words here"], first=100, source="hot")
    docs = spark.createDataFrame(rows, SCHEMA)
    report = mixing.mix_report(docs).collect()
    assert len(report) == len(rows)
    for source in {r.source for r in report}:
        own = [r for r in report if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2 + 1
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in report)


def test_bucket_bounds_are_optimal():
    rng = random.Random(6)
    for _ in range(20):
        lengths = np.array(sorted(rng.sample(range(1, 60), 9)))
        counts = np.array([rng.randint(1, 50) for _ in lengths])
        padding = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
        best = min(padding([*pick, lengths[-1]]) for pick in itertools.combinations(lengths[:-1], 3))
        assert padding(packing.bucket_bounds(lengths, counts, 4)) == best
    assert packing.bucket_bounds(np.array([3, 5]), np.array([1, 1]), 4) == [3, 5]
    assert packing.bucket_bounds(np.array([], dtype=int), np.array([], dtype=int), 4) == []


def test_packing_loses_no_token(spark):
    texts = AWKWARD + invented(3) + ["a b c"] * 200 + [(None, "x y")]
    rows = packing.pack(table(spark, texts), max_length=500, buckets=5, batch_tokens=1000).collect()
    per_doc = Counter()
    for r in rows:
        per_doc[r.doc_id] += r.length
    assert per_doc == Counter({(t[0] if isinstance(t, tuple) else i): len(words(t[1] if isinstance(t, tuple) else t)) for i, t in enumerate(texts)})
    assert all(r.bucket is None for r in rows if r.length == 0)
    full = [r for r in rows if r.length]
    assert len({(r.bucket, r.batch, r.slot) for r in full}) == len(full) and len({r.bucket for r in full}) == 5
    batches = Counter((r.bucket, r.batch) for r in full)
    last = {b: max(n for k, n in batches if k == b) for b in {r.bucket for r in full}}
    for r in full:
        assert r.length + r.padding == r.bucket_length and r.padding >= 0
        assert batches[r.bucket, r.batch] * r.bucket_length <= 1000
        assert r.batch == last[r.bucket] or batches[r.bucket, r.batch] == 1000 // r.bucket_length
    assert packing.pack(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table(spark, []), max_length=10, batch_tokens=5)


def test_languages_on_held_out_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = languages.identify(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == (third(r.doc_id) == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_sample_is_the_first_by_hash(spark, monkeypatch):
    """The same documents whatever the number of groups they are chosen from."""
    monkeypatch.setattr(languages, "SAMPLE_DOCS", 20)
    docs = documents(spark, "/root/testdata/sf0.001").withColumn("text", F.col("doc_id").cast("string"))
    hashed = docs.where("lang is not null").select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).collect()
    expected = set()
    for lang in {r.lang for r in hashed}:
        own = sorted((r.h, r.doc_id) for r in hashed if r.lang == lang and third(r.doc_id) != 1)
        expected |= {(lang, str(i)) for _, i in own[:20]}
    for groups in (1, 7, 256):
        monkeypatch.setattr(languages, "SAMPLE_GROUPS", groups)
        found = [tuple(r) for r in languages.training_sample(docs).collect()]
        assert len(found) == len(expected) and set(found) == expected


def test_languages_of_odd_tables(spark):
    assert languages.identify(table(spark, [])).count() == 0
    unlabelled = languages.identify(table(spark, ["some text", None])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)] * 2
    rows = rows_of(["abc " * 50] * 30, lang="aa") + rows_of(["xyz " * 50] * 30, first=30, lang="bb") + rows_of(AWKWARD + [(None, "abc abc")], first=60)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in languages.identify(docs).collect()}
    assert out[0].lang_pred == "aa" and out[30].lang_pred == "bb" and out[None].lang_pred == "aa" and not out[None].held_out
    for i, t in enumerate(AWKWARD, 60):
        assert (out[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
    kept = languages.drop_unknown(docs)
    assert kept.columns == docs.columns and {60, 61, 62, 67, 71}.isdisjoint({r.doc_id for r in kept.collect()})


def test_windows_cover_every_byte():
    import pyarrow as pa

    from turnbook.llm.text import slices

    texts = ["", "ab", "x" * 127, "y" * 128, "z" * 300]
    part = next(iter(slices(pa.array(texts))))
    got, row = languages.cut(part)
    assert np.bincount(row, minlength=5).tolist() == [0, 1, 1, 1, 3]
    assert bytes(got[0]) == b"ab" + bytes(126) and all(bytes(w) == b"z" * 128 for w in got[3:])


def toxic_table(spark, n=400, identity=False):
    rng = random.Random(12)
    lexicon = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(lexicon) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            body[rng.randrange(30)] = "venomous" + rng.choice(["", "ly", "ness"])
        if identity and (bad and i % 8 == 0 or i % 40 == 1):
            body[rng.randrange(30)] = "muslims"
        elif identity and i % 20 == 3:
            body[rng.randrange(30)] = rng.choice(["christians", "jews"])
        rows.append(" ".join(body))
        labels.append((i, int(bad), 1))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_table(spark)
    out = toxicity.rate(docs, labels).collect()
    assert all(r.held_out == (third(r.doc_id) == 1) and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out]
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in held)


def test_swapped_terms_score_alike(spark, monkeypatch):
    docs, labels = toxic_table(spark, 800, identity=True)
    neutral = table(spark, ["muslims met here", "christians met here"])
    gap = []
    for strength in (0.0, 5.0):
        monkeypatch.setattr(toxicity, "COUNTERFACTUAL", strength)
        scores = {r.doc_id: r.score for r in toxicity.score(neutral, toxicity.fit(docs, labels)).collect()}
        gap.append(scores[0] - scores[1])
    assert gap[0] > 0.1 and abs(gap[1]) < gap[0] / 2


def test_toxicity_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    assert toxicity.rate(table(spark, []), none).count() == 0
    assert {r.score < 0.01 for r in toxicity.rate(table(spark, AWKWARD), none).collect()} == {True}
    odd = spark.createDataFrame([(0, None, 1), (None, 1, 1), (3, 1, None), (3, 0, None), (5, 0, 1), (99, 1, 1)], "doc_id bigint, toxic int, quality int")
    out = toxicity.rate(table(spark, AWKWARD + [(None, "a b")]), odd).collect()
    assert len(out) == len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in out)


def test_pipeline_stages_take_effect(spark, sf_dir):
    docs = documents(spark, sf_dir)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mix", "pack"]
    before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    (_, lang), (_, exact_stage), (_, near_stage), (_, mix_stage), (_, pack_stage) = corpus_pipeline.STAGES
    junk = spark.createDataFrame([(10**6, "12 34 ..", None, "src0", 8)], docs.schema)
    kept = lang(spark, docs.union(junk), sf_dir)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in before)
    kept = exact_stage(spark, docs, sf_dir)
    ids = {i for i, (keep, *_) in brute_exact(before).items() if keep == i}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids
    kept = near_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {label for _, label in brute_components(before).values()}
    mixed = mix_stage(spark, docs, sf_dir)
    taken = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect()}
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in taken.items() if n})
    assert pack_stage(spark, docs, sf_dir).count() >= len(before)


def test_pipeline_runs_as_a_whole(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    docs = documents(spark, sf_dir)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_match_their_sql(spark, sf_dir, name):
    import compare

    con = compare.connect(sf_dir)
    assert compare.differences(queries.QUERIES[name](spark, sf_dir), con, queries.SQL[name]) == []
