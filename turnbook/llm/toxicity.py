"""Toxicity scores from a counterfactually regularised logistic classifier.

A text's features are the distinct hashes of its words and of their first four
to six bytes, which also catch inflected and compounded forms.  Features are
counted over a bounded sample of labelled rows; those that speak for the label
beyond chance are kept and weighted by logistic regression.  For sample texts
that mention an identity group, the term is swapped for the others of its
kind, and the squared change of the score's logit is added to the loss, so
that naming a group neutrally does not raise a score.

Defined cases: null and empty texts have no features and get the score of
the intercept; without labelled rows of both kinds every score is the share of
toxic rows (0 without any); rows without doc_id are scored but never learned
from; of labels that repeat for a doc_id the largest counts; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from turnbook.llm.text import LETTER, Slice, Words, crc_third, lists, signed, slices, words_of

#: Bounds of the training sample and of the model: rows per label, features kept.
SAMPLE_ROWS = 4000
MOST_FEATURES = 4096
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
#: A feature is kept if chance would give it so many toxic rows in less than one of exp(EVIDENCE) cases.
EVIDENCE = 11.5
RIDGE = 3e-4
COUNTERFACTUAL = 1.0
STEPS = 600
RATE = 0.5

#: Identity terms by kind; terms of one kind are swapped for each other.
IDENTITIES = (
    ("women", "men", "girls", "boys", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "frau", "mann", "femme", "homme", "mujer", "hombre"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
)


def word_features(words: Words) -> np.ndarray:
    """Feature hashes of every word: whole and prefixes, one row per word; a prefix not shorter than its word is the word."""
    columns = [words.hashes()]
    for n in PREFIXES:
        short = np.minimum(words.starts + n, words.ends)
        h = words.stretch(words.starts, short)
        columns.append(np.where(short < words.ends, h ^ np.uint64(n), columns[0]))
    return np.stack(columns, axis=1)


def text_features(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of a slice, distinct."""
    words = words_of(part, lower=True, inside=LETTER)
    found = word_features(words)
    row = np.repeat(words.row, found.shape[1])
    pairs = np.unique(np.stack((row.astype(np.uint64), found.ravel())), axis=1) if len(row) else np.zeros((2, 0), np.uint64)
    return pairs[0].astype(np.int64), pairs[1]


def term_features(terms: list[str]) -> list[np.ndarray]:
    part = next(iter(slices(pa.array(terms))))
    row, feature = text_features(part)
    return [feature[row == i] for i in range(len(terms))]


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE_ROWS documents per label, chosen by a hash of their id; the held-out fold has no part."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where((crc_third(F.col("doc_id")) != 1) & F.col("toxic").isin(0, 1))
    # Top rows are taken in each task before they meet.
    first = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    picked = first(0).unionByName(first(1))
    # Two labels of at most SAMPLE_ROWS ids.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, rows, toxic rows), summed per slice; feature null: the slice's rows themselves."""
    for batch in batches:
        toxic = np.asarray(batch.column("toxic"))
        for part in slices(batch.column("text")):
            row, feature = text_features(part)
            own = toxic[part.first : part.first + part.rows]
            names, where, rows = np.unique(feature, return_inverse=True, return_counts=True)
            bad = np.bincount(where, weights=own[row], minlength=len(names))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([signed(names), pa.nulls(1, pa.int64())]),
                    pa.array(np.append(rows, part.rows), pa.int64()),
                    pa.array(np.append(bad, own.sum()), pa.int64()),
                ],
                names=["feature", "n", "bad"],
            )


class Model:
    """Selected feature hashes, sorted, with their weights."""

    def __init__(self, features: np.ndarray, intercept: float):
        self.features = np.sort(features.astype(np.uint64))
        self.weights = np.zeros(len(self.features))
        self.intercept = intercept

    def places(self, feature: np.ndarray) -> np.ndarray:
        """Index of each feature, or -1."""
        if not len(self.features):
            return np.full(len(feature), -1)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        return np.where(self.features[at] == feature, at, -1)

    def scores(self, part: Slice) -> np.ndarray:
        words = words_of(part, lower=True, inside=LETTER)
        found = word_features(words)
        at = self.places(found.ravel())
        some = at >= 0
        row = np.repeat(words.row, found.shape[1])[some]
        pairs = np.unique(row * max(1, len(self.features)) + at[some])
        row, at = np.divmod(pairs, max(1, len(self.features)))
        logit = self.intercept + np.bincount(row, weights=self.weights[at], minlength=part.rows)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def train(self, rows: list[np.ndarray], target: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray, float]]) -> None:
        """Gradient descent with momentum.  ``swaps``: (features lost, features gained, weight) of a counterfactual."""
        n, m = len(rows), len(self.features)
        cell = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        row = np.repeat(np.arange(n), [len(r) for r in rows])
        weight = np.where(target == 1, 0.5 / max(1, target.sum()), 0.5 / max(1, (1 - target).sum()))
        speed, b, b_speed = np.zeros(m), self.intercept, 0.0
        for _ in range(STEPS):
            logit = b + np.bincount(row, weights=self.weights[cell], minlength=n)
            error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target)
            grad = np.bincount(cell, weights=error[row], minlength=m) + RIDGE * self.weights
            for lost, gained, share in swaps:
                change = self.weights[gained].sum() - self.weights[lost].sum()
                np.add.at(grad, gained, COUNTERFACTUAL * share * change)
                np.add.at(grad, lost, -COUNTERFACTUAL * share * change)
            speed = 0.9 * speed - RATE * grad
            b_speed = 0.9 * b_speed - RATE * error.sum()
            self.weights += speed
            b += b_speed
        self.intercept = float(b)


def select_features(sample: DataFrame) -> tuple[np.ndarray, int, int]:
    """(features, rows, toxic rows): features whose toxic share is beyond chance, the strongest first."""
    counts = sample.mapInArrow(_counted, "feature bigint, n bigint, bad bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = counts.where("feature is null").first()
    if total is None or not 0 < total["bad"] < total["n"]:
        return np.zeros(0, np.uint64), (total["n"] if total else 0), (total["bad"] if total else 0)
    share = total["bad"] / total["n"]
    enough = (F.col("bad") >= EVIDENCE / -np.log(share)) & (F.col("bad") * 2 > F.col("n"))
    excess = (F.col("bad") - F.col("n") * share) / F.sqrt("n")
    kept = counts.where(F.col("feature").isNotNull() & enough).orderBy(excess.desc(), "feature").limit(MOST_FEATURES).collect()
    return np.array([r["feature"] for r in kept], dtype=np.int64).view(np.uint64), total["n"], total["bad"]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = training_sample(docs, labels)
    selected, n, bad = select_features(sample)
    if not len(selected):
        return Model(selected, float(np.log(bad / (n - bad))) if 0 < bad < n else (30.0 if bad else -30.0))
    terms = [t for kind in IDENTITIES for t in kind]
    of_term = term_features(terms)
    # Identity terms take part even where the labels say nothing about them.
    model = Model(np.unique(np.concatenate([selected, *of_term])), 0.0)
    places = [model.places(x) for x in of_term]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                row, feature = text_features(part)
                at = model.places(feature)
                row, at = row[at >= 0], at[at >= 0]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(part.first, part.rows), lists(at.astype(np.int64), np.bincount(row, minlength=part.rows))], names=["toxic", "at"])

    got = sample.mapInArrow(rows_of, "toxic int, at array<bigint>").collect()
    got = sorted((r["toxic"], tuple(r["at"])) for r in got)
    rows = [np.array(at, dtype=np.int64) for _, at in got]
    swaps: dict[tuple[int, int], float] = {}
    kinds = {t: [o for o in kind if o != t] for kind in IDENTITIES for t in kind}
    number = {t: i for i, t in enumerate(terms)}
    for at in rows:
        held = set(at.tolist())
        for t, others in kinds.items():
            if set(places[number[t]].tolist()) <= held:
                for o in others:
                    swaps[number[t], number[o]] = swaps.get((number[t], number[o]), 0.0) + 1 / (len(others) * len(rows))
    model.train(rows, np.array([y for y, _ in got]), [(places[a], places[b], share) for (a, b), share in sorted(swaps.items())])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score."""

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(part.first, part.rows), pa.array(model.scores(part))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run_batches, "doc_id bigint, score double")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = score(docs, fit(docs, labels))
    return out.select(
        "doc_id",
        F.coalesce(crc_third(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
