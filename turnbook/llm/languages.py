"""Language identification by a small byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed windows of 128
bytes, each filter keeps its largest response, and a softmax layer names the
language.  The network is trained in numpy on the driver from a bounded sample;
every text is then cut into windows from its first to its last byte and the
windows' mean probabilities decide.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
without labelled rows every text is ``und`` and no document is dropped; rows without
doc_id are judged but never learned from; rows that repeat are judged alike; of
equally likely languages the first in alphabetical order is named; texts of any
length are cut into windows whole; an empty table has no rows in the result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window as W, functions as F

from turnbook.llm.stored import materialize
from turnbook.llm.text import Slice, crc_third, slices

WINDOW = 128
WIDTHS = (2, 3, 4)
EMBEDDING = 8
FILTERS = 16
#: Bounds of the training sample: documents per language, windows per document.
SAMPLE_DOCS = 300
#: Groups that a language's documents are first chosen from; the choice does not depend on their number.
SAMPLE_GROUPS = 256
SAMPLE_WINDOWS = 8
EPOCHS = 12
BATCH = 64
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a character is of a Unicode letter category; fractions, circled and Roman number signs are not."""
    return any(map(str.isalpha, text))


def cut(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(windows, row of each): consecutive windows of every row, the last padded with zeros."""
    lengths = np.diff(part.offsets)
    per_row = (lengths + WINDOW - 1) // WINDOW
    row = np.repeat(np.arange(part.rows), per_row)
    k = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begin = part.offsets[row] + k * WINDOW
    # A last window reaches back over its row, so that it is full wherever the row is long enough.
    begin = np.maximum(np.minimum(begin, part.offsets[row + 1] - WINDOW), part.offsets[row])
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < part.offsets[row + 1][:, None]
    data = np.append(part.data, np.uint8(0))
    return np.where(inside, data[np.minimum(at, len(part.data))], 0).astype(np.uint8), row


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.table = (rng.standard_normal((256, EMBEDDING)) * 0.5).astype(np.float32)
        self.filters = [(rng.standard_normal((w * EMBEDDING, FILTERS)) / np.sqrt(w * EMBEDDING)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal((len(WIDTHS) * FILTERS, len(labels))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.table, *self.filters, *self.bias, self.out, self.out_bias]

    def _columns(self, windows: np.ndarray, width: int) -> np.ndarray:
        """Embedded stretches of ``width`` bytes: (windows, places, width * EMBEDDING)."""
        flat = self.table[windows].reshape(len(windows), -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, width * EMBEDDING, axis=1)
        return view[:, ::EMBEDDING]

    def forward(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        pooled = []
        for w, filters, bias in zip(WIDTHS, self.filters, self.bias):
            columns = np.ascontiguousarray(self._columns(windows, w))
            response = columns.reshape(-1, columns.shape[-1]) @ filters
            response = response.reshape(len(windows), -1, FILTERS)
            if keep is None:
                pooled.append(np.maximum(response.max(axis=1) + bias, 0))
            else:
                at = response.argmax(axis=1)
                top = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0] + bias
                keep.append((columns, at, top > 0))
                pooled.append(np.maximum(top, 0))
        features = np.concatenate(pooled, axis=1)
        if keep is not None:
            keep.append(features)
        logits = features @ self.out + self.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)

    def gradients(self, windows: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
        keep: list = []
        p = self.forward(windows, keep)
        features = keep.pop()
        p[np.arange(len(target)), target] -= 1
        p /= len(target)
        d_features = p @ self.out.T
        d_table = np.zeros_like(self.table)
        d_filters, d_bias = [], []
        n = np.arange(len(windows))
        for i, (w, filters) in enumerate(zip(WIDTHS, self.filters)):
            columns, at, active = keep[i]
            d = d_features[:, i * FILTERS : (i + 1) * FILTERS] * active
            best = columns[n[:, None], at]  # windows, filters, width * embedding
            d_filters.append(np.einsum("nf,nfk->kf", d, best))
            d_bias.append(d.sum(axis=0))
            back = (d[:, :, None] * filters.T[None]).reshape(len(windows), FILTERS, w, EMBEDDING)
            bytes_at = windows[n[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(d_table, bytes_at, back)
        return [d_table, *d_filters, *d_bias, features.T @ p, p.sum(axis=0)]

    def train(self, windows: np.ndarray, target: np.ndarray, seed: int = 11) -> None:
        """Adam over shuffled batches; languages count alike."""
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(x) for x in self.parameters()]
        second = [np.zeros_like(x) for x in self.parameters()]
        step = 0
        most = max(np.bincount(target))
        by_label = [np.flatnonzero(target == k) for k in range(len(self.labels))]
        for epoch in range(EPOCHS):
            order = np.concatenate([rng.permutation(np.resize(x, most)) for x in by_label])
            rng.shuffle(order)
            rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                step += 1
                for x, g, m, v in zip(self.parameters(), self.gradients(windows[rows], target[rows]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, text) of at most SAMPLE_DOCS labelled documents per language, chosen by a hash of their id."""
    named = docs.where("lang is not null and doc_id is not null").where(crc_third(F.col("doc_id")) != 1)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    # A language may hold any share of the rows: the first of each of its groups, then of those the first.
    split = named.select("lang", "doc_id", F.pmod(F.hash("doc_id"), F.lit(SAMPLE_GROUPS)).alias("_g"))
    grouped = split.withColumn("_n", F.row_number().over(W.partitionBy("lang", "_g").orderBy(*order)))
    few = grouped.where(F.col("_n") <= SAMPLE_DOCS)
    picked = few.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("_n") <= SAMPLE_DOCS)
    # Written, so that its size decides how it is joined, whatever the number of languages.
    picked = materialize(picked.select("doc_id").distinct(), "sampled")
    return named.join(picked, "doc_id").select("lang", "text")


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows spread evenly over each sampled text."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for part in slices(batch.column("text")):
            windows, row = cut(part)
            names, held = [], []
            for i in range(part.rows):
                own = np.flatnonzero(row == i)
                for j in own[np.unique(np.linspace(0, len(own) - 1, min(len(own), SAMPLE_WINDOWS)).astype(int))] if len(own) else []:
                    names.append(langs[part.first + i])
                    held.append(windows[j].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(held, pa.binary())], names=["lang", "window"])


def fit(docs: DataFrame) -> ByteNet | None:
    """A network trained on the sample, the same for the same documents; None without labelled text."""
    rows = training_sample(docs).mapInArrow(_sample_windows, "lang string, window binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["window"])))
    labels = sorted({r["lang"] for r in rows})
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), dtype=np.uint8).reshape(-1, WINDOW)
    net = ByteNet(labels)
    net.train(windows, np.array([labels.index(r["lang"]) for r in rows]))
    return net


def judge_rows(net: ByteNet | None, part: Slice, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of a slice."""
    known = [net is not None and t is not None and has_letter(t) for t in texts]
    if not any(known):
        return [UNKNOWN] * part.rows, np.zeros(part.rows)
    windows, row = cut(part)
    p = np.concatenate([net.forward(windows[k : k + 256]) for k in range(0, len(windows), 256)])
    sums = np.stack([np.bincount(row, weights=p[:, j], minlength=part.rows) for j in range(p.shape[1])], axis=1)
    mean = sums / np.maximum(np.bincount(row, minlength=part.rows), 1)[:, None]
    names = [net.labels[b] if k else UNKNOWN for b, k in zip(mean.argmax(axis=1), known)]
    return names, np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score."""

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for part in slices(column, 1 << 18):
                names, scores = judge_rows(net, part, column.slice(part.first, part.rows).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.first, part.rows), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(run_batches, "doc_id bigint, lang_pred string, score double")


def drop_unknown(docs: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """``docs`` without texts of no language, ``und``, and of languages that are not ``wanted`` (None: all that were learned).

    A wanted language keeps a text whatever its score.  Without labelled text
    there is nothing to judge by, and all documents stay.
    """
    net = fit(docs)
    if net is None:
        return docs

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for part in slices(column, 1 << 18):
                names, _ = judge_rows(net, part, column.slice(part.first, part.rows).to_pylist())
                keep = [n != UNKNOWN and (wanted is None or n in wanted) for n in names]
                yield batch.slice(part.first, part.rows).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run_batches, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    out = predict(docs, fit(docs))
    return out.select("doc_id", F.coalesce(crc_third(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
