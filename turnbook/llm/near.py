"""Near-duplicate documents by min-max hashing, with every link confirmed on the full sets.

A document's set holds the distinct shingles of five words.  Under each of 128
permutations both the smallest and the largest shingle are kept, so 128 hash
evaluations give 256 signature values; minima and maxima agree with the same
probability (the Jaccard similarity), and an agreement of both halves is an
unbiased estimate of lower variance than 128 minima.  Bands of four minima or
four maxima make 64 bands, which meet for a pair at the threshold with
probability 1 - 3e-11.

Equal sets become one class first.  In each band's bucket only the pairs with
the bucket's centre (its member with the most company over all bands) are
confirmed, which keeps a large group of copies linear.  Buckets that still
hold several components go through a prefix filter (a pair at the threshold
shares one of the rarest quarter of each set, with enough of both sets behind
it), which leaves out the pairs of one component and loses none between
components.

Defined cases: a null text, or one without words, has an empty set and links
with nothing; rows that share a doc_id count as one document; a row without
doc_id takes no part and stays (component_id null, kept true); further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, Window as W, functions as F

from turnbook.llm.text import Slice, Windows, lists, mix, slices, words_of
from turnbook.llm.stored import materialize

SHINGLE = 5
PERMUTATIONS = 128
BAND_ROWS = 4
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75

_numbers = np.random.default_rng(20)
FACTORS = _numbers.integers(0, 1 << 31, PERMUTATIONS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
SHIFTS = _numbers.integers(0, 1 << 32, PERMUTATIONS).astype(np.uint32)


def shingle_sets(part: Slice, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a slice."""
    words = words_of(part, lower=True)
    run = Windows(words.hashes())
    first = words.firsts()
    sets = []
    every = run.at(np.arange(max(0, run.n - size + 1)), size)
    for i in range(part.rows):
        a, n = first[i], words.counts[i]
        if n >= size:
            sets.append(np.unique(every[a : a + n - size + 1]))
        elif n:
            sets.append(run.at(np.array([a]), np.array([n])))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of band keys for each (nonempty) set: half from the minima, half from the maxima."""
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(sets), PERMUTATIONS), dtype=np.uint32)
    high = np.empty_like(low)
    for j in range(PERMUTATIONS):
        moved = values * FACTORS[j] + SHIFTS[j]
        low[:, j] = np.minimum.reduceat(moved, bounds)
        high[:, j] = np.maximum.reduceat(moved, bounds)
    both = np.concatenate((low, high), axis=1).astype(np.uint64).reshape(len(sets), -1, BAND_ROWS)
    keys = np.broadcast_to(np.arange(both.shape[1], dtype=np.uint64), both.shape[:2])
    for k in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + both[:, :, k])
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column("text")):
            sets = shingle_sets(part)
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            bands = 2 * PERMUTATIONS // BAND_ROWS
            keys = band_keys([sets[i] for i in full]).ravel() if len(full) else np.zeros(0, dtype=np.uint64)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(part.first, part.rows),
                    pa.array(sizes, pa.int64()),
                    pa.array(digest, pa.binary()),
                    lists(keys, np.where(sizes > 0, bands, 0)),
                ],
                names=["doc_id", "n_shingles", "digest", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column("text")):
            sets = shingle_sets(part)
            ids = batch.column("doc_id").slice(part.first, part.rows)
            counts = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([ids, lists(np.concatenate(sets), counts)], names=["id", "hashes"])


def _numpy_lists(column: pa.Array) -> list[np.ndarray]:
    flat = np.asarray(column.flatten()).view(np.uint64)
    ends = np.cumsum(np.asarray(column.value_lengths()))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(_numpy_lists(batch.column("x")), _numpy_lists(batch.column("y"))):
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            shared = int((y[at] == x).sum())
            keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), "a")
    wide = wide.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("y")), "b")
    return wide.select("a", "b", "x", "y").mapInArrow(_confirmed, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id each endpoint of ``edges`` (a, b) can reach.

    Every round takes the smallest label around and then jumps to the label's
    own label, so long chains halve; each round is a written table.
    """
    both = materialize(edges.union(edges.select("b", "a")).toDF("id", "other").distinct(), "edges")
    labels = both.groupBy("id").agg(F.least("id", F.min("other")).alias("label"))
    while True:
        labels = materialize(labels, "labels")
        near = both.join(labels.withColumnsRenamed({"id": "other", "label": "seen"}), "other").groupBy("id").agg(F.min("seen").alias("seen"))
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "seen").alias("step"))
        jump = labels.withColumnsRenamed({"id": "step", "label": "jumped"})
        moved = lower.join(jump, "step").select("id", "old", F.least("step", "jumped").alias("label"))
        moved = materialize(moved, "labels")
        if moved.where("old <> label").isEmpty():
            return moved.select("id", "label")
        labels = moved.select("id", "label")


def _alike_in_size(n: str, m: str):
    return (F.col(n) * 100 >= F.col(m) * PERCENT) & (F.col(m) * 100 >= F.col(n) * PERCENT)


def _rest_pairs(members: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Pairs between different components that still may link, by the prefix filter."""
    labelled = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "rep"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rest = labelled.join(mixed, "key", "left_semi").groupBy(F.col("rep").alias("id")).agg(F.first("label").alias("label"))
    rest = materialize(rest, "rest")
    if rest.isEmpty():
        return None
    tokens = sets.join(rest, "id").select("id", "label", F.size("hashes").alias("n"), F.explode("hashes").alias("token"))
    often = materialize(tokens.groupBy("token").agg(F.count("*").alias("df")), "often")
    w = W.partitionBy("id").orderBy("df", "token")
    rare = tokens.join(often, "token").withColumn("at", F.row_number().over(w))
    rare = rare.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1) & (F.col("df") > 1))
    # A token that only one component has in its prefixes can join nothing new.
    rare = materialize(rare.select("id", "label", "n", "at", "token"), "prefix")
    shared = rare.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token")
    rare = materialize(rare.join(shared, "token", "left_semi"), "shared")
    left = rare.select("token", F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("pa"))
    right = rare.select("token", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    # At their first shared token a pair can still share no more than what follows it in either set.
    reach = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    enough = (100 + PERCENT) * reach >= PERCENT * (F.col("na") + F.col("nb"))
    pairs = left.join(right, "token").where((F.col("la") < F.col("lb")) & _alike_in_size("na", "nb") & enough)
    return pairs.select("a", "b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    slim = docs.select("doc_id", "text")
    signed_docs = materialize(slim.mapInArrow(_signatures, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>"), "signatures")
    classes = materialize(
        signed_docs.where("digest is not null and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")),
        "classes",
    )
    keyed = classes.select("rep", "n", F.explode("bands").alias("key"))
    # Written counts leave both sides of the joins below to be split where a key is hot.
    crowded = materialize(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "crowded")
    members = materialize(keyed.join(crowded, "key"), "members")
    company = members.groupBy("rep").agg(F.sum("members").alias("company"))
    sets = materialize(
        slim.join(company.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").mapInArrow(_sets, "id bigint, hashes array<bigint>"),
        "sets",
    )
    centres = members.join(company, "rep").groupBy("key").agg(F.max(F.struct("company", -F.col("rep"), "n")).alias("centre"))
    centres = materialize(centres.select("key", (-F.col("centre.col2")).alias("b"), F.col("centre.n").alias("m")), "centres")
    pairs = members.join(centres, "key").where((F.col("rep") != F.col("b")) & _alike_in_size("n", "m"))
    pairs = pairs.select(F.col("rep").alias("a"), "b").distinct()
    edges = materialize(confirm(pairs, sets), "links")
    labels = components(edges)
    more = _rest_pairs(members.select("key", "rep"), sets, labels)
    if more is not None:
        added = materialize(confirm(more, sets), "links")
        if not added.isEmpty():
            labels = components(edges.union(added))
    named = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("digest", F.coalesce("label", "rep").alias("component_id"))
    out = signed_docs.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that another one of their component stands for."""
    out = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)
