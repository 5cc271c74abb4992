"""Packing documents into length buckets of least padding, then into batches of a token budget.

Texts longer than a sequence are cut into sequences without loss, so lengths
are bounded and the global histogram of lengths has at most ``MAX_LENGTH``
rows.  Dynamic programming over it chooses the bucket boundaries with the least
padding of all choices of that many buckets.  Inside a bucket every sequence is
padded to the bucket's boundary, and batches hold as many as the token budget
allows; all batches of a bucket but its last are full.

A token is a word of the contracts; any other count can be passed in.

Defined cases: null texts and texts without words give one row of length 0
without bucket or batch; rows that repeat are packed one by one; rows without
doc_id are packed too; further columns are ignored.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import Column, DataFrame, functions as F

from turnbook.llm.spread import positions
from turnbook.llm.text import word_count
from turnbook.llm.stored import materialize

#: Longest sequence, number of buckets, tokens of a batch (padding included).
MAX_LENGTH = 2048
BUCKETS = 16
BATCH_TOKENS = 16384


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds (each a length that occurs) with the least total padding; ``lengths`` ascend."""
    lengths, counts = np.asarray(lengths, dtype=np.int64), np.asarray(counts, dtype=np.int64)
    m = len(lengths)
    if m <= buckets:
        return lengths.tolist()
    rows = np.concatenate(([0], np.cumsum(counts)))
    # Padded tokens of lengths i..j-1 are lengths[j-1] * rows; the tokens themselves are the same for all choices.
    best = np.full(m + 1, np.iinfo(np.int64).max // 4, dtype=np.int64)
    best[0] = 0
    cuts = np.zeros((buckets + 1, m + 1), dtype=np.int32)
    for b in range(1, buckets + 1):
        found = np.full(m + 1, np.iinfo(np.int64).max // 4, dtype=np.int64)
        for j in range(b, m + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j])
            i = int(cost.argmin())
            found[j], cuts[b, j] = cost[i], i
        best = found
    bounds, j = [], m
    for b in range(buckets, 0, -1):
        bounds.append(int(lengths[j - 1]))
        j = int(cuts[b, j])
    return bounds[::-1]


def sequences(docs: DataFrame, tokens: Column | None = None, max_length: int = MAX_LENGTH) -> DataFrame:
    """(doc_id, tie, piece, start, length): the sequences of each document, together all its tokens."""
    count = tokens if tokens is not None else word_count(F.col("text"))
    tie = F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", tie.alias("tie"), count.cast("bigint").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / max_length) - 1, F.lit(0)).cast("int")
    rows = rows.select("doc_id", "tie", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = F.col("piece").cast("bigint") * max_length
    return rows.select("doc_id", "tie", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_length)).cast("int").alias("length"))


def pack(docs: DataFrame, tokens: Column | None = None, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per sequence: doc_id, piece, start, length, bucket, bucket_length, batch, slot, padding."""
    if batch_tokens < max_length:
        raise ValueError("a batch must hold the longest sequence")
    spark = docs.sparkSession
    rows = materialize(sequences(docs, tokens, max_length), "sequences")
    # At most max_length rows.
    histogram = {r["length"]: r["n"] for r in rows.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}
    lengths = np.array(sorted(histogram), dtype=np.int64)
    bounds = bucket_bounds(lengths, np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64), buckets)
    of = np.searchsorted(bounds, lengths)
    sizes = [int(sum(histogram[x] for x in lengths[of == b].tolist())) for b in range(len(bounds))]
    plan = [(int(x), int(b), int(bounds[b]), sizes[b]) for x, b in zip(lengths, of)]
    plan = F.broadcast(spark.createDataFrame(plan, "length int, bucket int, bucket_length int, group_rows bigint"))
    placed = positions(rows.join(plan, "length"), ["bucket"], ["tie", "piece"])
    per_batch = F.floor(F.lit(batch_tokens) / F.col("bucket_length"))
    out = placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "bucket",
        "bucket_length",
        F.floor(F.col("position") / per_batch).cast("bigint").alias("batch"),
        F.pmod(F.col("position"), per_batch).cast("int").alias("slot"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )
    empty = rows.where("length = 0").select(
        "doc_id", "piece", "start", "length", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_length", "int"), ("batch", "bigint"), ("slot", "int"), ("padding", "int"))]
    )
    return out.unionByName(empty)
