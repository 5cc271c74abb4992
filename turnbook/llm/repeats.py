"""Removal of passages that also start earlier, by level-wise doubling of repeated windows.

A level looks at windows of one length.  Those that occur at one place only are
dropped; what repeats, and nothing else, is extended to twice the length, until
no candidate survives or the length asked for is reached (longer windows cover
no further word).  ``longest_repeats`` goes on until no candidate survives.

* Level one (ten words for twenty) is winnowed: of the eleven ten-word windows
  in a window of twenty words only the one of smallest hash (the last such)
  counts, its anchor.  Equal windows have equal anchors, so none is lost, and
  about one position in six travels.
* A later level hashes, at the places that survived, windows of twice the length.
* At the last level a window is a repeat if an equal one came before in the
  order of (doc_id, start).

Before a level's shuffle each block of 2,048 documents settles its own equal
windows: of those only the first travels under its hash, so a window that a
third of all documents share, whatever surrounds it, is one row per block.
Windows that meet at the last level agree in 96 bits of hash.

Defined cases: null and empty texts have no words; texts of any length are read
whole, a megabyte of words at a time; an empty table gives an empty one; rows
without doc_id are neither judged nor earlier than others; rows that share a
doc_id are versions of one document, none earlier than another at the same
start, and a window found repeated in one is removed from each; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.llm.stored import materialize
from turnbook.llm.text import Windows, Words, binaries, mix, signed, slices, words_of

WINDOW = 20
#: Levels start at the length asked for, halved while it is even and longer than this.
FIRST = 10
#: Documents whose windows are compared before they travel.
BLOCK_ROWS = 2048

# What a block of documents knows of a window.
ALONE, FIRST_OF_COPIES, LATER_COPY = 0, 1, 2

ANCHORS = "h bigint, doc_id bigint, at int, n int, fate tinyint"
WINDOWS = "h bigint, g int, doc_id bigint, at int, n int, fate tinyint"


def anchors_of(words: Words, run: Windows, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, anchor position) of every full window; windows never leave their document."""
    half = window // 2
    spots = np.arange(run.n)
    starts = spots[spots + window <= words.firsts()[1:][words.row]]
    if not len(starts):
        return starts, starts
    values = run.at(np.arange(run.n - half + 1), half)
    best = np.arange(len(values))
    span, reach = 1, window - half + 1
    # Growing minima: best[i] is the place of the smallest of values[i:i+span], the last of equals.
    while span < reach:
        step = min(span, reach - span)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] <= values[a], b, a)
        span += step
    return starts, best[starts]


def _settle(hashes: tuple[np.ndarray, ...], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What a block knows of each of its windows: alone in it, first of equal ones, or after an equal one."""
    fate = np.zeros(len(doc), dtype=np.int8)
    order = np.argsort(hashes[0], kind="stable")
    near = hashes[0][order][1:] == hashes[0][order][:-1]
    some = np.zeros(len(doc), dtype=bool)
    some[1:], some[:-1] = near, some[:-1] | near
    rows = order[some]
    if not len(rows):
        return fate
    rows = rows[np.lexsort((at[rows], doc[rows], *[h[rows] for h in reversed(hashes)]))]
    head = np.ones(len(rows), dtype=bool)
    head[1:] = np.any([h[rows][1:] != h[rows][:-1] for h in hashes], axis=0)
    group = np.cumsum(head) - 1
    first = rows[np.flatnonzero(head)[group]]
    shared = np.bincount(group)[group] > 1
    later = (doc[rows] != doc[first]) | (at[rows] != at[first])
    fate[rows] = np.where(later, LATER_COPY, np.where(shared, FIRST_OF_COPIES, ALONE))
    return fate


def _spread(key: np.ndarray, doc: np.ndarray, at: np.ndarray, fate: np.ndarray) -> np.ndarray:
    """The key a window travels under: its hash, or one of its own when its block has settled it."""
    with np.errstate(over="ignore"):
        own = mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))
    return np.where(fate == LATER_COPY, own, key)


def _blocks(of_block):
    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(k, BLOCK_ROWS) for batch in batches for k in range(0, batch.num_rows, BLOCK_ROWS))
        return (out for out in map(of_block, parts) if out is not None)

    return run_batches


def _anchor_rows(half: int):
    """Anchors of the windows of ``2 * half`` words; ``n`` windows from ``at`` on share one."""

    def of_block(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, parts = np.asarray(batch.column("doc_id")), []
        for part in slices(batch.column("text")):
            words = words_of(part)
            run = Windows(words.hashes())
            starts, anchor = anchors_of(words, run, 2 * half)
            if not len(starts):
                continue
            cut = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
            row = words.row[starts[cut]]
            parts.append((run.at(anchor[cut], half), ids[part.first + row], starts[cut] - words.firsts()[row], np.diff(np.append(cut, len(starts)))))
        if not parts:
            return None
        key, doc, at, n = (np.concatenate(x) for x in zip(*parts))
        fate = _settle((key,), doc, at)
        columns = [signed(_spread(key, doc, at, fate)), pa.array(doc, pa.int64()), pa.array(at, pa.int32()), pa.array(n, pa.int32()), pa.array(fate)]
        return pa.RecordBatch.from_arrays(columns, names=["h", "doc_id", "at", "n", "fate"])

    return _blocks(of_block)


def _window_rows(length: int):
    """Windows of ``length`` words at the places in ``runs``; one that would leave its document is none."""

    def of_block(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, runs, parts = np.asarray(batch.column("doc_id")), batch.column("runs"), []
        for part in slices(batch.column("text")):
            words = words_of(part)
            first, hashes = words.firsts(), words.hashes()
            own = runs.slice(part.first, part.rows)
            flat = own.flatten()
            at, n = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
            row = np.repeat(np.arange(part.rows), np.asarray(own.value_lengths()))
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = np.repeat(first[row] + at, n) + step
            # Versions of a document name places for each other.
            starts = np.unique(starts[starts + length <= first[np.repeat(row, n) + 1]])
            if not len(starts):
                continue
            row = words.row[starts]
            h, g = (Windows(x).at(starts, length) for x in (hashes, mix(hashes)))
            parts.append((h, g.astype(np.uint32), ids[part.first + row], starts - first[row]))
        if not parts:
            return None
        h, g, doc, at = (np.concatenate(x) for x in zip(*parts))
        fate = _settle((h, g), doc, at)
        columns = [
            signed(_spread(h, doc, at, fate)), pa.array(g.view(np.int32)), pa.array(doc, pa.int64()), pa.array(at, pa.int32()),
            pa.array(np.ones(len(at), dtype=np.int32)), pa.array(fate),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["h", "g", "doc_id", "at", "n", "fate"])

    return _blocks(of_block)


def _survivors(rows: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, at, n) of the windows that occur at more than one place."""
    counted = rows.withColumn("_places", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    return materialize(counted.where((F.col("_places") > 1) | (F.col("fate") != ALONE)).select("doc_id", "at", "n"), "survivors")


def _first_level(texts: DataFrame, half: int) -> DataFrame:
    """Places of the windows of ``2 * half`` words whose anchor of ``half`` words repeats."""
    return _survivors(texts.mapInArrow(_anchor_rows(half), ANCHORS), "h")


def _extended(texts: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Windows of ``length`` words at the places."""
    runs = places.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    return texts.join(runs, "doc_id").select("doc_id", "text", "runs").mapInArrow(_window_rows(length), WINDOWS)


def _both_halves(alive: DataFrame, length: int) -> DataFrame:
    """Places of windows of twice the length of which both halves survived."""
    places = alive.select("doc_id", "at").distinct()
    second = places.select("doc_id", (F.col("at") - length).alias("at"))
    return places.join(second, ["doc_id", "at"]).withColumn("n", F.lit(1))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, at): the windows of words from ``at`` on that also start earlier."""
    if window < 2 or window % 2:
        raise ValueError("window must be an even number of words")
    half = window // 2
    while half % 2 == 0 and half > FIRST:
        half //= 2
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    places, length = _first_level(texts, half), 2 * half
    while not places.isEmpty():
        rows = _extended(texts, places, length)
        if length == window:
            before = F.rank().over(W.partitionBy("h", "g").orderBy("doc_id", "at"))
            later: Column = (before > 1) | (F.col("fate") == LATER_COPY)
            return rows.withColumn("_later", later).where("_later").select("doc_id", "at")
        places, length = _both_halves(_survivors(rows, "h", "g"), length), 2 * length
    return places.select("doc_id", "at")


def _kept_words(window: int):
    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("doc_id"), batch.column("marks")
            for part in slices(batch.column("text")):
                words = words_of(part)
                first = words.firsts()
                own = marks.slice(part.first, part.rows).fill_null([])
                flat = own.flatten()
                covered = np.zeros(len(words.starts) + 1, dtype=np.int32)
                if len(flat):
                    row = np.repeat(np.arange(part.rows), np.asarray(own.value_lengths()))
                    begin = first[row] + np.asarray(flat)
                    # Versions of a document may be shorter than the one in which the repeat was seen.
                    begin = begin[begin + window <= first[row + 1]]
                    np.add.at(covered, begin, 1)
                    np.add.at(covered, begin + window, -1)
                keep = np.cumsum(covered[:-1]) == 0
                starts, ends, row = words.starts[keep], words.ends[keep], words.row[keep]
                kept = np.bincount(row, minlength=part.rows)
                last = np.ones(len(row), dtype=bool)
                last[:-1] = row[1:] != row[:-1]
                sizes = ends - starts + ~last
                stops = np.cumsum(sizes)
                spots = np.repeat(starts - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)
                out = np.append(part.data, np.uint8(32))[spots]
                out[(stops - 1)[~last]] = 32
                per_row = np.bincount(row, weights=sizes, minlength=part.rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(part.first, part.rows),
                        pa.array(words.counts, pa.int64()),
                        pa.array(words.counts - kept, pa.int64()),
                        binaries(out, per_row).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return run_batches


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the words left, joined by one space)."""
    marks = materialize(repeated_windows(docs, window), "repeats")
    marks = marks.groupBy("doc_id").agg(F.collect_list("at").alias("marks"))
    both = docs.select("doc_id", "text").join(marks, "doc_id", "left")
    return both.mapInArrow(_kept_words(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def longest_repeats(docs: DataFrame, start: int = WINDOW) -> DataFrame:
    """(doc_id, longest): the largest of start, 2 * start, 4 * start, ... words that the document shares with another place.

    A level holds only windows whose two halves both occur elsewhere, and the
    loop ends with the first level at which nothing does.  Documents without a
    repeat, and rows without doc_id, are left out; rows that share a doc_id
    count as separate places.
    """
    if start < 2 or start % 2:
        raise ValueError("start must be an even number of words")
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    places, length = _first_level(texts, start // 2), start
    reached = places.select("doc_id", F.lit(0).alias("longest")).limit(0)
    while not places.isEmpty():
        alive = _survivors(_extended(texts, places, length), "h", "g")
        reached = reached.unionByName(alive.select("doc_id").distinct().withColumn("longest", F.lit(length)))
        places, length = _both_halves(alive, length), 2 * length
    return reached.groupBy("doc_id").agg(F.max("longest").alias("longest"))
