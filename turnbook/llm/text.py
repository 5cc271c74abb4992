"""Numpy kernels over the UTF-8 bytes of an Arrow text column, and small column helpers.

Words are found and hashed for a whole slice of rows at once: a running sum of
``table[byte] * P**position`` gives the hash of any stretch of bytes by one
subtraction, and the same trick over word hashes gives the hash of any window
of words.  All sums are modulo 2**64, so nothing here depends on row order.
Such sums alone are equal for some patterned texts of a thousand bytes, so a
longer stretch is hashed block by block and the scrambled hashes are added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, functions as F

#: Words of the contracts: maximal runs without these seven bytes.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]"

#: Text bytes that are held and expanded in numpy at a time; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

#: Bytes that one running sum stands for in the hash of a stretch.
BLOCK = 32

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACE)] = False
LETTER = np.zeros(256, dtype=bool)
LETTER[ord("a") : ord("z") + 1] = True
LETTER[ord("A") : ord("Z") + 1] = True
LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            grown = []
            for b in (self.base, self.inverse):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                grown.append(np.cumprod(steps, dtype=np.uint64))
            self.up, self.down = grown


BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
WORD_POWERS = Powers(0xD6E8FEB86659FD93)
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


@dataclass
class Slice:
    """Some rows of a text column: ``offsets[i]:offsets[i+1]`` are the bytes of row ``first + i``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive rows with up to ``limit`` bytes of text together; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, n)
        yield Slice(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a slice in order: byte range, row within the slice, and each row's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    counts: np.ndarray
    sums: np.ndarray

    def stretch(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range, its length included."""
        lengths = ends - starts
        with np.errstate(over="ignore"):
            h = self._block(starts, np.minimum(ends, starts + BLOCK))
            long = np.flatnonzero(lengths > BLOCK)
            if len(long):
                blocks = -(-lengths[long] // BLOCK)
                firsts = np.cumsum(blocks) - blocks
                place = np.arange(blocks.sum()) - np.repeat(firsts, blocks)
                begin = np.repeat(starts[long], blocks) + place * BLOCK
                end = np.minimum(begin + BLOCK, np.repeat(ends[long], blocks))
                numbered = (place + 1).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
                h[long] = np.add.reduceat(mix(self._block(begin, end) + numbered), firsts)
            return mix(h + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    def _block(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * BYTE_POWERS.down[starts]

    def hashes(self) -> np.ndarray:
        return self.stretch(self.starts, self.ends)

    def firsts(self) -> np.ndarray:
        """Index of each row's first word, and the number of all words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))


def words_of(part: Slice, lower: bool = False, inside: np.ndarray = NOT_SPACE) -> Words:
    data = LOWER[part.data] if lower else part.data
    n = len(data)
    edges = part.offsets
    keep = inside[data]
    begin = keep.copy()
    begin[1:] &= ~keep[:-1]
    heads = edges[:-1][edges[:-1] < n]
    begin[heads] = keep[heads]
    end = keep.copy()
    end[:-1] &= ~keep[1:]
    tails = edges[1:][edges[1:] > 0] - 1
    end[tails] = keep[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(edges, starts, side="right") - 1
    BYTE_POWERS.upto(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUES[data] * BYTE_POWERS.up[:n], out=sums[1:])
    return Words(data, starts, ends, row, np.bincount(row, minlength=part.rows), sums)


class Windows:
    """Hashes of runs of consecutive words."""

    def __init__(self, word_hashes: np.ndarray):
        n = len(word_hashes)
        WORD_POWERS.upto(n + 1)
        self.n = n
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(word_hashes * WORD_POWERS.up[:n], out=self.sums[1:])

    def at(self, starts: np.ndarray, lengths) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.sums[starts + lengths] - self.sums[starts]) * WORD_POWERS.down[starts]
            return mix(h + np.uint64(0x9FB21C651E98DF25) * np.asarray(lengths).astype(np.uint64))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrow lists of 64-bit numbers: ``counts[i]`` values for row i."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), signed(values))


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Arrow binaries: ``counts[i]`` bytes of ``values`` for row i."""
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def crc_third(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: the fold that is held out is 1.  Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3
