"""Language-model scoring by online logistic context mixing: the bits it takes to code a text, byte by byte.

A text is a run of units: words with the blank (or the end of the text) behind
them.  Each byte is coded bit by bit.  Five predictors look up how often a bit
was 0 or 1 after the last 1, 2, 3, 4 or 6 bytes of the unit, in hashed slots;
the first byte of a unit is coded after the three bytes before it.  Their
log-odds are combined by weights that a gate selects (the bit's place in the
byte and the longest context that was seen), and an adaptive map refines the
result.  Weights and map are learned online, one block of bytes after another.

What is gathered grows with the corpus: every distinct unit of the training
documents with its count.  Context counts, weights and map come from all of
these.  Weights start from a first look at about ``START_UNITS`` units; then
every task goes online over all of its units from there, the tasks' weights are
averaged by what each has seen, and their maps are added up.  The slots are a
table of fixed size, so they may go to every task; the units are not, so each chunk of documents gets
exactly the costs of the units that it asks for, by a join.  All occurrences of a
unit cost the same, which is why distinct units are coded and not texts.

Defined cases: a null text is empty and has one token, its end; texts of any
length are read whole, a slice at a time; rows without doc_id are scored and
never learned from; rows that repeat are scored alike; without training
documents no count is known and every bit costs one bit; an empty table has no
rows in the result; further columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from turnbook.llm.manifest import lowered
from turnbook.llm.stored import materialize
from turnbook.llm.text import NOT_SPACE, Slice, mix, slices

#: Text bytes of the documents that get their units' costs together.
CHUNK_BYTES = 32 << 20
#: Codes the end of a text; no byte of UTF-8 has this value.
END = 255
ORDERS = (1, 2, 3, 4, 6)
#: Slots of a hashed table as a power of two, and the table of each order.
SLOT_BITS = 21
TABLE_OF = (0, 0, 0, 1, 2)
SLOTS = 3 << SLOT_BITS
#: Units of the first look, from which the weights start; up to so many are learned from in one place.
START_UNITS = 1 << 16
EPOCHS = 3
BLOCK = 512
RATE = 0.05
#: Count of each side that no observation has.
PRIOR = 0.4
#: Counts are kept as 8 * log2(1 + n) in a byte.
STEPS = 8
LEVELS, REACH, APM_PRIOR, APM_SHARE = 33, 8.0, 24.0, 0.5
FIRST_BYTE = 0xFE << 40
NODE_STEP, SLOT_STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
BITS_TO_LOG10 = float(np.log10(2.0))


def coefficients(n: int) -> np.ndarray:
    """Pseudo-random odd multipliers of the bytes of a unit by place; any prefix is the same for every ``n``."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


@dataclass
class Units:
    """The units of a slice in order: bytes (the last is the terminator), first and last place, row, ids of unit and first byte."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    ids: np.ndarray
    first_key: np.ndarray

    @property
    def first_ids(self) -> np.ndarray:
        return first_byte_ids(self.first_key)


def first_byte_ids(key: np.ndarray) -> np.ndarray:
    """Ids of (three bytes before, first byte); odd, where those of units are even."""
    return mix(key.astype(np.uint64) + np.uint64(1 << 40)) | np.uint64(1)


def units_of(part: Slice) -> Units:
    data = np.insert(part.data, part.offsets[1:], END)
    heads = part.offsets[:-1] + np.arange(part.rows)
    stops = ~NOT_SPACE[data]
    stops[part.offsets[1:] + np.arange(part.rows)] = True
    ends = np.flatnonzero(stops)
    starts = np.concatenate(([0], ends[:-1] + 1))
    lengths = ends - starts + 1
    row = np.searchsorted(heads, starts, side="right") - 1
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(BYTE_VALUES[data] * coefficients(int(lengths.max()))[place], starts)
        ids = mix(sums + lengths.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)) & ~np.uint64(1)
    key = data[starts].astype(np.int64)
    for d in (1, 2, 3):
        known = starts - d >= heads[row]
        key |= np.where(known, data[np.maximum(starts - d, 0)], 0).astype(np.int64) << (8 * d)
    return Units(data, starts, ends, row, ids, key)


# --- chunks of documents and their units --------------------------------------


def _numbered_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
        numbers = np.empty(batch.num_rows, dtype=np.int64)
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > CHUNK_BYTES:
                chunk, held = chunk + 1, 0
            numbers[i], held = chunk, held + size
        yield pa.RecordBatch.from_arrays([pa.array(numbers), *batch.columns], names=["chunk", *batch.schema.names])


def chunks(docs: DataFrame, train: Column) -> DataFrame:
    """chunk, doc_id, train, text: neighbours share a chunk of up to CHUNK_BYTES; written, so that numbers stay."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), train.alias("train"), "text")
    return materialize(rows.mapInArrow(_numbered_chunks, "chunk bigint, doc_id bigint, train boolean, text string"), "chunks")


UNIT = "chunk bigint, id bigint, unit binary, n bigint"


def _runs(owner: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(chunk, its units): the rows of a chunk are neighbours, and so are their units."""
    chunk = owner[row]
    borders = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]))
    for first, last in zip(borders[:-1], borders[1:]):
        yield int(chunk[first]), slice(first, last)


def _batch_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct units of each chunk in a slice: bytes and terminator, or a first byte after the three before it."""
    for batch in batches:
        owner, train = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "train"))
        for part in slices(batch.column("text"), 4 << 20):
            u = units_of(part)
            row = u.row + part.first
            held = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(u.starts), [None, pa.py_buffer(np.append(u.starts, len(u.data)).astype(np.int64)), pa.py_buffer(u.data)]
            )
            for chunk, own in _runs(owner, row):
                weight = train[row[own]].astype(np.float64)
                ids, where, inverse = np.unique(u.ids[own], return_index=True, return_inverse=True)
                n = np.bincount(inverse, weights=weight, minlength=len(ids)).astype(np.int64)
                yield _unit_batch(chunk, ids, held.take(pa.array(where + own.start)).cast(pa.binary()), n)
                keys, inverse = np.unique(u.first_key[own], return_inverse=True)
                n = np.bincount(inverse, weights=weight, minlength=len(keys)).astype(np.int64)
                yield _unit_batch(chunk, first_byte_ids(keys), pa.array([k.to_bytes(4, "big") for k in keys.tolist()], pa.binary()), n)


def _unit_batch(chunk: int, ids: np.ndarray, unit: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(ids), chunk, dtype=np.int64)), pa.array(ids.view(np.int64)), unit, pa.array(n)]
    return pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in UNIT.split(", ")])


def _asked_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the units of each chunk; a chunk that goes over several slices is asked for once."""
    last, held = None, []

    def answer() -> Iterator[pa.RecordBatch]:
        if held:
            ids = np.unique(np.concatenate(held)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), last, dtype=np.int64)), pa.array(ids)], names=["chunk", "id"])

    for batch in batches:
        owner = batch.column("chunk").to_numpy()
        for part in slices(batch.column("text"), 4 << 20):
            u = units_of(part)
            for chunk, own in _runs(owner, u.row + part.first):
                if chunk != last:
                    yield from answer()
                    last, held = chunk, []
                held += [np.unique(u.ids[own]), first_byte_ids(np.unique(u.first_key[own]))]
    yield from answer()


def vocabulary(chunked: DataFrame) -> DataFrame:
    """id, unit, n: every distinct unit and how often training documents have it; ordered, so that a task's units share contexts."""
    found = chunked.select("chunk", "train", "text").mapInArrow(_batch_units, UNIT)
    counted = found.groupBy("id", "unit").agg(F.sum("n").alias("n"))
    return materialize(counted.repartitionByRange("unit", "id").sortWithinPartitions("unit"), "vocabulary")


def is_word(unit_id: Column) -> Column:
    return unit_id.bitwiseAND(F.lit(1)) == 0


# --- coding -------------------------------------------------------------------


@dataclass
class Symbols:
    """Distinct (six bytes before, byte) to code, and which of them each byte of each unit is."""

    context: np.ndarray
    byte: np.ndarray
    #: Per coded byte: its symbol and its unit.
    of: np.ndarray
    unit: np.ndarray

    def per_symbol(self, n: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=n[self.unit], minlength=len(self.byte))

    def per_unit(self, bits: np.ndarray, units: int) -> np.ndarray:
        return np.bincount(self.unit, weights=bits[self.of], minlength=units)


def symbols(ids: np.ndarray, unit: pa.Array) -> Symbols:
    """Bytes of units: all but the first of a word with its terminator, or the last of four, a first byte after three others."""
    unit = unit.cast(pa.large_binary())
    _, where, held = unit.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[unit.offset : unit.offset + len(unit) + 1]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(unit)), lengths)
    place = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], lengths)
    word = (ids & 1) == 0
    at = np.flatnonzero(place > np.where(word, 0, 2)[row])
    symbol = data[at]
    for d in range(1, max(ORDERS) + 1):
        symbol |= np.where(place[at] >= d, data[np.maximum(at - d, 0)], np.uint64(0)) << np.uint64(8 * d)
    symbol |= np.where(word[row[at]], np.uint64(0), np.uint64(FIRST_BYTE << 8))
    distinct, of = np.unique(symbol, return_inverse=True)
    return Symbols(distinct >> np.uint64(8), (distinct & np.uint64(255)).astype(np.int64), of, row[at])


#: Units that are coded together, so that their common symbols are coded once.
TOGETHER = 1 << 18
#: Symbols whose bits are held at a time.
COSTED = 1 << 15


def gathered(batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches of about ``together`` rows."""
    held, rows = [], 0
    for batch in batches:
        held, rows = [*held, batch], rows + batch.num_rows
        if rows >= together:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def context_hashes(context: np.ndarray) -> list[np.ndarray]:
    """One hash per order."""
    out = []
    for k in ORDERS:
        own = context & np.uint64((1 << (8 * k)) - 1)
        out.append(mix((own << np.uint64(3)) | np.uint64(k)))
    return out


def slots(hashed: list[np.ndarray], node: np.ndarray) -> np.ndarray:
    """(symbols, orders): the slot of a node of the byte's bit tree after each context."""
    with np.errstate(over="ignore"):
        step = node.astype(np.uint64) * np.uint64(NODE_STEP)
        columns = [((h ^ step) * np.uint64(SLOT_STEP)) >> np.uint64(64 - SLOT_BITS) for h in hashed]
    return np.stack([c.astype(np.int64) + (t << SLOT_BITS) for c, t in zip(columns, TABLE_OF)], axis=1)


def bit_of(byte: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, bit) of the i-th bit of a byte, highest first."""
    return (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1


NUMBERS = np.exp2(np.arange(256) / STEPS) - 1
PAIRS = 1 << 16


def _of_pairs() -> tuple[np.ndarray, np.ndarray]:
    """Log-odds, and whether anything was seen, of each pair of packed counts: as it is, without a 0, without a 1."""
    zeros, ones = NUMBERS[np.arange(PAIRS) & 255], NUMBERS[np.arange(PAIRS) >> 8]
    kinds = [(zeros, ones), (np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))]
    return (
        np.concatenate([np.log((n1 + PRIOR) / (n0 + PRIOR)) for n0, n1 in kinds]),
        np.concatenate([n0 + n1 > 0.5 for n0, n1 in kinds]),
    )


ODDS, SEEN = _of_pairs()


def level_of(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The level of the map at or below some log-odds, and the share of the one above."""
    place = (np.clip(logit, -REACH, REACH) + REACH) * ((LEVELS - 1) / (2 * REACH))
    low = np.minimum(place.astype(np.int64), LEVELS - 2)
    return low, place - low


class Mixer:
    """Counts in slots, gated weights, and the map that refines."""

    def __init__(self, counts: np.ndarray):
        #: Two bytes per slot, how often the bit was 0 and, above, how often 1.
        self.pairs = counts[:, 0].astype(np.uint16) | (counts[:, 1].astype(np.uint16) << 8)
        self.weights = np.full((8, len(ORDERS) + 1, len(ORDERS) + 1), 0.3)
        self.weights[:, :, -1] = 0.0
        spread = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, LEVELS)))
        self.map = np.stack([np.tile(APM_PRIOR * (1 - spread), (256, 1)), np.tile(APM_PRIOR * spread, (256, 1))], axis=2)
        #: Of each bit and gate: squares of the steps so far, and the occurrences learned from.
        self.squares = np.full_like(self.weights, 1e-4)
        self.seen = np.zeros(self.weights.shape[:2])

    def inputs(self, at: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds of each predictor and 1, longest context seen); without the own observation of bit ``own``."""
        pair = self.pairs[at].astype(np.int64)
        if own is not None:
            pair += (PAIRS * (own + 1))[:, None]
        odds, seen = ODDS[pair], SEEN[pair]
        longest = np.where(seen.any(axis=1), len(ORDERS) - np.argmax(seen[:, ::-1], axis=1), 0)
        return np.concatenate([odds, np.ones((len(at), 1))], axis=1), longest

    def refined(self, node: np.ndarray, logit: np.ndarray) -> np.ndarray:
        """Probability of 1."""
        p = 1 / (1 + np.exp(-logit))
        low, high_share = level_of(logit)
        near = [self.map[node, low + k] for k in (0, 1)]
        mapped = [x[:, 1] / x.sum(axis=1) for x in near]
        q = mapped[0] * (1 - high_share) + mapped[1] * high_share
        p = (1 - APM_SHARE) * p + APM_SHARE * q
        return np.clip(p, 1e-6, 1 - 1e-6)

    def learn(self, s: Symbols, n: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        """Weights and, in the last epoch, the map, online over blocks of bytes; ``n`` counts the occurrences of each."""
        rng = np.random.default_rng(seed)
        columns = np.arange(len(ORDERS) + 1)
        flat = self.map.reshape(-1)
        for epoch in range(epochs):
            order = rng.permutation(len(s.byte))
            for k in range(0, len(order), BLOCK):
                rows = order[k : k + BLOCK]
                hashed, weight = context_hashes(s.context[rows]), n[rows].astype(np.float64)
                share = weight / weight.sum()
                for i in range(8):
                    node, bit = bit_of(s.byte[rows], i)
                    x, gate = self.inputs(slots(hashed, node), own=bit)
                    logit = (self.weights[i, gate] * x).sum(axis=1)
                    error = (bit - 1 / (1 + np.exp(-logit))) * share
                    at = gate[:, None] * len(columns) + columns
                    step = np.bincount(at.ravel(), weights=(error[:, None] * x).ravel(), minlength=len(columns) ** 2).reshape(-1, len(columns))
                    self.squares[i] += step**2
                    self.weights[i] += RATE * step / np.sqrt(self.squares[i])
                    if epoch == epochs - 1:
                        self.seen[i] += np.bincount(gate, weights=weight, minlength=len(columns))
                        low, high_share = level_of(logit)
                        at = (node * LEVELS + low) * 2 + bit
                        np.add.at(flat, at, weight * (1 - high_share))
                        np.add.at(flat, at + 2, weight * high_share)

    def cost(self, s: Symbols) -> np.ndarray:
        """Bits of each byte."""
        total = np.zeros(len(s.byte))
        for k in range(0, len(total), COSTED):
            own = slice(k, k + COSTED)
            hashed = context_hashes(s.context[own])
            for i in range(8):
                node, bit = bit_of(s.byte[own], i)
                x, gate = self.inputs(slots(hashed, node))
                p = self.refined(node, (self.weights[i, gate] * x).sum(axis=1))
                total[own] -= np.log2(np.where(bit == 1, p, 1 - p))
        return total


# --- fitting ------------------------------------------------------------------


def _context_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences per slot and bit (2 * slot + bit) of a task's units."""
    total = np.zeros(2 * SLOTS)
    for batch in gathered(batches):
        s = symbols(batch.column("id").to_numpy(), batch.column("unit"))
        n = s.per_symbol(batch.column("n").to_numpy())
        hashed = context_hashes(s.context)
        for i in range(8):
            node, bit = bit_of(s.byte, i)
            at = 2 * slots(hashed, node) + bit[:, None]
            for j in range(len(ORDERS)):
                np.add.at(total, at[:, j], n)
    some = np.flatnonzero(total)
    for k in range(0, len(some), 1 << 18):
        at = some[k : k + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], names=["at", "n"])


@dataclass
class Model:
    mixer: Mixer
    #: id, bits, word_count: the cost of every unit and the count of its word in lower case.
    costs: DataFrame
    train_tokens: int
    distinct_tokens: int
    end_count: int


def _unit_costs(mixer: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            s = symbols(batch.column("id").to_numpy(), batch.column("unit"))
            bits = s.per_unit(mixer.cost(s), batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("unit"), pa.array(bits.astype(np.float32))], names=["id", "unit", "bits"])

    return run


def _learn_all(mixer: Mixer):
    """Sums of a task: weights times occurrences, occurrences, and what it adds to the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = copy.deepcopy(mixer)
        own.seen[:], own.map[:] = 0, 0
        for batch in gathered(batches, START_UNITS):
            s = symbols(batch.column("id").to_numpy(), batch.column("unit"))
            own.learn(s, s.per_symbol(batch.column("n").to_numpy()), epochs=1)
        values = np.concatenate([(own.weights * own.seen[:, :, None]).ravel(), own.seen.ravel(), own.map.ravel()])
        some = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(values[some])], names=["at", "value"])

    return run


def learned_by_all(start: Mixer, learned: DataFrame) -> Mixer:
    """Weights and map of all units: each task goes over its own once; what comes back has the size of weights and map."""
    sums = learned.mapInArrow(_learn_all(start), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = copy.deepcopy(start)
    prior = Mixer(np.zeros((1, 2), dtype=np.uint8)).map
    values = np.zeros(out.weights.size + out.seen.size + prior.size)
    values[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    weights, seen, added = np.split(values, [out.weights.size, out.weights.size + out.seen.size])
    out.seen = seen.reshape(out.seen.shape)
    n = out.seen[:, :, None]
    # What no task has met keeps its start.
    out.weights = np.where(n > 0, weights.reshape(out.weights.shape) / np.maximum(n, 1), out.weights)
    out.map = prior + added.reshape(prior.shape)
    return out


def fit(chunked: DataFrame) -> Model:
    """A model of the training documents among ``chunked`` that knows the cost of every unit of all documents."""
    known = vocabulary(chunked)
    learned = known.where("n > 0")
    packed = F.least(F.lit(255), F.round(STEPS * F.log2(1 + F.col("n"))))
    total = learned.mapInArrow(_context_counts, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    table = materialize(total.select("at", packed.cast("smallint").alias("n")), "slots").toArrow()
    counts = np.zeros(2 * SLOTS, dtype=np.uint8)
    counts[table.column("at").to_numpy()] = table.column("n").to_numpy()
    mixer = Mixer(counts.reshape(-1, 2))

    share = max(1, -(-learned.count() // START_UNITS))
    start = learned.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).orderBy("id").toArrow()
    if start.num_rows:
        s = symbols(start.column("id").to_numpy(), start.column("unit").combine_chunks())
        mixer.learn(s, s.per_symbol(start.column("n").to_numpy()))
    if share > 1:
        mixer = learned_by_all(mixer, learned)

    word = F.when(is_word(F.col("id")), lowered(F.expr("substring(unit, 1, octet_length(unit) - 1)").cast("string")))
    words = learned.select(word.alias("lower"), "n").where("lower <> ''").groupBy("lower").agg(F.sum("n").alias("word_count"))
    words = materialize(words, "words")
    sums = words.agg(F.sum("word_count"), F.count(F.lit(1))).first()
    ends = chunked.where("train").count()
    priced = known.select("id", "unit").mapInArrow(_unit_costs(mixer), "id bigint, unit binary, bits float")
    costs = priced.withColumn("lower", word).join(words, "lower", "left").select("id", "bits", F.coalesce("word_count", F.lit(0)).alias("word_count"))
    return Model(mixer, materialize(costs, "costs"), (sums[0] or 0) + ends, sums[1] + (ends > 0), ends)


# --- scoring ------------------------------------------------------------------

SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, n_bytes bigint, base_score double, bits double"


def _score_chunk(train_tokens: int, distinct_tokens: int, end_count: int):
    floor = np.log10(train_tokens + distinct_tokens + 1)

    def run(docs: pa.Table, costs: pa.Table) -> pa.Table:
        ids = costs.column("id").to_numpy()
        order = np.argsort(ids)
        ids, bits, counts = ids[order], costs.column("bits").to_numpy()[order].astype(np.float64), costs.column("word_count").to_numpy()[order]
        owners = docs.column("doc_id").combine_chunks()
        out = []
        for part in slices(docs.column("text"), 4 << 20):
            u = units_of(part)
            at, first = (np.searchsorted(ids, x.view(np.int64)) for x in (u.ids, u.first_ids))
            total = np.bincount(u.row, weights=bits[at] + bits[first], minlength=part.rows)
            word = u.ends > u.starts
            row, c = u.row[word], counts[at[word]]
            base = np.bincount(row, weights=np.log10(c + 1.0) - floor, minlength=part.rows) + (np.log10(end_count + 1.0) - floor)
            n = np.bincount(row, minlength=part.rows) + 1
            n_known = np.bincount(row, weights=c > 0, minlength=part.rows).astype(np.int64) + (end_count > 0)
            columns = [pa.array(n), pa.array(n_known), pa.array(np.diff(part.offsets)), pa.array(base), pa.array(total)]
            own = owners.slice(part.first, part.rows)
            out.append(pa.Table.from_arrays([own if isinstance(own, pa.Array) else own.combine_chunks(), *columns], names=[p.split()[0] for p in SCORES.split(", ")]))
        return pa.concat_tables(out)

    return run


def score(chunked: DataFrame, model: Model) -> DataFrame:
    """One row per document of ``chunked``: its tokens, base score, and bits.  Every chunk gets the costs of its own units."""
    asked = chunked.select("chunk", "text").mapInArrow(_asked_units, "chunk bigint, id bigint")
    answers = asked.join(model.costs, "id").select("chunk", "id", "bits", "word_count")
    run = _score_chunk(model.train_tokens, model.distinct_tokens, model.end_count)
    together = chunked.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return materialize(together.applyInArrow(lambda docs, costs: run(docs, costs), SCORES), "scores")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 7: the fold that is held out is 2.  Null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 7


def rate(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those not held out; ``score`` is the log10 probability, ``bits_per_byte`` the same per byte."""
    chunked = chunks(docs, F.coalesce(fold(F.col("doc_id")) != 2, F.lit(False)))
    model = fit(chunked)
    out = score(chunked, model)
    return out.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        (F.col("bits") * -BITS_TO_LOG10).alias("score"),
        F.try_divide("bits", "n_bytes").alias("bits_per_byte"),
    )
