"""Alignment of two tokenizers: groups of tokens between byte offsets where tokens of both end.

A text's tokens are cut into fragments, one per range of bytes.  A fragment
knows the offsets inside its range where both tokenizers end a token: what
lies up to the first is its open head, what follows the last its open tail, and
the groups between them are closed.  Two neighbours make one fragment: the left
tail and the right head close a group, or stay open where one of them has no
common end.  That composition is associative and the empty fragment is its
neutral element, so the fragments of a very long text are tokenized by many
tasks and put together as a tree, eight at a time.

Long texts are cut before a single blank between ASCII letters or digits: no
token of either kind reaches over such a place, so the pieces have the tokens of
the whole.  A text without such a place stays in one piece.

The corpus-wide counts of linked ids have a bound that does not depend on the
corpus: of two tokens that end together one is a suffix of the other, which
leaves less than a million pairs for the two vocabularies.

Defined cases: a null or empty text, and one whose tokens do not spell it, has
no tokens and zeros; strings of special tokens are plain text; rows that repeat
or lack an id are handled one by one; ties for the highest count all count as
best; an empty table has no rows in the result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from turnbook.llm.stored import materialize
from turnbook.llm.text import slices

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of a fragment of a long text, and fragments that are put together at a time.
CHUNK = 1 << 16
TOGETHER_BITS = 3
#: Room for the second id in a pair of linked ids.
B_BITS = 15

# Fixed value: the pattern that byte-level BPE splits a text by before merging.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """Signs of byte-level BPE: visible Latin-1 characters stand for themselves, other bytes for what follows code point 255."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {**{chr(b): b for b in visible}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


@functools.cache
def byte_tokenizer(path: str):
    """(encode a text, bytes of each id).  The vocabulary's ids follow its merges, which is all the engine needs to know."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["id"] for t in model["added_tokens"]}
    signs = byte_alphabet()
    ranks = {bytes(signs[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
    spelled = [b""] * (1 + max(ranks.values()))
    for token, i in ranks.items():
        spelled[i] = token
    for k, merge in enumerate(model["model"]["merges"]):
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        if ranks[bytes(signs[c] for c in left + right)] != 256 + k:
            raise ValueError("ids do not follow the merges")
    engine = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
    return engine.encode_ordinary, spelled


@functools.cache
def piece_tokenizer(path: str):
    """(encode a text, bytes of each id); the tokenizer puts a blank before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return functools.partial(model.encode, num_threads=1), spelled


class Speller:
    """Both tokenizers with what numpy needs: token lengths, and the printed ids with each of their separators."""

    def __init__(self, byte_path: str, piece_path: str):
        (self.encode_a, self.bytes_a), (self.encode_b, self.bytes_b) = byte_tokenizer(byte_path), piece_tokenizer(piece_path)
        self.length_a, self.length_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        n, m = len(self.bytes_a), len(self.bytes_b)
        self.offsets = (0, n, 2 * n, 2 * n + m)
        printed = [f"{i}{mark}" for size, marks in ((n, ",|"), (m, ",;")) for mark in marks for i in range(size)]
        self.printed = np.array(printed, dtype=object)

    def groups(self, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3`` for groups that end before these places of a and b."""
        if not len(ends_a):
            return ""
        size_a, size_b = np.diff(ends_a, prepend=0), np.diff(ends_b, prepend=0)
        at_a = np.arange(ends_a[-1]) + np.repeat(ends_b - size_b, size_a)
        at_b = np.arange(ends_b[-1]) + np.repeat(ends_a, size_b)
        code_a, code_b = a[: ends_a[-1]] + self.offsets[0], b[: ends_b[-1]] + self.offsets[2]
        code_a[ends_a - 1] += self.offsets[1] - self.offsets[0]
        code_b[ends_b - 1] += self.offsets[3] - self.offsets[2]
        codes = np.empty(len(at_a) + len(at_b), dtype=np.int64)
        codes[at_a], codes[at_b] = code_a, code_b
        return "".join(self.printed[codes].tolist())[:-1]


@functools.cache
def speller(byte_path: str, piece_path: str) -> Speller:
    return Speller(byte_path, piece_path)


NONE = np.zeros(0, dtype=np.int64)


@dataclass
class Fragment:
    """What is known of a range of bytes.  Without a common end (``ends`` = 0) all its tokens are in the head."""

    ok: bool = True
    n_a: int = 0
    n_b: int = 0
    ends: int = 0
    head_a: np.ndarray = field(default_factory=lambda: NONE)
    head_b: np.ndarray = field(default_factory=lambda: NONE)
    closed: str = ""
    tail_a: np.ndarray = field(default_factory=lambda: NONE)
    tail_b: np.ndarray = field(default_factory=lambda: NONE)
    #: Distinct linked pairs and how often each occurs.
    pairs: np.ndarray = field(default_factory=lambda: NONE)
    times: np.ndarray = field(default_factory=lambda: NONE)


def fragment(s: Speller, a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> Fragment:
    """The fragment of the tokens that end in a range of bytes."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(common):
        return Fragment(True, len(a), len(b), 0, a, b)
    last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
    pairs, times = np.unique((a[last_a] << B_BITS) | b[last_b], return_counts=True)
    from_a, from_b, to_a, to_b = last_a[0] + 1, last_b[0] + 1, last_a[-1] + 1, last_b[-1] + 1
    closed = s.groups(a[from_a:to_a], b[from_b:to_b], last_a[1:] + 1 - from_a, last_b[1:] + 1 - from_b)
    return Fragment(True, len(a), len(b), len(common), a[:from_a], b[:from_b], closed, a[to_a:], b[to_b:], pairs, times)


def compose(s: Speller, x: Fragment, y: Fragment) -> Fragment:
    """Two neighbours as one."""
    pairs, inverse = np.unique(np.concatenate([x.pairs, y.pairs]), return_inverse=True)
    times = np.bincount(inverse, weights=np.concatenate([x.times, y.times]), minlength=len(pairs)).astype(np.int64)
    both = Fragment(x.ok and y.ok, x.n_a + y.n_a, x.n_b + y.n_b, x.ends + y.ends, pairs=pairs, times=times)
    # A neighbour without a common end has all its tokens in its head.
    if x.ends and y.ends:
        a, b = np.concatenate([x.tail_a, y.head_a]), np.concatenate([x.tail_b, y.head_b])
        middle = s.groups(a, b, np.array([len(a)]), np.array([len(b)]))
        both.head_a, both.head_b, both.tail_a, both.tail_b = x.head_a, x.head_b, y.tail_a, y.tail_b
        both.closed = ";".join(part for part in (x.closed, middle, y.closed) if part)
    elif x.ends:
        both.head_a, both.head_b, both.closed = x.head_a, x.head_b, x.closed
        both.tail_a, both.tail_b = np.concatenate([x.tail_a, y.head_a]), np.concatenate([x.tail_b, y.head_b])
    else:
        both.head_a, both.head_b = np.concatenate([x.head_a, y.head_a]), np.concatenate([x.head_b, y.head_b])
        both.closed, both.tail_a, both.tail_b = y.closed, y.tail_a, y.tail_b
    return both


def all_groups(s: Speller, f: Fragment) -> str:
    """The groups of a whole text: its beginning is a common end, and so is its end."""
    if not f.ends:
        return ""
    head = s.groups(f.head_a, f.head_b, np.array([len(f.head_a)]), np.array([len(f.head_b)]))
    return head + ";" + f.closed if f.closed else head


def tokenized(s: Speller, text: str) -> Fragment:
    """The fragment of a blank and ``text``, which no token reaches out of."""
    spelled = (" " + text).encode()
    a, b = s.encode_a(" " + text), s.encode_b(text)
    if b"".join([s.bytes_a[i] for i in a]) != spelled or b"".join([s.bytes_b[i] for i in b]) != spelled:
        return Fragment(ok=False)
    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    return fragment(s, a, b, np.cumsum(s.length_a[a]), np.cumsum(s.length_b[b]))


ASCII_ALNUM = np.zeros(256, dtype=bool)
ASCII_ALNUM[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True


def cuts(data: np.ndarray, size: int) -> list[int]:
    """Where to cut a text: at blanks between ASCII letters or digits, ``size`` bytes apart or more."""
    blank = np.flatnonzero((data[1:-1] == 32) & ASCII_ALNUM[data[:-2]] & ASCII_ALNUM[data[2:]]) + 1
    out, last = [], 0
    while (k := np.searchsorted(blank, last + size)) < len(blank):
        last = int(blank[k])
        out.append(last)
    return out


FRAGMENT = (
    "row bigint, place bigint, ok boolean, n_a bigint, n_b bigint, ends bigint, head_a array<bigint>, head_b array<bigint>, closed string, "
    "tail_a array<bigint>, tail_b array<bigint>, pairs array<bigint>, times array<bigint>"
)
ARRAYS = ("head_a", "head_b", "tail_a", "tail_b", "pairs", "times")
_NUMBERS = pa.list_(pa.int64())
_PLAIN = {"closed": pa.string(), "ok": pa.bool_()}
FRAGMENT_SCHEMA = pa.schema([(n, _NUMBERS if n in ARRAYS else _PLAIN.get(n, pa.int64())) for n in (p.split()[0] for p in FRAGMENT.split(", "))])
ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, ends bigint, groups_sha256 string, pairs binary, times binary"
ALIGNED_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("ends", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
)


def _aligned_row(s: Speller, doc_id: int | None, f: Fragment) -> tuple:
    if not f.ok or not f.ends:
        return doc_id, 0, 0, 0, "", b"", b""
    digest = hashlib.sha256(all_groups(s, f).encode("ascii")).hexdigest()
    return doc_id, f.n_a, f.n_b, f.ends, digest, f.pairs.astype("<i4").tobytes(), f.times.astype("<i4").tobytes()


def _aligned_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in ALIGNED_SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, ALIGNED_SCHEMA)], schema=ALIGNED_SCHEMA)


def _align_short(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = speller(byte_path, piece_path)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for part in slices(batch.column("text")):
                texts = batch.column("text").slice(part.first, part.rows).to_pylist()
                yield _aligned_batch([_aligned_row(s, i, tokenized(s, t) if t else Fragment()) for i, t in zip(ids[part.first :], texts)])

    return run


def _cut_long(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for part in slices(batch.column("text"), 1):
                at = [0, *cuts(part.data, size), len(part.data)]
                for k, (first, last) in enumerate(zip(at, at[1:])):
                    # A piece begins with the blank that the tokenizers get anyway.
                    text = part.data[first + (k > 0) : last].tobytes().decode()
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[part.first]], pa.int64()), "row": [rows[part.first]], "place": [k], "text": [text]})

    return run


def _fragments(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = speller(byte_path, piece_path)
        for batch in batches:
            for r in batch.to_pylist():
                yield _fragment_batch(r["row"], r["place"], tokenized(s, r["text"]))

    return run


def _fragment_batch(row: int, place: int, f: Fragment) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"row": [row], "place": [place], **{n: [getattr(f, n)] for n in FRAGMENT_SCHEMA.names[2:]}}, schema=FRAGMENT_SCHEMA)


def _as_fragment(r: dict) -> Fragment:
    return Fragment(**{n: np.array(r[n], dtype=np.int64) if n in ARRAYS else r[n] for n in FRAGMENT_SCHEMA.names[2:]})


def _compose_group(byte_path: str, piece_path: str):
    def run(group: pa.Table) -> pa.Table:
        s = speller(byte_path, piece_path)
        rows = sorted(group.to_pylist(), key=lambda r: r["place"])
        whole = functools.reduce(lambda x, y: compose(s, x, y), map(_as_fragment, rows))
        return pa.Table.from_batches([_fragment_batch(rows[0]["row"], rows[0]["place"] >> TOGETHER_BITS, whole)])

    return run


def _finish(byte_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = speller(byte_path, piece_path)
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                yield _aligned_batch([_aligned_row(s, r["doc_id"], _as_fragment(r))])

    return run


def align(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, chunk: int = CHUNK) -> DataFrame:
    """One written row per document: doc_id, n_a, n_b, ends (common ends, each of which closes a group and links a pair), the digest of the groups, and the linked pairs with their numbers."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    is_long = F.coalesce(F.octet_length("text") > 2 * chunk, F.lit(False))
    short = texts.where(~is_long).mapInArrow(_align_short(byte_path, piece_path), ALIGNED)

    long = texts.where(is_long).withColumn("row", F.monotonically_increasing_id())
    pieces = materialize(long.mapInArrow(_cut_long(chunk), "doc_id bigint, row bigint, place bigint, text string"), "pieces")
    spread = pieces.select("row", "place", "text").repartition("row", "place")
    parts = materialize(spread.mapInArrow(_fragments(byte_path, piece_path), FRAGMENT), "fragments")
    most = parts.agg(F.max("place")).first()[0] or 0
    while most:
        grouped = parts.groupBy("row", F.shiftright("place", TOGETHER_BITS).alias("_up"))
        parts = materialize(grouped.applyInArrow(_compose_group(byte_path, piece_path), FRAGMENT), "fragments")
        most >>= TOGETHER_BITS
    owners = pieces.where("place = 0").select("doc_id", F.col("row").alias("_row"))
    whole = parts.join(owners, F.col("row") == F.col("_row")).drop("_row")
    finished = whole.mapInArrow(_finish(byte_path, piece_path), ALIGNED)
    return materialize(short.unionByName(finished), "aligned")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all 32-bit numbers of a binary column, how many each row has)."""
    held = [np.frombuffer(x.as_buffer(), dtype="<i4") for x in column]
    return np.concatenate(held) if held else np.zeros(0, dtype="<i4"), np.array([len(h) for h in held], dtype=np.int64)


def _batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs, inverse = np.unique(_numbers(batch.column("pairs"))[0], return_inverse=True)
        times = np.bincount(inverse, weights=_numbers(batch.column("times"))[0], minlength=len(pairs))
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(times.astype(np.int64))], names=["pair", "times"])


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n, best: how many links of the corpus hold a pair, and whether no pair of its b has more.

    It has fewer rows than the two vocabularies have pairs with one token a suffix of the other.
    """
    n = aligned.select("pairs", "times").mapInArrow(_batch_counts, "pair int, times bigint").groupBy("pair").agg(F.sum("times").alias("n"))
    n = materialize(n.select(F.shiftright("pair", B_BITS).alias("a"), F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n"), "links")
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _judge_links(keys: np.ndarray, n: np.ndarray, best: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, sizes = _numbers(batch.column("pairs"))
            times = _numbers(batch.column("times"))[0].astype(np.int64)
            at = np.searchsorted(keys, pairs)
            sums = [np.concatenate(([0], np.cumsum(x))) for x in (times * best[at], times * n[at])]
            last = np.cumsum(sizes)
            per_row = [pa.array((s[last] - s[last - sizes]).astype(np.int64)) for s in sums]
            kept = [batch.column(c) for c in ("doc_id", "n_a", "n_b", "ends", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, *per_row], names=["doc_id", "n_a", "n_b", "ends", "groups_sha256", "n_best", "count_sum"])

    return run


def report(docs: DataFrame, byte_path: str = BYTE_BPE, piece_path: str = PIECE_BPE, chunk: int = CHUNK) -> DataFrame:
    """One row per document: its tokens, groups and links, and how its links stand among those of the corpus."""
    aligned = align(docs, byte_path, piece_path, chunk)
    counts = link_counts(aligned).toArrow()
    keys = (counts.column("a").to_numpy().astype(np.int64) << B_BITS) | counts.column("b").to_numpy()
    order = np.argsort(keys)
    n, best = counts.column("n").to_numpy()[order], counts.column("best").to_numpy()[order]
    # A pair without count keeps the lookup defined for a corpus without links.
    keys, n, best = np.append(keys[order], 1 << 62), np.append(n, 0), np.append(best, False)
    schema = "doc_id bigint, n_a bigint, n_b bigint, ends bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    judged = aligned.mapInArrow(_judge_links(keys, n, best), schema)
    return judged.select("doc_id", "n_a", "n_b", F.col("ends").alias("n_groups"), F.col("ends").alias("n_links"), "n_best", "count_sum", "groups_sha256")
