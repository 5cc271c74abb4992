"""Tokenizer alignment against plain loops over the tokens of whole texts."""

from __future__ import annotations

import collections
import functools
import hashlib
import random

import numpy as np
import pytest

from fixtures import AWKWARD, SCHEMA, invented, rows_of, table
from turnbook.llm import alignment

LONG = "word another 12 third. " * 4000
ODD = [
    "a  b", " a", "a\n\nb ", "ﬁ ½ é", "▁x y", "<s> </s> <unk> <0x41>", "x <|endoftext|> y", "it's we'll don't", "a\x00b", "　x",
    "\U0001f600\U0001f468‍\U0001f469", " " * 500 + "a", "ab" * 3000, "a ́b", "tab\tend\r\n", "2024-01-01 10:30", "日本語 文本", "naïve Été",
]


@functools.cache
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)


def tokens(text):
    """[(id, bytes)] of both tokenizers, by the libraries' own vocabularies."""
    one, two = tokenizers()
    signs = alignment.byte_alphabet()
    a = [(i, bytes(signs[c] for c in one.id_to_token(i))) for i in one.encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, two.id_to_piece(i)) for i in two.encode(text)]
    b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    return a, b


def groups_of(text):
    """Groups as pairs of id lists; None without tokens."""
    if not text:
        return None
    a, b = tokens(text)
    spelled = (" " + text).encode()
    if b"".join(x for _, x in a) != spelled or b"".join(x for _, x in b) != spelled:
        return None
    ends = [set(np.cumsum([len(x) for _, x in t]).tolist()) for t in (a, b)]
    common = sorted(ends[0] & ends[1])
    out = [([], []) for _ in common]
    for side, t in enumerate((a, b)):
        k = at = 0
        for i, x in t:
            at += len(x)
            out[k][side].append(i)
            k += common[k] == at
    return out


def expected(rows):
    grouped = [(doc_id, groups_of(text)) for doc_id, text in rows]
    links = collections.Counter((x[-1], y[-1]) for _, g in grouped for x, y in g or [])
    most = collections.Counter()
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    out = []
    for doc_id, g in grouped:
        own = [(x[-1], y[-1]) for x, y in g or []]
        printed = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        digest = hashlib.sha256(printed.encode()).hexdigest() if g else ""
        n_a, n_b = (sum(len(p[side]) for p in g or []) for side in (0, 1))
        out.append((doc_id, n_a, n_b, len(own), len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), digest))
    return sorted(out, key=repr)


def check(docs, **more):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in alignment.report(docs, **more).collect()), key=repr) == expected(rows)


def test_awkward_texts(spark):
    check(spark.createDataFrame(rows_of(AWKWARD) + rows_of(ODD, first=100) + rows_of([(3, "twice"), (3, "twice"), (None, "none"), (None, None)]), SCHEMA))


def test_invented_texts_and_long_ones_in_pieces(spark):
    check(table(spark, [*invented(n=40), LONG, "été " * 9000, "x" * 5000], ), chunk=512)


def test_empty_table_and_corpus_without_tokens(spark):
    assert alignment.report(table(spark, [])).collect() == []
    check(table(spark, [None, "", "▁"]))


def _plain(f):
    return (f.ok, f.n_a, f.n_b, f.ends, *(list(x) for x in (f.head_a, f.head_b, f.tail_a, f.tail_b, f.pairs, f.times)), f.closed)


@pytest.mark.parametrize("seed", range(5))
def test_fragments_of_any_ranges_compose(seed):
    """Ranges cut anywhere, also inside tokens, put together in any order of brackets, give the fragment of the whole."""
    s = alignment.speller(alignment.BYTE_BPE, alignment.PIECE_BPE)
    rng = random.Random(seed)
    text = " ".join(rng.choice(ODD[:8] + ODD[10:11] + invented(seed)) for _ in range(6)).replace("▁", "")
    a, b = s.encode_a(" " + text), s.encode_b(text)
    a, b = np.array(a), np.array(b)
    ends_a, ends_b = np.cumsum(s.length_a[a]), np.cumsum(s.length_b[b])
    borders = sorted({0, int(ends_a[-1]), *(rng.randrange(1, int(ends_a[-1])) for _ in range(12))})
    parts = []
    for first, last in zip(borders, borders[1:]):
        in_a, in_b = (ends_a > first) & (ends_a <= last), (ends_b > first) & (ends_b <= last)
        parts.append(alignment.fragment(s, a[in_a], b[in_b], ends_a[in_a], ends_b[in_b]))
    whole = _plain(alignment.fragment(s, a, b, ends_a, ends_b))
    while len(parts) > 1:
        k = rng.randrange(len(parts) - 1)
        parts[k : k + 2] = [alignment.compose(s, parts[k], parts[k + 1])]
    assert _plain(parts[0]) == whole == _plain(alignment.compose(s, alignment.Fragment(), parts[0]))


def test_number_of_pairs_is_bounded_by_the_vocabularies():
    """The bound that lets the counts go to the driver: pairs with one token a suffix of the other."""
    s = alignment.speller(alignment.BYTE_BPE, alignment.PIECE_BPE)
    by_bytes = [collections.Counter(t) for t in (s.bytes_a, s.bytes_b)]
    pairs = sum(by_bytes[1][x[k:]] for x in s.bytes_a for k in range(len(x))) + sum(by_bytes[0][x[k:]] for x in s.bytes_b for k in range(1, len(x)))
    assert pairs < 1_000_000 and max(len(s.bytes_b), 1) <= 1 << alignment.B_BITS
