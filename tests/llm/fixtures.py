"""Small tables with every awkward case, and plain Python versions of shared notions."""

from __future__ import annotations

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")

#: doc_id, text, lang, source, n_chars and columns whose names the operators use inside.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, label string, rep string, "
    "digest string, kept string, row_id string, anchor string, marks string, copies string, target string, key string, length string"
)


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def third(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


def rows_of(texts, first=0, lang=None, source=None):
    """Rows for SCHEMA; texts are values or (doc_id, text) pairs."""
    out = []
    for i, t in enumerate(texts, first):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        out.append((doc_id, text, lang, source if source is not None else f"s{i % 3}", None, 7, "x", "x", "x", "x", "x", "x", "x", "x", "x", "x", "x"))
    return out


def table(spark, texts, **more):
    return spark.createDataFrame(rows_of(texts, **more), SCHEMA)


def invented(seed=1, n=60, vocabulary=300, longest=90):
    """Random texts with exact copies, near copies, shared passages and odd white space."""
    rng = random.Random(seed)
    lexicon = ["".join(rng.choice("abcdeéßñAB") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    text = lambda k: [rng.choice(lexicon) for _ in range(k)]
    passage = text(40)
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            body = text(rng.randint(1, longest))
        elif kind == 1:
            body = list(rng.choice(out))
        elif kind in (2, 3):
            body = list(rng.choice(out))
            for _ in range(rng.randint(1, 3)):
                body[rng.randrange(len(body))] = rng.choice(lexicon)
        elif kind == 4:
            body = text(rng.randint(0, 30)) + passage + text(rng.randint(0, 30))
        else:
            body = [rng.choice(lexicon[:2])] * rng.randint(1, 60)
        out.append(body or ["x"])
    gaps = [" ", "\n", "  ", "\t", "\r\n", "\x0b\x0c"]
    return [("" if rng.random() < 0.8 else rng.choice(gaps)) + "".join(w + rng.choice(gaps) for w in body) for body in out]


AWKWARD = [None, "", "   \n\t ", "a", "A", "one two three", "one two  three", "\u00a0", "é" * 40, "x " * 30000, "x " * 30000, "12 34 !!", None]
