"""URL filter: all glob rules run at once as one bit-parallel Shift-And automaton.

Every rule becomes globs over the canonical URL: host, ``#``, path, neither of
which can hold a ``#``, so a rule's host and path match theirs alone.  The
patterns' states are packed one after another into 64-bit words; a step for
one character is a shift, an AND with the character's mask and an OR with the
states that a star keeps alive, for all URLs of a batch at once.

A rule (host, path) fits its host and all subdomains if the path starts with
its path; the longest fitting rule wins, of equal length the first.  Where none
fits, the wildcard lists below decide: blocked if one of them matches.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is allowed; very long URLs are matched whole; rows that repeat
are judged alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, functions as F


#: Between host and path; occurs in neither.
BORDER = "#"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.host}{BORDER}{self.path}*", f"*.{self.host}{BORDER}{self.path}*"


#: The rules of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Where no rule fits: machine-made and tracking addresses are blocked.
BLOCKED_GLOBS = ("ads.*", "*.ads.*", "*/cgi-bin/*", "*/wp-login*", "*.exe", "*.zip")

OTHER = 128  # class of all characters that no pattern names


class ShiftAnd:
    """Globs (``*`` any run, ``?`` one character) packed into rows of 64-bit words.

    The last ``blind`` globs match as if the texts had no BORDER.
    """

    def __init__(self, globs: tuple[str, ...], blind: int = 0):
        self.globs = globs
        lengths, bit = [], 0
        starts, accepts, loops, takes = [], [], [], []
        for glob in globs:
            starts.append(bit)
            for c in glob:
                if c == "*":
                    loops.append(bit)
                else:
                    bit += 1
                    takes.append((c, bit))
            accepts.append(bit)
            bit += 1
            lengths.append(bit)
        self.words = (bit + 63) // 64
        # Pattern characters outside ASCII get classes above OTHER.
        self.extra = {c: OTHER + 1 + i for i, c in enumerate(sorted({c for c, _ in takes if c != "?" and ord(c) >= 128}))}
        self.masks = np.zeros((OTHER + 1 + len(self.extra), self.words), dtype=np.uint64)
        for c, at in takes:
            rows = slice(None) if c == "?" else self._class(c)
            self.masks[rows, at // 64] |= np.uint64(1 << at % 64)
        # States that stay where they are, by class of the character.
        self.loop = np.tile(self._bits(loops), (len(self.masks), 1))
        if blind:
            first = starts[len(globs) - blind]
            unseen = self._bits(list(range(first, bit)))
            self.loop[ord(BORDER)] |= unseen
            self.masks[ord(BORDER)] &= ~unseen
        self.start = self._bits(starts)
        self.accept = np.array(accepts)

    def _class(self, c: str) -> int:
        return ord(c) if ord(c) < 128 else self.extra.get(c, OTHER)

    def _bits(self, places: list[int]) -> np.ndarray:
        out = np.zeros(self.words, dtype=np.uint64)
        for at in places:
            out[at // 64] |= np.uint64(1 << at % 64)
        return out

    def matches(self, texts: list[str]) -> np.ndarray:
        """Which text matches which glob as a whole, as a table of booleans."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        classes = np.where(codes < 128, codes, OTHER).astype(np.int64)
        for c, k in self.extra.items():
            classes[codes == ord(c)] = k
        first = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = -lengths[order]
        state = np.broadcast_to(self.start, (len(texts), self.words)).copy()
        for i in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(sorted_lengths, -i, side="left"))  # texts longer than i come first
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            at = classes[first[:live] + i]
            state[:live] = (moved & self.masks[at]) | (now & self.loop[at])
        out = np.empty((len(texts), len(self.globs)), dtype=bool)
        out[order] = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & np.uint64(1) == 1
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, blocked: tuple[str, ...] = BLOCKED_GLOBS) -> DataFrame:
    """One row per page: page_id, host, path, rule (null where none fits), verdict."""
    globs = tuple(g for r in rules for g in r.globs()) + blocked
    ranks = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd(globs, blind=len(blocked))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hit = automaton.matches([h + BORDER + p for h, p in zip(hosts, paths)])
            fits = hit[:, 0 : 2 * len(rules) : 2] | hit[:, 1 : 2 * len(rules) : 2]
            best = np.full(len(hosts), -1)
            for i in reversed(ranks):
                best[fits[:, i]] = i
            method = np.where(hit[:, 2 * len(rules) :].any(axis=1), "block", "allow")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("host"),
                    batch.column("path"),
                    pa.array([rules[i].name if i >= 0 else None for i in best], pa.string()),
                    pa.array([rules[i].verdict if i >= 0 else str(m) for i, m in zip(best, method)], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return split.mapInArrow(run_batches, "page_id bigint, host string, path string, rule string, verdict string")
