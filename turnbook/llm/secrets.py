"""Secret scan with a trigram inverted index.

From every rule's regular expression a Boolean query over trigrams is derived
on the driver: the strings that each stretch of the expression can spell give
alternatives of trigrams that must all be present.  The index lists, for each
trigram that some rule can ask for, the documents whose lower-cased text has
it; postings are intersected per alternative, and only the candidates are
matched against the rule.  A rule without a mandatory trigram scans all texts.

Matching is done by ``split`` and ``regexp_extract_all`` alone: gaps and hits
alternate, so running sums of their lengths are the offsets.

Defined cases: null texts are empty; rows without doc_id are scanned like the
others; rows that share a doc_id are candidates together and matched one by
one; further columns are ignored.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.llm.stored import materialize

#: Strings that a stretch of an expression may spell before it counts as open.
MOST_STRINGS = 48


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost and without overlap; a match counts if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The rules of the contract, in its order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Rules this library adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + ADDED


def _spelled(node) -> set[str] | None:
    """All strings an element of a parsed expression can match, or None if there are too many."""
    op, value = node
    if op is ops.LITERAL:
        return {chr(value).lower()}
    if op is ops.IN:
        found: set[str] = set()
        for kind, v in value:
            if kind is ops.LITERAL:
                found.add(chr(v).lower())
            elif kind is ops.RANGE and v[1] - v[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if op is ops.SUBPATTERN:
        return _all_of(value[-1])
    if op is ops.BRANCH:
        parts = [_all_of(x) for x in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and value[:2] == (0, 1):
        inner = _all_of(value[2])
        return None if inner is None else inner | {""}
    return None


def _all_of(sequence) -> set[str] | None:
    strings = {""}
    for node in sequence:
        own = _spelled(node)
        if own is None or len(strings) * len(own) > MOST_STRINGS:
            return None
        strings = {a + b for a, b in product(strings, own)}
    return strings


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams of which one must be present in full; empty if nothing is mandatory."""
    clauses, run = [], {""}

    def close():
        alternatives = {trigrams(s) for s in run}
        if all(alternatives):
            # An alternative that contains another adds nothing.
            clauses.append([a for a in alternatives if not any(b < a for b in alternatives)])

    for node in parser.parse(pattern):
        own = _spelled(node)
        if own is None or len(run) * len(own) > MOST_STRINGS:
            close()
            run = {""} if own is None else own
        else:
            run = {a + b for a, b in product(run, own)}
    close()
    if not clauses:
        return []
    return sorted({frozenset().union(*pick) for pick in product(*clauses)}, key=sorted)


def trigram_postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(trigram, doc_id) of the wanted trigrams in the lower-cased texts."""
    lowered = F.lower(F.coalesce(F.col("text"), F.lit("")))
    listed = F.array(*[F.lit(t) for t in wanted])
    rows = docs.select("doc_id", lowered.alias("lowered"))
    return rows.select("doc_id", F.explode(F.filter(listed, lambda t: F.contains(F.col("lowered"), t))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds): for which rules with mandatory trigrams a document has to be matched."""
    spark = docs.sparkSession
    plan = [(r.kind, n, t, len(alt)) for r in rules for n, alt in enumerate(trigram_query(r.pattern)) for t in sorted(alt)]
    wanted = sorted({t for _, _, t, _ in plan})
    index = materialize(trigram_postings(docs, wanted), "postings") if wanted else spark.createDataFrame([], "doc_id bigint, trigram string")
    # A few rows per rule, whatever the data.
    asked = F.broadcast(spark.createDataFrame(plan, "kind string, alternative int, trigram string, needed int"))
    met = index.join(asked, "trigram").groupBy("doc_id", "kind", "alternative", "needed").agg(F.count_distinct("trigram").alias("n"))
    return met.where("n = needed").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _hits(text: Column, number: int, rule: Rule) -> Column:
    """Per match: (kind number, index, gap before it, its length, whether it counts)."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    at = F.sequence(F.lit(0), F.size(found) - 1)
    rows = F.transform(
        at,
        lambda i: F.struct(
            F.lit(number).alias("number"),
            i.alias("i"),
            F.char_length(F.get(gaps, i)).alias("gap"),
            F.char_length(F.get(found, i)).alias("length"),
            (F.char_length(F.get(judged, i)) >= rule.least).alias("counts"),
        ),
    )
    return F.when(F.size(found) > 0, rows).otherwise(F.array().cast("array<struct<number:int,i:int,gap:int,length:int,counts:boolean>>"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id and spans, an array of (start, number, end, kind) in order.

    Offsets are code points, ends exclusive; ``number`` is the rule's place in ``rules``.
    """
    queried = {r.kind for r in rules if trigram_query(r.pattern)}
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = F.coalesce(F.col("kinds"), F.array().cast("array<string>"))
    slim = docs.select("doc_id", "text").alias("d")
    tried = candidates(docs, rules).alias("c")
    joined = slim.join(tried, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left").select("d.doc_id", text.alias("text"), kinds.alias("kinds"))
    joined = joined.withColumn("row_id", F.monotonically_increasing_id())
    nothing = F.array().cast("array<struct<number:int,i:int,gap:int,length:int,counts:boolean>>")
    per_rule = [
        F.when(F.array_contains("kinds", r.kind), _hits(F.col("text"), n, r)).otherwise(nothing) if r.kind in queried else _hits(F.col("text"), n, r)
        for n, r in enumerate(rules)
    ]
    rows = joined.select("row_id", "doc_id", F.explode_outer(F.concat(*per_rule)).alias("h")).select("row_id", "doc_id", "h.*")
    w = W.partitionBy("row_id", "number").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.col("length")).over(w)
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = rows.withColumn("end", end).select(
        "row_id",
        "doc_id",
        F.when(
            F.col("counts"),
            F.struct((F.col("end") - F.col("length")).alias("start"), "number", "end", F.get(names, F.col("number")).alias("kind")),
        ).alias("span"),
    )
    return spans.groupBy("row_id", "doc_id").agg(F.sort_array(F.collect_list("span")).alias("spans")).select("doc_id", "spans")


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
