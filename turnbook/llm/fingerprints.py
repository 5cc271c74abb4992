"""Document fingerprints that add up: a homomorphic hash of the multiset of paragraphs.

Each paragraph hashes to a wide vector and a document's fingerprint is the sum
of its paragraphs' vectors: 8 lanes modulo 2**32 from the whole paragraph, for
equality, and 126 lanes modulo 2**21 for likeness, to which each piece of the
paragraph (up to four words) adds 0 or 1 per lane.  Sums do not depend on order, and
a paragraph is inserted or deleted by adding or subtracting its vector.  Twice
a likeness lane less the number of pieces is a sum of random signs, so the
cosine of two such vectors estimates that of the two multisets of pieces.

Everything is DataFrame expressions.  The following document is found within
blocks of 512 ids, and across blocks through the blocks' first documents, so no
task orders the whole table.

Defined cases: null texts are empty; documents that share a doc_id follow each
other in the order of their texts; rows without doc_id have no next document
(theirs counts as empty) and follow none; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.llm.stored import materialize

#: Ids per block, as a power of two.
BLOCK_BITS = 9
#: So few rows that one task may order them.
FEW = 4096
EQUAL_HASHES = 4
LIKE_HASHES = 2
#: Likeness lanes are packed by threes into longs.
LANE_BITS = 21
LANES_AT = (0, 21, 42)
LOWEST_BITS = sum(1 << at for at in LANES_AT)
LONGS = LIKE_HASHES * LANE_BITS
#: Elements that are summed in one long at most, so that no lane reaches its neighbour: texts with more are summed in parts.
PART = 1 << (LANE_BITS - 1)
WIDE = 1 << 32
#: Pieces of a paragraph: up to four words, ended by a line or by these marks.
PIECE = r"[^\s.,;:!?]+(?:[ \t]+[^\s.,;:!?]+){0,3}[.,;:!?]*"


def successors(keys: DataFrame) -> DataFrame:
    """(k, after): the next larger of the distinct numbers ``k``; the largest is followed by the smallest."""
    keys = materialize(keys.select("k"), "keys")
    everything = W.partitionBy(F.lit(0)).orderBy("k")
    if keys.count() <= FEW:
        first = F.first("k").over(everything)
        return keys.select("k", F.coalesce(F.lead("k").over(everything), first).alias("after"))
    parent = F.shiftright("k", BLOCK_BITS)
    near = keys.withColumn("parent", parent).withColumn("after", F.lead("k").over(W.partitionBy("parent").orderBy("k")))
    heads = keys.groupBy(parent.alias("parent")).agg(F.min("k").alias("head"))
    up = successors(heads.select(F.col("parent").alias("k")))
    up = up.join(heads.withColumnRenamed("parent", "after"), "after").select(F.col("k").alias("parent"), "head")
    return near.join(up, "parent").select("k", F.coalesce("after", "head").alias("after"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_id, next_text: each document with the one that follows it, the last with the first."""
    named = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("block", F.shiftright("doc_id", BLOCK_BITS))
    heads = named.groupBy("block").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    heads = materialize(heads, "heads")
    order = successors(heads.select(F.col("block").alias("k")))
    over = order.join(heads.withColumnRenamed("block", "after"), "after").select(F.col("k").alias("block"), "head")
    w = W.partitionBy("block").orderBy("doc_id", "text")
    follow = named.withColumns({"next_id": F.lead("doc_id").over(w), "next_text": F.lead("text").over(w)})
    joined = follow.alias("d").join(over.alias("o"), (F.col("d.block") == F.col("o.block")) & F.col("d.next_id").isNull(), "left")
    joined = joined.select("doc_id", "text", F.coalesce("next_id", "head.doc_id").alias("next_id"), F.coalesce("next_text", "head.text").alias("next_text"))
    alone = docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return joined.unionByName(alone.select("doc_id", "text", F.lit(None).cast("bigint").alias("next_id"), F.lit("").alias("next_text")))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of ``text`` replaced by as much of the start of ``following``."""
    n = F.char_length(text)
    k = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def elements(text: Column) -> Column:
    """Tagged elements: whole paragraphs (P) and their pieces (S); an empty text has none."""
    paragraphs = F.transform(F.split(text, "\n"), lambda p: F.concat(F.lit("P"), p))
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), 0), lambda p: F.concat(F.lit("S"), p))
    return F.when(text != "", F.concat(paragraphs, pieces)).otherwise(F.array().cast("array<string>"))


def _lane_sums() -> list[Column]:
    whole = F.col("e").startswith("P")
    columns = [F.sum(F.when(~whole, 1).otherwise(0)).alias("pieces")]
    for i in range(EQUAL_HASHES):
        h = F.xxhash64(F.lit(i), "e")
        for j, part in enumerate((h.bitwiseAND(F.lit(WIDE - 1)), F.shiftrightunsigned(h, 32))):
            columns.append(F.sum(F.when(whole, part).otherwise(F.lit(0).cast("bigint"))).alias(f"q{2 * i + j}"))
    for i in range(LIKE_HASHES):
        h = F.xxhash64(F.lit(EQUAL_HASHES + i), "e")
        for j in range(LANE_BITS):
            bit = F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LOWEST_BITS))
            columns.append(F.sum(F.when(~whole, bit).otherwise(F.lit(0).cast("bigint"))).alias(f"s{LANE_BITS * i + j}"))
    return columns


def printed(equal: Column, like: Column) -> Column:
    """Fixed-width hexadecimal of all lanes, equality lanes first."""
    of = lambda lanes, width: F.array_join(F.transform(lanes, lambda v: F.lpad(F.hex(v), width, "0")), "")
    return F.lower(F.concat_ws("-", of(equal, 8), of(like, 16)))


def _unpacked(packed: Column) -> Column:
    """The lanes of packed longs: all lowest ones, then all middle ones, then all top ones."""

    def lane(at: int) -> Column:
        return F.transform(packed, lambda v: F.shiftrightunsigned(v, at).bitwiseAND(F.lit((1 << LANE_BITS) - 1)))

    return F.concat(*[lane(at) for at in LANES_AT])


def signs(pieces: Column, packed: Column, whole: Column) -> Column:
    """Likeness lanes as centred numbers, twice the lane less the number of pieces; ``whole`` has the lanes that could wrap."""
    return F.transform(F.coalesce(whole, _unpacked(packed)), lambda v: (v * 2 - pieces).cast("double"))


def lane_sums(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, pieces, equal, like, whole of a table of (keys, text); rows with equal keys are added up, and lanes wrap at their power of two.

    ``whole`` has the likeness lanes as they were before they wrapped, where a text or row is long enough for that; else it is null.
    """
    # A piece and a line end have a character each, so a short text has at most PART elements.
    # The flag is a column before the elements are made, so that no element carries its text.
    flagged = texts.withColumn("_long", F.char_length("text") >= PART)
    rows = flagged.select(*keys, "_long", F.posexplode_outer(elements(F.col("text"))).alias("pos", "e"))
    part = F.when(F.col("_long"), F.expr(f"pos div {PART}"))
    sums = materialize(rows.withColumn("part", part).groupBy(*keys, "part").agg(*_lane_sums()), "lanes")
    equal = F.array(*[F.coalesce(F.col(f"q{i}"), F.lit(0)) % WIDE for i in range(2 * EQUAL_HASHES)])
    packed = F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0)) for i in range(LONGS)])
    pieces = F.coalesce("pieces", F.lit(0)).alias("pieces")
    short = sums.where("part is null").select(*keys, pieces, equal.alias("equal"), packed.alias("like"), F.lit(None).cast("array<bigint>").alias("whole"))
    lanes = [F.sum(F.shiftrightunsigned(f"s{i}", at).bitwiseAND(F.lit((1 << LANE_BITS) - 1))).alias(f"w{at}_{i}") for at in LANES_AT for i in range(LONGS)]
    added = sums.where("part is not null").groupBy(*keys).agg(
        F.sum("pieces").alias("pieces"), *[F.sum(f"q{i}").alias(f"q{i}") for i in range(2 * EQUAL_HASHES)], *lanes
    )
    whole = F.array(*[F.col(f"w{at}_{i}") for at in LANES_AT for i in range(LONGS)])
    wrapped = lambda at, i: F.shiftleft(F.col(f"w{at}_{i}").bitwiseAND(F.lit((1 << LANE_BITS) - 1)), at)
    like = F.array(*[wrapped(LANES_AT[0], i).bitwiseOR(wrapped(LANES_AT[1], i)).bitwiseOR(wrapped(LANES_AT[2], i)) for i in range(LONGS)])
    return short.unionByName(added.select(*keys, pieces, equal.alias("equal"), like.alias("like"), whole.alias("whole")))


def fingerprints(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, fingerprint, signs of a table of (keys, text)."""
    return lane_sums(texts, *keys).select(*keys, printed(F.col("equal"), F.col("like")).alias("fingerprint"), signs(F.col("pieces"), F.col("like"), F.col("whole")).alias("signs"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two sign vectors, from 0 to 1; two empty ones are alike."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), cosine)))


def compare_with_edit_and_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_text's sha256, both fingerprints, and the likeness to the edited text and to the next document."""
    both = with_next(docs).withColumn("row_id", F.monotonically_increasing_id())
    text, other = F.col("text"), edited(F.col("text"), F.col("next_text"))
    versions = F.array(
        F.struct(F.lit(0).alias("version"), text.alias("text")),
        F.struct(F.lit(1).alias("version"), other.alias("text")),
    )
    rows = both.select("row_id", "doc_id", "next_id", F.xxhash64("text").alias("own"), F.xxhash64("next_text").alias("follow"), F.explode(versions).alias("v"))
    rows = rows.select("row_id", "doc_id", "next_id", "own", "follow", "v.version", "v.text")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("bigint"))
    rows = rows.withColumn("sha", F.when(F.col("version") == 1, F.sha2(F.col("text").cast("binary"), 256)))
    keys = ("row_id", "version", "doc_id", "own", "next_id", "follow", "n_chars", "sha")
    sums = lane_sums(rows, *keys)
    lanes = F.struct("pieces", "equal", "like", "whole").alias("lanes")
    first = sums.where("version = 0").select("row_id", "doc_id", "own", "next_id", "follow", "n_chars", lanes)
    second = sums.where("version = 1").select("row_id", F.col("sha").alias("edited_sha256"), lanes.alias("edited"))
    follower = first.groupBy(F.col("doc_id").alias("next_id"), F.col("own").alias("follow")).agg(F.first("lanes").alias("after"))
    out = first.join(second, "row_id").join(follower, ["next_id", "follow"], "left")
    of = lambda c: signs(F.coalesce(f"{c}.pieces", F.lit(0)), F.coalesce(f"{c}.like", F.array_repeat(F.lit(0).cast("bigint"), LONGS)), F.col(f"{c}.whole"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("lanes.equal"), F.col("lanes.like")).alias("fingerprint"),
        printed(F.col("edited.equal"), F.col("edited.like")).alias("edited_fingerprint"),
        likeness(of("lanes"), of("edited")).alias("near_edited"),
        likeness(of("lanes"), of("after")).alias("near_next"),
    )
