"""Merkle manifest of a table as a persistent tree: versions copy the ancestors of a leaf and share all other nodes.

A row's leaf is the digest of its fields.  The leaves of a tree (a language)
ascend by their key; every eight consecutive nodes become their digest until one
is left, the subroot, and the subroots become the root in the same way.  A
changed row is a version of the tree: only its ancestors are computed anew,
first inside its aligned block of 512 leaves, then along the upper levels, whose
siblings it shares with the untampered tree.

Places come from ranges of the ordered rows and the sizes of the ranges before
them; blocks of 512 nodes are grouped, and their tops are nodes of the next
round, so that no task sees more than one range or block of a tree, however
large the tree is.  Digests are lowercase hexadecimal text throughout.

Defined cases: a null field counts as ``-`` and an empty one as ``0:``; texts of
any length are hashed whole in the JVM; rows without a tree name form a tree of
their own, which comes first; rows without key come first in their tree, and
rows that share a key follow each other in the order of their leaves, so rows
that repeat keep their own places; a tree of one leaf is its own subroot; an
empty table has no rows in the result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnbook.llm.stored import materialize

ARITY = 8
#: Levels of a block: ARITY ** BLOCK_LEVELS = 2 ** BLOCK_BITS nodes.
BLOCK_LEVELS = 3
BLOCK_BITS = 9
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    """UTF-8 length, a colon and the value; ``-`` for null."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """Lower case for A to Z alone."""
    return F.translate(text, UPPER, LOWER)


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def numbered(rows: DataFrame, tree: str, by: list[str]) -> DataFrame:
    """Adds ``at``, the place of a row in its tree, and ``n``, the size of the tree; (tree, by) tells rows apart."""
    ranged = rows.repartitionByRange(tree, *by).sortWithinPartitions(tree, *by).withColumn("_m", F.monotonically_increasing_id())
    ranged = ranged.withColumns({"_part": F.shiftright("_m", 33), "_local": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")
    ranged = materialize(ranged, "ranges")
    sizes = ranged.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_range")).agg(
        F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per tree and range.
    own = W.partitionBy("_tree")
    sizes = sizes.withColumns({"_before": F.sum("_rows").over(own.orderBy("_range")) - F.col("_rows"), "n": F.sum("_rows").over(own)})
    placed = ranged.join(sizes, _same(tree, "_tree") & (F.col("_part") == F.col("_range")))
    placed = placed.withColumn("at", F.col("_before") + F.col("_local") - F.col("_first"))
    return placed.drop("_tree", "_range", "_first", "_rows", "_before", "_part", "_local")


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def ascend(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a block, level by level."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest_of("".join(nodes[k : k + ARITY])) for k in range(0, len(nodes), ARITY)]
        out.append(nodes)
    return out


def siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(before, after) of a leaf and its ancestors within their runs, below the top of the block."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % ARITY
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + ARITY])))
        at //= ARITY
    return out


def copied(digest: str, path: list[tuple[str, str]]) -> list[str]:
    """The ancestors of a changed leaf, upwards: all that its version does not share."""
    out = []
    for before, after in path:
        digest = digest_of(before + digest + after)
        out.append(digest)
    return out


def _blocks(nodes: DataFrame, *fields: str) -> DataFrame:
    """One row per aligned block of a tree: at most 512 nodes in order."""
    grouped = nodes.groupBy("tree", "n", F.shiftright("at", BLOCK_BITS).alias("block"))
    return materialize(grouped.agg(F.sort_array(F.collect_list(F.struct("at", *fields))).alias("nodes")), "blocks")


def _per_block(make: Callable[[dict], Iterator[dict]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One block at a time: their nodes become Python objects.
            for k in range(batch.num_rows):
                rows = list(make(batch.slice(k, 1).to_pylist()[0]))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _levels(block: dict) -> list[list[str]]:
    return ascend([x["digest"] for x in block["nodes"]], min(BLOCK_LEVELS, depth(block["n"])))


PATH_TYPE = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _as_path(pairs: list[tuple[str, str]]) -> list[dict]:
    return [{"before": b, "after": a} for b, a in pairs]


def paths(nodes: DataFrame) -> DataFrame:
    """tree, at, top, path for nodes (tree, at, n, digest): the siblings from each node to the top of its tree.

    Every round takes three levels and leaves a 512th of the nodes.
    """
    blocks = _blocks(nodes, "digest")
    above = _above(blocks)
    tree_type = nodes.schema["tree"].dataType.simpleString()

    def make(b: dict) -> Iterator[dict]:
        levels, shared = _levels(b), [(x["before"], x["after"]) for x in b["path"]]
        for i, x in enumerate(b["nodes"]):
            yield {"tree": b["tree"], "at": x["at"], "top": b["top"], "path": _as_path(siblings(levels, i) + shared)}

    schema = pa.schema([("tree", _arrow(tree_type)), ("at", pa.int64()), ("top", pa.string()), ("path", PATH_TYPE)])
    joined = blocks.join(above, _same("tree", "of_tree") & (F.col("block") == F.col("of_block"))).drop("of_tree", "of_block")
    return joined.mapInArrow(_per_block(make, schema), f"tree {tree_type}, at bigint, top string, path {PATH}")


def _above(blocks: DataFrame) -> DataFrame:
    """of_tree, of_block, top, path: what lies above each block of a tree."""
    tree_type = blocks.schema["tree"].dataType.simpleString()
    schema = pa.schema([("tree", _arrow(tree_type)), ("at", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def make(b: dict) -> Iterator[dict]:
        yield {"tree": b["tree"], "at": b["block"], "n": -(-b["n"] >> BLOCK_BITS), "digest": _levels(b)[-1][0]}

    tops = blocks.mapInArrow(_per_block(make, schema), f"tree {tree_type}, at bigint, n bigint, digest string")
    tops = materialize(tops, "tops")
    most = tops.agg(F.max("n")).first()[0]
    if most is not None and most > 1:
        up = materialize(paths(tops), "paths")
    else:
        up = tops.select("tree", "at", F.col("digest").alias("top"), F.array().cast(PATH).alias("path"))
    return up.select(F.col("tree").alias("of_tree"), F.col("at").alias("of_block"), "top", "path")


def _arrow(simple: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[simple]


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", key: str = "doc_id", changes: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: its key, leaf, subroot, root, path, and the version its change makes.

    ``changes`` gives other values for some fields of the rows ``where`` holds
    for.  ``version`` has the digests that a changed row's version does not
    share, from its own leaf up to the root; it is null for other rows.
    ``folded_root`` is the root computed from the changed leaf, or from the
    original one, and the shared siblings.
    """
    changes = changes or {}
    own = leaf([F.col(f) for f in fields])
    altered = F.when(F.lit(False) if where is None else where, leaf([changes.get(f, F.col(f)) for f in fields]))
    # Equal leaves are told apart by their place in the input, so that a row that repeats very often still spreads over ranges.
    rows = docs.select(F.col(tree).cast("string").alias("tree"), F.col(key).cast("bigint").alias("key"), own.alias("digest"), altered.alias("changed"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    blocks = _blocks(numbered(rows, "tree", ["key", "digest", "row"]), "key", "digest", "changed")
    within = materialize(_above(blocks), "within")

    subroots = within.groupBy(F.col("of_tree").alias("name")).agg(F.first("top").alias("digest"))
    ordered = numbered(subroots.withColumn("tree", F.lit(0)), "tree", ["name"])
    ordered = materialize(ordered, "subroots")
    over = paths(ordered.select("tree", "at", "n", "digest")).select("at", F.col("top").alias("root"), F.col("path").alias("over"))
    over = ordered.select("name", "at").join(over, "at").drop("at")
    above = within.join(over, _same("of_tree", "name")).select("of_tree", "of_block", F.col("top").alias("subroot"), "root", F.concat("path", "over").alias("path"))

    joined = blocks.join(above, _same("tree", "of_tree") & (F.col("block") == F.col("of_block"))).drop("of_tree", "of_block")
    names = ("leaf", "subroot", "root", "proof", "folded_root")
    schema = pa.schema([("key", pa.int64()), *[(n, pa.string()) for n in names], ("version", pa.list_(pa.string())), ("verified", pa.bool_())])

    def make(b: dict) -> Iterator[dict]:
        levels, shared = _levels(b), [(x["before"], x["after"]) for x in b["path"]]
        for i, x in enumerate(b["nodes"]):
            path = siblings(levels, i) + shared
            version = [x["changed"] or x["digest"]]
            version += copied(version[0], path)
            yield {
                "key": x["key"], "leaf": x["digest"], "subroot": b["subroot"], "root": b["root"],
                "proof": digest_of("".join(s for pair in path for s in pair)),
                "folded_root": version[-1], "version": version if x["changed"] else None, "verified": version[-1] == b["root"],
            }

    ddl = "key bigint, " + ", ".join(f"{n} string" for n in names) + ", version array<string>, verified boolean"
    return materialize(joined.mapInArrow(_per_block(make, schema), ddl), "manifest").withColumnRenamed("key", key)


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, tampered with where 3 divides the crc32 of the id: the text's A to Z in lower case."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return manifest(docs, changes={"text": lowered(F.col("text"))}, where=tampered)
