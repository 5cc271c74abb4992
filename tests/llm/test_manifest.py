"""The Merkle manifest against a tree of plain lists."""

from __future__ import annotations

import hashlib
import zlib

import pytest

import compare
from fixtures import AWKWARD, SCHEMA, invented, lowered, rows_of, table
from turnbook.llm import manifest, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        out.append(nodes)
    return out


def expected(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    trees = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        changed = leaf_of((*r[:4], None if r[4] is None else lowered(r[4]))) if tampered else None
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), changed or ""))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    trees = {n: sorted(trees[n]) for n in names}
    within = {n: levels_of([x[2] for x in trees[n]]) for n in names}
    over = levels_of([within[n][-1][0] for n in names])
    out = []
    for j, n in enumerate(names):
        for i, (known, doc_id, leaf, changed) in enumerate(trees[n]):
            h, proof = changed or leaf, ""
            for levels, at in ((within[n], i), (over, j)):
                for nodes in levels[:-1]:
                    first = at - at % 8
                    before, after = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])
                    h, proof, at = sha(before + h + after), proof + before + after, at // 8
            out.append((doc_id if known else None, leaf, within[n][-1][0], over[-1][0], sha(proof), h, h == over[-1][0]))
    return sorted(out, key=repr)


def got(docs):
    out = manifest.tampered_manifest(docs)
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect()), key=repr)


def fields(docs):
    return [tuple(r) for r in docs.select(*manifest.FIELDS).collect()]


def test_awkward_rows(spark):
    """Nulls, empty and long texts, ids that repeat or are missing, rows that repeat, a language of one row, one without name."""
    rows = rows_of(AWKWARD, lang="aa") + rows_of([(4, "Same"), (4, "Same"), (4, "Other"), (None, "No id"), (None, None)], first=90, lang="aa")
    rows += rows_of(["Alone"], first=500, lang="é") + rows_of(invented(n=20), first=600, source="ü:1")
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(docs) == expected(fields(docs))


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 513, 4100])
def test_trees_of_many_sizes(spark, n):
    """Runs that end on a border or one past it, below and above one block."""
    docs = table(spark, [f"Text {i}" for i in range(n)], lang="l")
    assert got(docs) == expected(fields(docs))


def test_many_trees(spark):
    rows = [r for i in range(70) for r in rows_of([f"T{i}", None], first=2 * i, lang=f"l{i}")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(docs) == expected(fields(docs))


def test_a_version_shares_all_but_the_ancestors(spark):
    docs = table(spark, [f"Text {i}" for i in range(1000)], lang="l")
    rows = manifest.tampered_manifest(docs).collect()
    changed = [r for r in rows if r["version"] is not None]
    # Four levels below the subroot, which is the root.
    assert changed and all(len(r["version"]) == 5 and r["version"][-1] == r["folded_root"] for r in changed)
    assert all(r["version"] is not None or r["verified"] for r in rows) and not any(r["verified"] for r in changed)


def test_long_text_and_empty_table(spark):
    docs = spark.range(1).selectExpr("id AS doc_id", "repeat('Ab ', 3000000) AS text", "'l' AS lang", "'s' AS source", "1L AS n_chars")
    assert got(docs)[0][1] == leaf_of((0, "s", "l", 1, "Ab " * 3000000))
    assert got(table(spark, [])) == []


def test_query_against_its_sql(spark, sf_dir):
    name = "op12_merkle_manifest"
    assert compare.differences(queries.QUERIES[name](spark, sf_dir), compare.connect(sf_dir), queries.SQL[name]) == []
