"""The registered queries, each over its whole table, with the SQL that must agree where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnbook.llm import alignment, compression, exact, fingerprints, languages, manifest, mixing, near, packing, repeats, secrets, toxicity, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_report(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edit_and_next(_table(spark, sf_dir, "documents"))


def op5_stream_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["number"] < len(secrets.BASE))

    def of_kind(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[of_kind(r.kind) for r in secrets.BASE],
        F.sha2(secrets.joined_spans(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("spans")).alias("spans"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(_table(spark, sf_dir, "documents"))


def op11_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.rate(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest.tampered_manifest(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(_table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n m ON m.doc_id = x JOIN n o ON o.doc_id = y WHERE 100 * c >= 75 * (m.n + o.n - c)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = d.doc_id
"""

EXACT_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS k FROM documents),
g AS (SELECT doc_id, k, first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY k) AS c FROM d)
SELECT doc_id, keep_id, c::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(k) AS text_sha256 FROM g
"""

REPEATS_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
y AS (SELECT x.doc_id, x.i, word, count(f.i) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS c
      FROM x LEFT JOIN f ON f.doc_id = x.doc_id AND f.i = x.i),
z AS (SELECT doc_id, count(*) AS n, count(*) FILTER (c > 0) AS m, string_agg(word, ' ' ORDER BY i) FILTER (c = 0) AS t FROM y GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(m, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN z ON z.doc_id = d.doc_id
"""


def _url_sql() -> str:
    cases, verdicts = [], []
    for r in sorted(url_rules.RULES, key=lambda r: -len(r.name)):
        fits = f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
        cases.append(f"WHEN {fits} THEN '{r.name}'")
        verdicts.append(f"WHEN {fits} THEN '{r.verdict}'")
    globs = " OR ".join(f"host || path GLOB '{g}'" for g in url_rules.BLOCKED_GLOBS)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format(r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    path = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    return f"""
WITH u AS (SELECT page_id, {host} AS host, {path} AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(cases)} END AS rule,
CASE {" ".join(verdicts)} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM u
"""


def _secrets_sql() -> str:
    parts = []
    for number, r in enumerate(secrets.RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {number} AS number, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {p}) AS g, "
            f"regexp_extract_all(t, {p}) AS h, regexp_extract_all(t, {p}, {r.group}) AS j FROM d"
        )
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0)::BIGINT AS n_{r.kind}" for r in secrets.BASE)
    line = "kind || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
r AS (SELECT doc_id, number, kind, least, unnest(h) AS h, unnest(g[1:len(h)]) AS g, unnest(j) AS j, unnest(range(len(h))) AS i FROM m WHERE len(h) > 0),
c AS (SELECT *, (sum(length(g) + length(h)) OVER (PARTITION BY doc_id, number ORDER BY i))::BIGINT AS e FROM r),
k AS (SELECT doc_id, number, kind, e - length(h) AS s, e FROM c WHERE length(j) >= least)
SELECT d.doc_id, {counts},
sha256(coalesce(string_agg({line}, ',' ORDER BY s, number) FILTER (number < {len(secrets.BASE)}), '')) AS base_sha256,
coalesce(string_agg({line}, ',' ORDER BY s, number), '') AS spans
FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _manifest_sql() -> str:
    def leaf(text: str) -> str:
        values = [text if f == "text" else f"{f}::VARCHAR" for f in manifest.FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    def levels(name: str, trees: str) -> str:
        return f"""
{name} AS ({trees}
  UNION ALL SELECT tree, lv + 1, i // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, lv, i // 8)"""

    def walk(name: str, nodes: str, start: str) -> str:
        return f"""
{name} AS ({start}
  UNION ALL SELECT w.r, w.tree, w.lv + 1, w.i // 8, sha256(string_agg(CASE WHEN s.i = w.i THEN w.cur ELSE s.h END, '' ORDER BY s.i)),
         w.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> w.i), '')
  FROM {name} w JOIN {nodes} s ON s.tree IS NOT DISTINCT FROM w.tree AND s.lv = w.lv AND s.i // 8 = w.i // 8
  WHERE s.n > 1 GROUP BY w.r, w.tree, w.lv, w.i, w.cur, w.proof)"""

    bit = "lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    over = """SELECT w.r, 0 AS tree, 0 AS lv, s.i, w.cur, w.proof FROM within w JOIN subroots s ON s.tree IS NOT DISTINCT FROM w.tree
  JOIN nodes m ON m.tree IS NOT DISTINCT FROM w.tree AND m.lv = w.lv AND m.n = 1"""
    return f"""
WITH RECURSIVE crc AS (
  SELECT DISTINCT doc_id, doc_id::VARCHAR AS s, 1 AS k, 4294967295::UBIGINT AS c FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT doc_id, s, k + 1, list_reduce(list_concat([xor(c, ascii(s[k])::UBIGINT)], list_transform(range(8), lambda x: x::UBIGINT)), {bit})
  FROM crc WHERE k <= length(s)),
tampered AS (SELECT doc_id FROM crc WHERE k = length(s) + 1 AND xor(c, 4294967295::UBIGINT) % 3 = 0),
d AS (SELECT doc_id, lang AS tree, {leaf("text")} AS h, CASE WHEN doc_id IN (SELECT doc_id FROM tampered) THEN {leaf(lower)} END AS c FROM documents),
placed AS (
  SELECT row_number() OVER () AS r, *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
{levels("nodes", "SELECT tree, 0 AS lv, i, n, h FROM placed")},
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{levels("tops", "SELECT 0 AS tree, 0 AS lv, i, n, h FROM subroots")},
{walk("within", "nodes", "SELECT r, tree, 0 AS lv, i, coalesce(c, h) AS cur, '' AS proof FROM placed")},
{walk("over", "tops", over)}
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, t.h AS root, sha256(o.proof) AS proof_sha256, o.cur AS folded_root, o.cur = t.h AS verified
FROM placed p JOIN subroots s ON s.tree IS NOT DISTINCT FROM p.tree JOIN tops t ON t.n = 1 JOIN over o ON o.r = p.r AND o.lv = t.lv
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_entropy_mixing,
        op2_minmax_near_dedup,
        op3_length_buckets,
        op4_multiset_fingerprint,
        op5_stream_exact_dedup,
        op6_substring_dedup,
        op7_url_filter,
        op8_secret_scan,
        op9_toxicity,
        op10_language_id,
        op11_context_mixing,
        op12_merkle_manifest,
        op13_tokenizer_alignment,
    )
}

#: The others rest on iteration, hashes or learned weights and are tested against brute force.
SQL = {
    "op2_minmax_near_dedup": NEAR_SQL,
    "op5_stream_exact_dedup": EXACT_SQL,
    "op6_substring_dedup": REPEATS_SQL,
    "op7_url_filter": _url_sql(),
    "op8_secret_scan": _secrets_sql(),
    "op12_merkle_manifest": _manifest_sql(),
}
