"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from sonorel.llm import license_scan

MODULES = {
    "op1_curve_packing": ("documents", "packing", "pack"),
    "op2_ftrl_language": ("documents", "langid", "identify"),
    "op3_weak_pii": ("documents", "pii", "find"),
    "op4_diagonal_licences": ("documents", "license_scan", "scan"),
    "op5_cover_tree_dedup": ("embeddings", "cover_tree", "linked_vectors"),
    "op6_salvaged_warc": ("pages", "warc", "round_trip"),
    "op7_word_bpe": ("documents", "word_bpe", "round_trips"),
    "op8_edit_counts": ("documents", "edit_counts", "count_edits"),
    "op9_one_bit_codes": ("embeddings", "rabitq", "nearest"),
    "op10_hyperminhash": ("documents", "hyperminhash", "near_duplicates"),
}

COMPONENTS = """
label(a, b) AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (
    SELECT a, a FROM label UNION SELECT l.a, r.root FROM reach r JOIN label l ON l.b = r.node
),
lowest AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
"""

OP10_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
    FROM words
),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
    JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 85 * (m.n + n.n - count(*))
),
{COMPONENTS}
SELECT s.doc_id, s.n AS n_shingles, coalesce(l.root, s.doc_id) AS component_id, s.doc_id = coalesce(l.root, s.doc_id) AS kept
FROM sizes s LEFT JOIN lowest l ON l.node = s.doc_id
"""

OP5_SQL = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
{COMPONENTS},
degree AS (SELECT a, count(*) AS n FROM label GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(l.root, e.vec_id) AS component_id, e.vec_id = coalesce(l.root, e.vec_id) AS kept
FROM embeddings e LEFT JOIN lowest l ON l.node = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(p.sha, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN f USING (sha)
"""

OP9_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
m AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
s AS (
    SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) AS score
    FROM m a JOIN m b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _query(table: str, module: str, function: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        operator = getattr(importlib.import_module(f"sonorel.llm.{module}"), function)
        return operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return run


def queries() -> dict:
    return {name: _query(*where) for name, where in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_diagonal_licences": license_scan.sql(), "op5_cover_tree_dedup": OP5_SQL, "op6_salvaged_warc": OP6_SQL, "op9_one_bit_codes": OP9_SQL, "op10_hyperminhash": OP10_SQL}
