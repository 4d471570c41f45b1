"""Benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..positional_index import contamination
from ..shared import table

SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bi)
), lens AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id
), places AS (
  SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS i FROM dw
), counted AS (
  SELECT term, count(*) AS c FROM places GROUP BY term
), kinds AS (
  SELECT g, any_value(item_id) AS any_item FROM windows GROUP BY g
), wanted AS (
  SELECT DISTINCT g, unnest(g) AS term FROM kinds
), anchors AS (
  SELECT g, count(*) AS n, arg_min(term, (c, term)) AS anchor FROM wanted LEFT JOIN counted USING (term) GROUP BY g HAVING count(*) = count(c)
), tried AS (
  SELECT g, n, doc_id, i FROM anchors JOIN places ON term = anchor
), close_by AS (
  SELECT tried.g, tried.doc_id FROM tried JOIN wanted ON wanted.g = tried.g JOIN places p ON p.doc_id = tried.doc_id AND p.term = wanted.term AND abs(p.i - tried.i) <= 26
  GROUP BY tried.g, tried.doc_id, tried.i, n HAVING count(DISTINCT p.term) = n
), near_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near FROM close_by JOIN windows ON windows.g = close_by.g GROUP BY doc_id
)
SELECT dw.doc_id, coalesce(len(dw.w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(dw.w), 0) AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near_items
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near_items USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items (windows in any order, within twice their length)."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=26).drop("spans", "items", "near_items")
