"""How the sources of each language diverge in their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..divergence import source_divergence
from ..shared import table

SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), sizes AS (
  SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL
), vocabulary AS (
  SELECT g.lang, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v, sum(n) AS whole FROM sizes g GROUP BY g.lang
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * v)::HUGEINT AS p
  FROM sizes g JOIN vocabulary USING (lang) JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), overall AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c) + 5)) // (any_value(whole) + 5 * any_value(v))::HUGEINT AS q FROM shares JOIN vocabulary USING (lang) GROUP BY lang, term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares JOIN overall USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, source, part, item, value, rank."""
    return source_divergence(table(spark, sf_dir, "documents"))
