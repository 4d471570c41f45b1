"""The mix of all documents by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..mixing import mix_sources
from ..shared import table

SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5('order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS key,
         len(list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sizes GROUP BY source
), levels AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ranked
  WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT arg_min(level, cap / weight) AS level FROM levels WHERE level <= cap / weight
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM water), 'infinity'::DOUBLE) * weight) AS target,
         ('0x' || left(md5('mix:' || coalesce(source, 'null')), 8))::BIGINT % 16777216 AS u
  FROM ranked
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216 + 0.5)::BIGINT ELSE 0 END AS rate FROM targets
), placed AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.rate,
         r.u + sum(r.rate) OVER (PARTITION BY s.source
           ORDER BY length(bin(s.size)) * 8 + (s.size >> greatest(length(bin(s.size)) - 4, 0)::INT) % 8 DESC,
                    s.key
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sizes s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, (upto // 16777216 - (upto - rate) // 16777216)::BIGINT AS copies,
       ((upto // 16777216 - (upto - rate) // 16777216) * size)::BIGINT AS taken
FROM placed
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken."""
    return mix_sources(table(spark, sf_dir, "documents"))
