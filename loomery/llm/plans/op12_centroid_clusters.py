"""Sixteen clusters of all embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..centroids import cluster, with_inertia
from ..shared import table


def _round(before: str, after: str) -> str:
    """A round in SQL: assignment to the nearest of `before`, then the moved centroids as `after`."""
    return f"""{after}_near AS (
  SELECT vec_id, any_value(v) AS v, min_by(c.k, (list_sum(list_transform(list_zip(v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT, c.k)) AS k
  FROM kept, {before} c GROUP BY row, vec_id
), {after}_sums AS (
  SELECT k, i, (sum(v[i])::HUGEINT) AS total, count(*) AS n FROM {after}_near, range(1, 65) r(i) GROUP BY k, i
), {after} AS (
  SELECT c.k, coalesce(m.c, c.c) AS c FROM {before} c LEFT JOIN (
    SELECT k, list(((total - ((total % n + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM {after}_sums GROUP BY k
  ) m ON m.k = c.k
)"""


SQL = f"""
WITH numbered AS (
  SELECT vec_id, embedding, row_number() OVER () AS row FROM embeddings
), kept AS (
  SELECT row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM numbered
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, v) - 1)::INT AS k, v AS c FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, v) <= 16
), {_round("c0", "c1")}, {_round("c1", "c2")}, {_round("c2", "c3")}, last AS (
  SELECT row, vec_id, min(({{'d': list_sum(list_transform(list_zip(v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': c.k}})) AS best
  FROM kept, c3 c GROUP BY row, vec_id
)
SELECT vec_id, best.k AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c3.c, ',')) AS centroid_sha256
FROM last JOIN c3 ON c3.k = best.k
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings"))).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
