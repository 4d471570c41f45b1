"""Host and path rules over every page url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import table
from ..url_rules import ALLOW, BLOCK, HostRule, judge_urls

RULES = [
    HostRule(ALLOW, "com", "/"),
    HostRule(BLOCK, "example.com", "/en/"),
    HostRule(ALLOW, "www.example.com", "/en/"),
    HostRule(BLOCK, "net", "/es/"),
    HostRule(BLOCK, "net", "/fr/"),
]

SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT p.*, (SELECT max_by(struct_pack(rule := rhost || rpath, verdict := r.verdict), length(rhost || rpath)) FROM rules r
               WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS v
  FROM parts p
)
SELECT page_id, host, path, v.rule AS rule, coalesce(v.verdict, 'allow') AS verdict FROM fits
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    return judge_urls(table(spark, sf_dir, "pages"), RULES)
