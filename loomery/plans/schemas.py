"""Queries on requests, API results, clients and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import web as W
from ..operators import publishing as P
from ..operators.stateful import delete_where
from ..sources.tables import read, tools
from .registry import query


def _kinds(key: str, values: list) -> Column:
    """One of the values for each row, by its key."""
    return F.get(F.array(*[F.lit(x) for x in values]), (F.col(key) % len(values)).cast("int"))


@query(
    "request_helpers",
    """
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '/a?x=1' ELSE '/keys' END AS next, CASE c_custkey % 3 WHEN 0 THEN 'https://h/p?state=' || replace(c_name, '#', '%23') || '+%C3%A9' WHEN 1 THEN 'https://h/?a=' || c_nationkey || '&state=' || replace(c_name, '#', '%23') || '+%C3%A9&b=#f' ELSE 'https://h/?a=' || c_nationkey END AS target,
  CASE WHEN c_custkey % 2 = 0 THEN 'caller' ELSE 'own' END AS accept, left(c_name, 10) AS prefix, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'v' || c_custkey END AS first,
  CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '1970-01-01' + to_seconds(c_custkey % 5) END AS at, CASE c_custkey % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'scale' END AS tier FROM customer""",
)
def request_helpers(spark, d):
    """Safe paths, query parameters, header merges, key prefixes, first values, epoch times and tiers of prices."""
    k = F.col("c_custkey")
    own, caller = F.create_map(F.lit("accept"), F.lit("own"), F.lit("x"), F.lit("y")), F.when(k % 2 == 0, F.create_map(F.lit("accept"), F.lit("caller"))).otherwise(F.create_map().cast("map<string,string>"))
    return read(spark, d, "customer").select(
        "c_custkey", W.safe_path(_kinds("c_custkey", ["/a?x=1", "//evil", "http://x"])).alias("next"),
        W.set_query(F.when(k % 3 == 0, "https://h/p").when(k % 3 == 1, F.concat(F.lit("https://h/?a="), "c_nationkey", F.lit("&state=old&b&state=2#f"))).otherwise(F.concat(F.lit("https://h/?a="), "c_nationkey")), "state", F.when(k % 3 < 2, F.concat("c_name", F.lit(" é")))).alias("target"),
        F.try_element_at(W.merged_headers(own, caller), F.lit("accept")).alias("accept"), W.key_prefix(F.col("c_name")).alias("prefix"),
        W.first_of(F.when(k % 4 > 0, F.array(F.concat(F.lit("v"), k), F.lit("z")))).alias("first"), W.epoch_time(k % 5).alias("at"),
        W.tier_of_price(_kinds("c_custkey", ["price_1", "price_3", "price_9"]), {"starter": "price_1", "pro": "price_2", "scale": "price_3"}).alias("tier"),
    )


@query(
    "result_outcomes",
    """
SELECT kind, outcome, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'unknown' ELSE 'binary' END AS kind,
  CASE event_id % 5 WHEN 0 THEN 'api_error' WHEN 1 THEN 'denied' WHEN 2 THEN 'stale_status' ELSE 'ok' END AS outcome FROM events) GROUP BY ALL""",
)
def result_outcomes(spark, d):
    """API errors, denials and kinds of content, counted."""
    e = read(spark, d, "events")
    out = W.outcome(_kinds("event_id", [False, True, True, True, True]), _kinds("event_id", [None, True, False, None, False]), _kinds("event_id", [None, 403, 403, 200, 404]))
    return e.groupBy(W.content_kind(_kinds("event_id", ["html", "odd", "binary"])).alias("kind"), out.alias("outcome")).agg(F.count("*").alias("n"))


@query("delisted_names", "SELECT list(lower(n_name) ORDER BY lower(n_name)) AS delisted FROM nation WHERE n_nationkey % 4 IN (1, 2)")
def delisted_names(spark, d):
    """Names whose repository is gone or archived; a lookup without an answer keeps its tool. One name for each tool delisted in a sweep."""
    n = read(spark, d, "nation").select(F.lower("n_name").alias("name"), "n_nationkey")
    repos = n.filter("n_nationkey % 4 <> 1").select("name", F.when(F.col("n_nationkey") % 4 == 2, True).when(F.col("n_nationkey") % 4 == 0, False).alias("archived"))
    gone = P.reconcile(n, repos, "name").filter("action = 'delist'")
    return gone.agg(F.array_sort(F.collect_list("name")).alias("delisted"))


@query("client_redirects", "SELECT c_custkey, c_custkey % 3 = 0 AS known FROM customer WHERE c_custkey % 5 > 0")
def client_redirects(spark, d):
    """Clients by a guarded id, and whether a redirect target is one of theirs."""
    k = F.col("c_custkey")
    c = read(spark, d, "customer").withColumn("client_id", F.when(k % 5 > 0, F.format_string("00000000-0000-0000-0000-%012d", k.cast("long"))).otherwise("not an id"))
    uris = F.array(F.lit("https://a.example/cb"), F.concat(F.lit("https://b.example/"), k % 3))
    return c.filter(F.col("client_id").rlike(P.UUID)).select("c_custkey", F.array_contains(uris, "https://b.example/0").alias("known"))


@query("keys_after_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 7 <> 0")
def keys_after_delete(spark, d):
    """A snapshot without one status after a delete by key."""
    return delete_where(read(spark, d, "orders").filter("o_orderstatus <> 'F'"), F.col("o_custkey") % 7 == 0).select("o_orderkey", "o_custkey")


@query("pretty_json", "SELECT r_regionkey, '{' || chr(10) || '  \"key\" : ' || r_regionkey || ',' || chr(10) || '  \"name\" : \"' || r_name || '\"' || chr(10) || '}' AS text FROM region")
def pretty_json(spark, d):
    """Rows as indented JSON texts."""
    return read(spark, d, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")), {"pretty": "true"}).alias("text"))


@query("display_fallbacks", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'seo ' || p_name ELSE p_name || ' ' || p_brand END AS title FROM part")
def display_fallbacks(spark, d):
    """The title for search engines, else the tool's own."""
    seo = F.when(F.col("id") % 2 == 0, F.concat(F.lit("seo "), "name"))
    return tools(spark, d).select("id", F.coalesce(seo, "title").alias("title"))
