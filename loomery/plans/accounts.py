"""Look-ups in account tables, for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators.cardinality import one_for_each
from ..sources.tables import SUBS_SQL, TOOLS_SQL, read, subscriptions, tools
from .registry import query


@query("keys_by_kind", "SELECT o_orderkey AS id, o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS place FROM orders WHERE o_orderpriority = '1-URGENT'")
def keys_by_kind(spark, d):
    """Each user's keys of one kind, the newest first."""
    keys = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("kind"), F.col("o_orderdate").alias("created_at"))
    return A.keys_of_kind(keys, "1-URGENT").select("id", "user_id", F.col("place").cast("long").alias("place"))


@query("subscription_by_user", f"SELECT event_id, e.user_id, tier, status FROM events e LEFT JOIN ({SUBS_SQL}) s ON s.user_id = e.user_id")
def subscription_by_user(spark, d):
    """The caller's own subscription beside each request."""
    s = subscriptions(spark, d).select("user_id", "tier", "status")
    return A.subscription_of(read(spark, d, "events").select("event_id", "user_id"), s, "user_id")


@query("subscription_by_customer", f"SELECT o_orderkey, 'sub_' || o_custkey AS subscription_id, user_id, tier FROM orders LEFT JOIN ({SUBS_SQL}) s ON s.subscription_id = 'sub_' || o_custkey")
def subscription_by_customer(spark, d):
    """Subscriptions by the billing side's id, null where it has none."""
    s = subscriptions(spark, d).filter("subscription_id is not null").select("subscription_id", "user_id", "tier")
    requests = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("sub_"), F.col("o_custkey").cast("string")).alias("subscription_id"))
    return A.subscription_of(requests, s, "subscription_id")


@query("version_of_each_line", "SELECT l_orderkey, l_linenumber, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def version_of_each_line(spark, d):
    """The one version that each run names; a missing one is an error of the run."""
    v = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return one_for_each(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), v, ["l_suppkey"], need=True).select("l_orderkey", "l_linenumber", "s_name")


@query("grant_client_names", "SELECT o_orderkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE 'client' END AS client_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def grant_client_names(spark, d):
    """Grants with their client's name."""
    clients = read(spark, d, "customer").select(F.col("c_custkey").alias("client_id"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("client_name"))
    return A.client_names(read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("client_id")), clients).select("o_orderkey", "client_name")


@query("alert_addresses", "SELECT event_id, c_custkey AS user_id, lower(c_name) || '@h.example' AS email FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'error' AND c_nationkey % 5 > 0")
def alert_addresses(spark, d):
    """Errors to report, with the address of the user where there is one."""
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_nationkey") % 5 == 0, " ").otherwise(F.concat(F.lower("c_name"), F.lit("@h.example"))).alias("email"))
    return A.with_address(read(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id"), users).select("event_id", "user_id", "email")


@query("event_dispatch", "SELECT event_id, event_type IN ('purchase', 'signup') AS handled, CASE event_type WHEN 'purchase' THEN 'paid ' || (value * 100)::BIGINT WHEN 'signup' THEN 'user ' || user_id END AS outcome FROM events")
def event_dispatch(spark, d):
    """Events by their tag: known tags go to their handlers, others are received and ignored."""
    handlers = {"purchase": F.concat(F.lit("paid "), F.rint(F.col("value") * 100).cast("long")), "signup": F.concat(F.lit("user "), F.col("user_id"))}
    return A.tagged(read(spark, d, "events"), F.col("event_type"), handlers).select("event_id", "handled", "outcome")


@query("tool_display_texts", f"SELECT id, CASE WHEN id % 3 = 0 THEN upper(name) ELSE title END AS shown_title, CASE WHEN id % 2 = 0 THEN title || '.' ELSE description END AS shown_description FROM ({TOOLS_SQL})")
def tool_display_texts(spark, d):
    """Titles and descriptions to show: those for search engines first, blank ones passed over."""
    k = F.col("id")
    t = tools(spark, d).withColumn("seo_title", F.when(k % 3 == 0, F.upper("name")).when(k % 3 == 1, " ")).withColumn("seo_description", F.when(k % 2 == 0, F.concat("title", F.lit("."))))
    return A.shown_texts(t).select("id", "shown_title", "shown_description")
