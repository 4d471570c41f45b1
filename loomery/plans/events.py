"""Deliveries, codes, caches, tools, owners and reports, worked out from table rows."""

from __future__ import annotations

import base64

from pyspark.sql import functions as F

from ..functions.crypto import hmac_sha256
from ..functions.text import sha256_base64url
from ..operators import captured as K
from ..operators import catalog as C
from ..operators import deliveries as D
from ..operators import metering as M
from ..operators.cardinality import one_for_each
from ..operators.stateful import cache_log
from ..operators.tools import Field, Tool, run_tool
from ..sources.tables import SUBS_SQL, TOOLS_SQL, USAGE_SQL, Scope, read, subscriptions, tools, usage
from .catalog import _SESSIONS, _sessions
from .registry import query

SECRET = "whsec_" + base64.b64encode(b"a secret of this query alone").decode()
_E = "SELECT *, (props::JSON ->> 'k')::INT AS k, epoch_us(ts) AS us FROM events"


@query(
    "delivery_guards",
    f"""
WITH e AS ({_E})
SELECT event_id, CASE WHEN k % 11 = 0 THEN 'missing_headers' WHEN k % 7 = 0 OR k % 13 = 0 THEN 'stale_timestamp' WHEN k % 5 = 0 THEN 'bad_signature' WHEN k % 17 = 0 THEN 'bad_body'
  WHEN event_type <> 'purchase' THEN 'ignored' ELSE 'accepted' END AS reason FROM e""",
)
def delivery_guards(spark, d):
    """Each event as a signed delivery, and the first guard that it fails."""
    k, at = F.get_json_object("props", "$.k").cast("int"), F.unix_seconds(F.col("ts").cast("timestamp"))
    id_ = F.col("event_id").cast("string")
    stamp = F.when(k % 7 == 0, (at - 301).cast("string")).when(k % 13 == 0, F.lit("soon")).otherwise((at + k % 300).cast("string"))
    body = F.when(k % 17 == 0, F.concat(F.lit("["), F.col("user_id"), F.lit("]"))).otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), F.col("value").alias("amount"))))
    shaped = read(spark, d, "events").select("event_id", id_.alias("id"), stamp.alias("stamp"), body.alias("body"), at.alias("at"), k.alias("k"))
    mac = F.base64(hmac_sha256(F.concat_ws(".", "id", "stamp", F.when(F.col("k") % 5 == 0, "other").otherwise(F.col("body"))), base64.b64decode(SECRET[6:])))
    header = F.when(F.col("k") % 11 != 0, F.concat(F.lit("v1,bad v1,"), mac))
    return shaped.select("event_id", D.guard(SECRET, F.col("id"), F.col("stamp"), header, F.col("body"), F.col("at"), "purchase").alias("reason"))


@query(
    "code_redemption",
    """
WITH c AS (SELECT c_custkey, c_mktsegment, TIMESTAMP '2024-01-01' + to_hours(c_custkey::INT) AS issued, TIMESTAMP '2024-01-01' + to_hours(c_custkey::INT + 240) AS expires FROM customer),
a AS (SELECT event_id, user_id, ts, event_type, value, (props::JSON ->> 'k')::INT AS k FROM events),
w AS (SELECT a.*, c.*, k % 10 > 0 AS formed FROM a LEFT JOIN c ON c_custkey = user_id),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, formed AND coalesce(ts >= issued, false) ORDER BY ts, event_id) AS place FROM w)
SELECT event_id, CASE WHEN NOT formed THEN 'invalid_request' WHEN NOT coalesce(ts >= issued, false) OR place > 1 THEN 'unknown_or_used' WHEN expires < ts THEN 'expired'
  WHEN c_mktsegment = 'FURNITURE' THEN 'other_client' WHEN event_type = 'error' THEN 'other_redirect' WHEN k % 3 = 0 THEN 'pkce_failed' ELSE 'ok' END AS verdict FROM f""",
)
def code_redemption(spark, d):
    """Events as attempts on each customer's code: the first consumes it, whatever its verdict."""
    k = F.col("c_custkey").cast("int")
    hours = lambda n: F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval(hours=n)
    codes = read(spark, d, "customer").select(
        F.sha2(F.concat(F.lit("code-"), "c_custkey"), 256).alias("code_hash"), hours(k).alias("issued_at"), hours(k + 240).alias("expires_at"),
        F.when(F.col("c_mktsegment") == "FURNITURE", "another").otherwise("client").alias("client_id"), F.lit("https://h.example/cb").alias("redirect_uri"), sha256_base64url(F.concat(F.lit("verifier-"), "c_custkey")).alias("challenge"),
    )
    n = F.get_json_object("props", "$.k").cast("int")
    attempts = read(spark, d, "events").select(
        F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp_ntz").alias("at"), F.concat(F.lit("code-"), "user_id").alias("code"), F.when(n % 10 == 0, "").when(n % 3 == 0, "wrong").otherwise(F.concat(F.lit("verifier-"), "user_id")).alias("verifier"),
        F.lit("client").alias("client_id"), F.when(F.col("event_type") != "error", "https://h.example/cb").alias("redirect_uri"),
    )
    return D.redeem_codes(codes, attempts).select(F.col("attempt_id").alias("event_id"), "verdict")


_HOUR = 3_600_000_000


@query(
    "cache_coalesced",
    f"""
WITH RECURSIVE q AS (
  SELECT event_id, user_id, us, us + k::BIGINT * {_HOUR} AS done, (k % 5)::BIGINT * {12 * _HOUR} AS ttl, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS place FROM ({_E})
), f AS (
  SELECT event_id, user_id, place, CASE WHEN ttl = 0 THEN 'bypass' ELSE 'miss' END AS status, CASE WHEN ttl > 0 THEN done END AS last FROM q WHERE place = 1
  UNION ALL
  SELECT q.event_id, q.user_id, q.place, CASE WHEN ttl = 0 THEN 'bypass' WHEN us < last THEN 'coalesced' WHEN us - last < ttl THEN 'hit' ELSE 'miss' END, CASE WHEN ttl = 0 OR coalesce(us < last OR us - last < ttl, false) THEN last ELSE done END
  FROM f JOIN q ON q.user_id = f.user_id AND q.place = f.place + 1
)
SELECT event_id, user_id, status FROM f""",
)
def cache_coalesced(spark, d):
    """Cache outcomes of requests that take their time: those that join a fetch under way among them."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, d, "events").withColumn("done", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + k * _HOUR))
    return cache_log(e, ["user_id"], "ts", "done", "event_id", k % 5 * 12 * _HOUR).select("event_id", "user_id", "status")


def _offers(price: float, size: int) -> list[dict]:
    if size == 13:
        raise ArithmeticError("thirteen")
    return [{"pieces": n, "total": round(price * n * (100 - size), 2) / 100} for n in range(1, size % 3 + 1)]


#: Bulk prices of a part; sizes over 40 and prices over 1,000 are out of its bounds.
OFFERS = Tool("offers", _offers, {"price": Field("number", 0, 1000), "size": Field("integer", 1, 40)}, {"pieces": Field("integer", 1), "total": Field("number", 0)})


@query(
    "tool_results",
    """
WITH p AS (SELECT p_partkey, p_size AS size, p_retailprice AS price FROM part)
SELECT p_partkey, false AS ok, CASE WHEN size = 13 AND price <= 1000 THEN 'tool_failed' ELSE 'invalid_input' END AS error,
       CASE WHEN size = 13 AND price <= 1000 THEN 'ArithmeticError: thirteen' WHEN price > 1000 AND size > 40 THEN 'price is out of bounds; size is out of bounds' WHEN price > 1000 THEN 'price is out of bounds' ELSE 'size is out of bounds' END AS message,
       NULL::BIGINT AS pieces, NULL::DOUBLE AS total FROM p WHERE size = 13 OR price > 1000 OR size > 40
UNION ALL SELECT p_partkey, true, NULL, NULL, n, round(price * n * (100 - size), 2) / 100 FROM p, range(1, 3) r(n) WHERE NOT (size = 13 OR price > 1000 OR size > 40) AND n <= size % 3""",
)
def tool_results(spark, d):
    """A user-defined tool over all parts: rows of results, or one row that says what is wrong."""
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"))
    return run_tool(p, OFFERS)


_LIVE = f"""SELECT t.*, CASE WHEN t.id % 9 = 0 THEN 'staging' ELSE 'live' END AS status, CASE WHEN t.id % 7 > 0 THEN t.id * 2 END AS live_version_id FROM ({TOOLS_SQL}) t"""


@query(
    "catalog_live_versions",
    f"""
WITH t AS ({_LIVE}), v AS (SELECT s_suppkey AS id, s_name AS entry, s_acctbal AS credits FROM supplier)
SELECT t.id, entry, credits, row_number() OVER (ORDER BY featured NULLS LAST, popularity_rank NULLS LAST, popularity_score DESC NULLS LAST, name, t.id) AS place
FROM t JOIN v ON v.id = live_version_id WHERE status = 'live'""",
)
def catalog_live_versions(spark, d):
    """Live tools with their live version's fields, in the stored order."""
    t = tools(spark, d).withColumn("status", F.when(F.col("id") % 9 == 0, "staging").otherwise("live")).withColumn("live_version_id", F.when(F.col("id") % 7 > 0, F.col("id") * 2))
    v = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("entry"), F.col("s_acctbal").alias("credits"))
    return C.live_tools(t, v).select("id", "entry", "credits", F.col("place").cast("long").alias("place"))


_NOW = "TIMESTAMP '1999-01-01'"


@query(
    "usage_report",
    f"""
WITH s AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'trialing' WHEN 1 THEN 'past_due' ELSE status END AS state, (100 + user_id)::INT AS quota, CASE WHEN user_id % 3 = 0 THEN 5 END AS session_limit, CASE WHEN user_id % 6 = 0 THEN 30 END AS idle FROM ({SUBS_SQL})),
p AS (SELECT *, CASE WHEN subscription_id IS NOT NULL THEN period_start ELSE TIMESTAMP '1999-01-01' END AS start_at, CASE WHEN subscription_id IS NOT NULL THEN CASE WHEN period_start IS NOT NULL THEN period_end END ELSE TIMESTAMP '1999-02-01' END AS end_at FROM s WHERE state IN ('active', 'trialing', 'past_due')),
u AS ({USAGE_SQL}), n AS (SELECT user_id, count(*) AS n FROM ({_SESSIONS}) WHERE revoked_at IS NULL AND deleted_at IS NULL AND expires_at > {_NOW} GROUP BY user_id)
SELECT p.user_id, CASE tier WHEN 'free' THEN 'Free' WHEN 'starter' THEN 'Starter' WHEN 'pro' THEN 'Pro' WHEN 'scale' THEN 'Scale' ELSE tier END AS plan, state AS status, coalesce(calls, 0) AS calls_used, quota AS monthly_quota,
       greatest(0, quota - coalesce(calls, 0)) AS remaining, coalesce(n, 0) AS sessions_used, coalesce(session_limit, CASE tier WHEN 'free' THEN 1 WHEN 'starter' THEN 10 WHEN 'pro' THEN 50 WHEN 'scale' THEN 250 ELSE 0 END) AS session_limit,
       coalesce(idle, 7) AS session_idle_ttl_days, coalesce(end_at, period_end) AS period_ends
FROM p LEFT JOIN u ON u.user_id = p.user_id AND u.period_start = start_at LEFT JOIN n ON n.user_id = p.user_id""",
)
def usage_report(spark, d):
    """What each account is told of its plan, its calls and its sessions."""
    u = F.col("user_id")
    state = F.when(u % 4 == 0, "trialing").when(u % 4 == 1, "past_due").otherwise(F.col("status"))
    s = subscriptions(spark, d).withColumn("status", state).withColumn("quota", (100 + u).cast("int")).withColumn("session_limit", F.when(u % 3 == 0, 5)).withColumn("idle_days", F.when(u % 6 == 0, 30))
    return M.usage_report(s, usage(spark, d), _sessions(spark, d), F.to_timestamp_ntz(F.lit("1999-01-01 00:00:00")))


_OWNER = 42


@query(
    "owner_rows",
    f"""
SELECT 'orders' AS kind, o_orderkey AS id, o_orderstatus AS value FROM orders WHERE o_custkey = {_OWNER} UNION ALL SELECT 'events', event_id, event_type FROM events WHERE user_id = {_OWNER}
UNION ALL SELECT 'lines', l_orderkey, l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = {_OWNER}) UNION ALL SELECT 'account', c_custkey, c_mktsegment FROM customer WHERE c_custkey = {_OWNER}
UNION ALL SELECT 'public', n_nationkey, n_name FROM nation""",
)
def owner_rows(spark, d):
    """All that one owner may see."""
    scope = Scope(spark, d, _OWNER)
    own = lambda kind, table, id_, value: scope.table(table).select(F.lit(kind).alias("kind"), F.col(id_).cast("long").alias("id"), F.col(value).alias("value"))
    parts = [own("orders", "orders", "o_orderkey", "o_orderstatus"), own("events", "events", "event_id", "event_type"), own("lines", "lineitem", "l_orderkey", "l_returnflag"), own("account", "customer", "c_custkey", "c_mktsegment")]
    out = own("public", "nation", "n_nationkey", "n_name")
    for p in parts:
        out = out.unionByName(p)
    return out


_CUT = 120


@query(
    "stream_value_bytes",
    f"""
WITH v AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM conversations),
s AS (SELECT *, coalesce(list_max(list_filter(range(0, least(length(text), {_CUT}) + 1), lambda n: strlen(left(text, n::INT)) <= {_CUT})), 0) AS fits FROM v WHERE place <= 20)
SELECT conv_id, list({{'value': left(text, fits::INT), 'value_base64': NULL::VARCHAR, 'bytes': strlen(text)::INT, 'truncated': strlen(text) > {_CUT}}} ORDER BY place) AS values_ FROM s GROUP BY conv_id""",
)
def stream_value_bytes(spark, d):
    """The first twenty values of each conversation, cut at 120 bytes between characters."""
    first = K.first_events(read(spark, d, "conversations"), ["conv_id"], ["turn", "text"], 20)
    c = first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.encode(x["text"], "UTF-8")).alias("v"))
    return c.select("conv_id", K.bounded_values(F.col("v"), 20, _CUT).alias("values_"))


_TITLE = "coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '')"


@query(
    "page_result",
    f"""
SELECT page_id, (200 + page_id % 3)::INT AS status, url AS final_url, {_TITLE} AS title, page_id % 3 = 2 AS blocked, NULL AS block_reason, 1 AS attempts, NULL AS transport, NULL AS timing_ms, NULL AS proxy_used, 'bypass' AS cache_status, NULL AS content_type, 'html' AS content_kind,
       strlen(html)::INT AS body_bytes, false AS body_truncated, NULL AS headers, left(coalesce(html, ''), 60000) AS content, length(coalesce(html, '')) > 60000 AS content_truncated FROM pages""",
)
def page_result(spark, d):
    """Captured pages with all the fields of a fetch result."""
    k = F.col("page_id")
    p = read(spark, d, "pages").select(
        "page_id", "html", (200 + k % 3).cast("int").alias("status"), F.col("url").alias("final_url"), F.coalesce(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("")).alias("title"), (k % 3 == 2).alias("blocked"),
        F.lit(1).alias("attempts"), F.lit("bypass").alias("cache_status"), F.lit("html").alias("content_kind"), F.octet_length("html").alias("body_bytes"), F.lit(False).alias("body_truncated"),
    )
    return K.page_result(p, ["page_id"], markup=True)


@query("one_nation_each", "SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def one_nation_each(spark, d):
    """Each customer's only nation; a second one would be an error of the run."""
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    return one_for_each(read(spark, d, "customer").select("c_custkey", "c_nationkey"), n, ["c_nationkey"]).select("c_custkey", "n_name", "n_regionkey")
