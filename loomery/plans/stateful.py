"""Stateful queries in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stateful as S
from ..sources.tables import read
from .registry import query

DAY = 86_400_000_000


@query(
    "rate_limit_fold",
    f"""
WITH l AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts, event_id) AS times FROM events GROUP BY user_id),
f AS (SELECT user_id, list_reduce(list_prepend({{'kept': []::BIGINT[], 'a': 0::BIGINT, 'r': 0::BIGINT, 't': 0::BIGINT}}, list_transform(times, lambda t: {{'kept': []::BIGINT[], 'a': 0::BIGINT, 'r': 0::BIGINT, 't': t}})),
  lambda s, x: CASE WHEN len(list_filter(s.kept, lambda k: x.t - k < {DAY})) >= 3
    THEN {{'kept': list_filter(s.kept, lambda k: x.t - k < {DAY}), 'a': s.a, 'r': s.r + 1, 't': 0::BIGINT}}
    ELSE {{'kept': list_append(list_filter(s.kept, lambda k: x.t - k < {DAY}), x.t), 'a': s.a + 1, 'r': s.r, 't': 0::BIGINT}} END) AS s FROM l)
SELECT user_id, s.a AS accepted, s.r AS rejected FROM f""",
)
def rate_limit_fold(spark, d):
    """At most three accepted events in any day of each user; refused ones don't count."""
    e = read(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return S.rate_limit(e, "user_id", "us", "event_id", 3, DAY)


@query("cdc_latest_state", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def cdc_latest_state(spark, d):
    """The last event of each user."""
    return S.latest_state(read(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"])


_CURRENT = """SELECT c_custkey AS customer_id, c_custkey * 10 AS user_id, CASE WHEN c_custkey % 11 = 0 THEN 'internal' WHEN c_custkey % 2 = 0 THEN 'pro' ELSE 'free' END AS tier,
  'active' AS status, CASE WHEN c_custkey % 2 = 0 THEN 100000 ELSE 50 END AS quota, 7 AS idle_days, TIMESTAMP '2023-12-01' AS period_start FROM customer WHERE c_custkey >= 20"""
_CHANGES = """SELECT user_id AS customer_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'canceled' WHEN 'view' THEN 'past_due' ELSE 'active' END AS status,
  CASE arg_max(event_type, (ts, event_id)) WHEN 'purchase' THEN 'scale' WHEN 'signup' THEN 'starter' WHEN 'view' THEN 'pro' END AS tier,
  CASE WHEN user_id % 3 = 0 THEN user_id * 10 END AS user_id, date_trunc('day', max(ts))::TIMESTAMP AS period_start FROM events GROUP BY events.user_id"""


@query(
    "cdc_apply",
    f"""
WITH o AS ({_CURRENT}), n AS ({_CHANGES}), b AS (
  SELECT coalesce(o.customer_id, n.customer_id) AS customer_id, o.user_id AS ou, n.user_id AS nu, o.tier AS ot, n.tier AS nt, o.status AS os, n.status AS ns, o.quota AS oq, o.idle_days AS oi, o.period_start AS op, n.period_start AS np,
    n.status IS NOT NULL AND NOT coalesce(o.tier = 'internal', false) AS touched, n.status = 'canceled' AS cancelled FROM o FULL JOIN n ON o.customer_id = n.customer_id)
SELECT customer_id, coalesce(ou, nu) AS user_id,
  CASE WHEN touched AND cancelled AND ou IS NOT NULL THEN 'free' WHEN touched THEN nt ELSE ot END AS tier,
  CASE WHEN touched AND cancelled AND ou IS NOT NULL THEN 'active' WHEN touched THEN ns ELSE os END AS status,
  CASE WHEN touched AND cancelled AND ou IS NOT NULL THEN 50 WHEN touched THEN coalesce(CASE nt WHEN 'starter' THEN 25000 WHEN 'pro' THEN 100000 WHEN 'scale' THEN 500000 END, 0) ELSE oq END AS quota,
  7 AS idle_days,
  CASE WHEN touched AND cancelled AND ou IS NOT NULL THEN NULL WHEN touched THEN np ELSE op END AS period_start
FROM b WHERE coalesce(ou, nu) IS NOT NULL AND (ou IS NOT NULL OR NOT cancelled)""",
)
def cdc_apply(spark, d):
    """Subscription changes applied to the current state."""
    c = read(spark, d, "customer").filter("c_custkey >= 20").select("c_custkey")
    k = F.col("c_custkey")
    current = c.select(k.alias("customer_id"), (k * 10).alias("user_id"), F.when(k % 11 == 0, "internal").when(k % 2 == 0, "pro").otherwise("free").alias("tier"), F.lit("active").alias("status"), F.when(k % 2 == 0, 100_000).otherwise(50).alias("quota"), F.lit(7).alias("idle_days"), F.to_timestamp_ntz(F.lit("2023-12-01 00:00:00")).alias("period_start"))
    last = S.latest_state(read(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])
    t, u = F.col("event_type"), F.col("user_id")
    changes = last.select(u.alias("customer_id"), F.when(t == "error", "canceled").when(t == "view", "past_due").otherwise("active").alias("status"), F.when(t == "purchase", "scale").when(t == "signup", "starter").when(t == "view", "pro").alias("tier"), F.when(u % 3 == 0, u * 10).alias("user_id"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("period_start"))
    return S.apply_subscription_changes(current, changes)


@query(
    "redeem_once",
    """
WITH a AS (SELECT event_id, user_id AS code, row_number() OVER (PARTITION BY user_id, (ts::DATE)::VARCHAR ORDER BY ts, event_id) AS attempt, value FROM events)
SELECT event_id, code, attempt, CASE WHEN attempt > 1 THEN 'gone' WHEN value < 250 THEN 'ok' ELSE 'invalid' END AS verdict FROM a""",
)
def redeem_once(spark, d):
    """The first of each user's attempts in a day redeems."""
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("code"), "ts", "value", F.concat_ws("|", "user_id", F.to_date("ts")).alias("k"))
    return S.redeem_once(e, "k", ["ts", "event_id"], F.col("value") < 250, numbered=True).select("event_id", "code", "attempt", "verdict")


@query("redeem_first", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 THEN 'gone' WHEN value < 250 THEN 'ok' ELSE 'invalid' END AS verdict FROM events")
def redeem_first(spark, d):
    """Who redeems each user's one code, without numbering the others."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return S.redeem_once(e, "user_id", ["ts", "event_id"], F.col("value") < 250).select("event_id", "verdict")


@query(
    "cache_status_log",
    """
WITH l AS (SELECT user_id, event_type, list({'t': epoch_us(ts), 'ttl': (event_id % 4 * 21600000000)::BIGINT} ORDER BY ts, event_id) AS q FROM events GROUP BY ALL),
f AS (SELECT user_id, event_type, list_reduce(list_prepend({'t': 0::BIGINT, 'ttl': 0::BIGINT, 'filled': NULL::BIGINT, 'h': 0::BIGINT, 'm': 0::BIGINT, 'b': 0::BIGINT},
    list_transform(q, lambda x: {'t': x.t, 'ttl': x.ttl, 'filled': NULL::BIGINT, 'h': 0::BIGINT, 'm': 0::BIGINT, 'b': 0::BIGINT})),
  lambda s, x: CASE WHEN x.ttl = 0 THEN {'t': 0::BIGINT, 'ttl': 0::BIGINT, 'filled': s.filled, 'h': s.h, 'm': s.m, 'b': s.b + 1}
    WHEN coalesce(x.t - s.filled < x.ttl, false) THEN {'t': 0::BIGINT, 'ttl': 0::BIGINT, 'filled': s.filled, 'h': s.h + 1, 'm': s.m, 'b': s.b}
    ELSE {'t': 0::BIGINT, 'ttl': 0::BIGINT, 'filled': x.t, 'h': s.h, 'm': s.m + 1, 'b': s.b} END) AS s FROM l)
SELECT user_id, event_type, s.h AS hit, s.m AS miss, s.b AS bypass FROM f""",
)
def cache_status_log(spark, d):
    """Cache outcomes of each payload key from a request log."""
    return S.cache_status(read(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id", F.col("event_id") % 4 * 21_600_000_000)


@query(
    "job_latest_status",
    """
SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us, max(ts) + INTERVAL 24 HOUR AS expires_at FROM events GROUP BY user_id""",
)
def job_latest_status(spark, d):
    """Latest status, duration and expiry of each job."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return (
        read(spark, d, "events")
        .groupBy(F.col("user_id").alias("job_id"))
        .agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), (us(F.max("ts")) - us(F.min("ts"))).alias("duration_us"), (F.max("ts") + F.expr("interval 24 hours")).alias("expires_at"))
    )


@query("soft_delete", "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate WHEN o_custkey % 5 = 0 THEN TIMESTAMP '2002-01-01' END AS revoked_at FROM orders")
def soft_delete(spark, d):
    """Revocation stamps set once, for the owner's rows only."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("revoked_at"))
    return S.set_where(o, F.col("revoked_at").isNull() & (F.col("o_custkey") % 5 == 0), {"revoked_at": F.to_timestamp_ntz(F.lit("2002-01-01 00:00:00"))})


@query("expired_sweep", "SELECT o_orderkey, o_orderdate FROM orders WHERE NOT coalesce(o_orderdate < TIMESTAMP '1998-01-01', false)")
def expired_sweep(spark, d):
    """Deletes codes that expired before the clock; equal stays."""
    return S.delete_where(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))


@query(
    "grant_rotation",
    """
SELECT o_orderkey, coalesce(c_name, 'client') AS client_name, CASE WHEN o_orderstatus = 'O' THEN md5(o_orderkey::VARCHAR || ':next') ELSE md5(o_orderkey::VARCHAR) END AS refresh_hash,
  CASE WHEN o_orderstatus = 'O' THEN TIMESTAMP '2002-01-01' + INTERVAL 30 DAY ELSE o_orderdate END AS access_expires_at
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""",
)
def grant_rotation(spark, d):
    """Refresh tokens of open grants rotate; client names default."""
    now = F.to_timestamp_ntz(F.lit("2002-01-01 00:00:00"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.md5(F.col("o_orderkey").cast("string")).alias("refresh_hash"), F.col("o_orderdate").alias("access_expires_at"))
    turned = S.set_where(o, F.col("o_orderstatus") == "O", {"refresh_hash": F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":next"))), "access_expires_at": now + F.expr("interval 30 days")})
    names = read(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return turned.join(names, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("client")).alias("client_name"), "refresh_hash", "access_expires_at")


@query(
    "snapshot_upsert",
    """
WITH n AS (SELECT c_custkey + 700 AS k, c_acctbal * 2 AS bal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(c_custkey, k) AS c_custkey, c_name, CASE WHEN k IS NOT NULL THEN bal ELSE c_acctbal END AS c_acctbal FROM customer FULL JOIN n ON c_custkey = k""",
)
def snapshot_upsert(spark, d):
    """Upsert by key; columns not supplied keep their values."""
    c = read(spark, d, "customer")
    rows = c.filter("c_custkey % 2 = 0").select((F.col("c_custkey") + 700).alias("c_custkey"), (F.col("c_acctbal") * 2).alias("c_acctbal"))
    return S.upsert(c.select("c_custkey", "c_name", "c_acctbal"), rows, ["c_custkey"])
