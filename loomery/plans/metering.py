"""Metering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metering as M
from ..sources.tables import SUBS_SQL, USAGE_SQL, read, subscriptions, usage
from .registry import query

AS_OF = "2024-01-20 12:00:00"
QUOTA = "CASE tier WHEN 'free' THEN 50 WHEN 'starter' THEN 25000 WHEN 'pro' THEN 100000 WHEN 'scale' THEN 500000 END"
# Small quotas, so that the test events reach the thresholds; flags stand for notices sent before.
_SUBS = f"WITH s AS (SELECT *, 40 + user_id % 60 AS quota FROM ({SUBS_SQL}) WHERE status = 'active'), u AS (SELECT *, user_id % 4 = 0 AS notified_80, user_id % 8 = 0 AS notified_100 FROM ({USAGE_SQL}))"
_ALERTS = f"""{_SUBS}, a AS (SELECT user_id, period_start, tier, calls, quota, notified_80, notified_100,
  CASE WHEN calls / quota >= 1 AND NOT notified_100 THEN 'cap' WHEN calls / quota >= 0.8 AND calls / quota < 1 AND NOT notified_80 THEN 'nudge' END AS state
  FROM s JOIN u USING (user_id, period_start) WHERE quota > 0)"""


def _as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


def _metered(spark, d):
    s = subscriptions(spark, d).filter("status = 'active'").withColumn("quota", 40 + F.col("user_id") % 60)
    u = usage(spark, d).withColumn("notified_80", F.col("user_id") % 4 == 0).withColumn("notified_100", F.col("user_id") % 8 == 0)
    return s, u


@query("usage_by_period", USAGE_SQL)
def usage_by_period(spark, d):
    """Calls by user and UTC month."""
    return usage(spark, d)


@query(
    "effective_period",
    f"""
SELECT user_id, CASE WHEN subscription_id IS NOT NULL THEN period_start ELSE TIMESTAMP '2024-01-01' END AS start_at,
       CASE WHEN subscription_id IS NOT NULL THEN CASE WHEN period_start IS NOT NULL THEN period_end END ELSE TIMESTAMP '2024-02-01' END AS end_at FROM ({SUBS_SQL})""",
)
def effective_period(spark, d):
    """Billing period, or the UTC month; null while a subscription has none."""
    start, end = M.effective_period(_as_of())
    return subscriptions(spark, d).select("user_id", start.alias("start_at"), end.alias("end_at"))


@query(
    "plan_usage",
    f"""
WITH s AS (SELECT *, CASE WHEN subscription_id IS NOT NULL THEN period_start ELSE TIMESTAMP '2024-01-01' END AS start_at,
  CASE WHEN subscription_id IS NOT NULL THEN CASE WHEN period_start IS NOT NULL THEN period_end END ELSE TIMESTAMP '2024-02-01' END AS end_at FROM ({SUBS_SQL})), u AS ({USAGE_SQL})
SELECT s.user_id, tier, CASE tier WHEN 'free' THEN 'Free' WHEN 'starter' THEN 'Starter' WHEN 'pro' THEN 'Pro' WHEN 'scale' THEN 'Scale' ELSE tier END AS plan,
       start_at AS period_start, end_at AS period_end, coalesce(calls, 0) AS calls, coalesce({QUOTA}, 0) AS quota, greatest(0, coalesce({QUOTA}, 0) - coalesce(calls, 0)) AS remaining
FROM s LEFT JOIN u ON u.user_id = s.user_id AND u.period_start = s.start_at WHERE start_at IS NOT NULL""",
)
def plan_usage(spark, d):
    """Usage of the current period against the plan."""
    return M.plan_usage(subscriptions(spark, d), usage(spark, d), _as_of())


@query("usage_alerts", f"{_ALERTS} SELECT user_id, period_start, tier, calls, quota, state, CASE tier WHEN 'free' THEN 'starter' WHEN 'starter' THEN 'pro' WHEN 'pro' THEN 'scale' END AS next_tier FROM a WHERE state IS NOT NULL")
def usage_alerts(spark, d):
    """Alerts due, with the tier to move to."""
    due = M.usage_alerts(*_metered(spark, d))
    return due.select("user_id", "period_start", "tier", "calls", "quota", "state", M.next_tier(F.col("tier")).alias("next_tier"))


@query("usage_alert_summary", f"{_ALERTS} SELECT (SELECT count(*) FROM s WHERE quota > 0) AS checked, count(*) FILTER (state = 'nudge') AS nudged, count(*) FILTER (state = 'cap') AS capped FROM a")
def usage_alert_summary(spark, d):
    """How many accounts were checked, nudged and capped."""
    s, u = _metered(spark, d)
    states = M.usage_alerts(s, u).select("state").union(s.filter("quota > 0").select(F.lit("checked")))
    count = lambda x: F.count_if(F.col("state") == x)
    return states.agg(count("checked").alias("checked"), count("nudge").alias("nudged"), count("cap").alias("capped"))


@query(
    "usage_alert_flags",
    f"""{_ALERTS}, sent AS (SELECT user_id, period_start, state FROM a WHERE state IS NOT NULL AND user_id % 10 <> 3)
SELECT u.user_id, u.period_start, calls, notified_80 OR state IS NOT NULL AS notified_80, notified_100 OR coalesce(state = 'cap', false) AS notified_100 FROM u LEFT JOIN sent USING (user_id, period_start)""",
)
def usage_alert_flags(spark, d):
    """Counters after the delivered alerts."""
    s, u = _metered(spark, d)
    return M.flags_after(u, M.usage_alerts(s, u), F.col("user_id") % 10 != 3)


@query("quota_admission", "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) AS call, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, event_id) <= 50 AS admitted FROM events")
def quota_admission(spark, d):
    """Calls within a monthly quota of fifty."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", F.date_trunc("MONTH", "ts").alias("month"))
    return M.admit(e, 50, ["user_id", "month"], ["ts", "event_id"], F.to_date("ts")).select("event_id", "user_id", "call", "admitted")


@query("usage_progress", f"SELECT user_id, least(100.0::DOUBLE, calls / greatest(1, user_id % 80)::DOUBLE * 100) AS progress FROM ({USAGE_SQL})")
def usage_progress(spark, d):
    """Percent of quota used, guarded against a quota of zero."""
    return usage(spark, d).select("user_id", M.progress(F.col("calls"), F.col("user_id") % 80).alias("progress"))


@query("number_date_format", r"SELECT o_orderkey, format('{:,}', o_orderkey * 1237) AS n, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%B %-d, %Y') AS long_day, CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE 's' END AS plural FROM orders")
def number_date_format(spark, d):
    """Thousands, short and long dates, plural endings."""
    o = read(spark, d, "orders")
    day = lambda f: F.date_format("o_orderdate", f)
    return o.select("o_orderkey", F.format_number(F.col("o_orderkey") * 1237, 0).alias("n"), day("yyyy-MM-dd").alias("day"), day("MMMM d, yyyy").alias("long_day"), F.when(F.col("o_orderkey") % 3 == 1, "").otherwise("s").alias("plural"))
