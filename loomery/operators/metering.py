"""Metering operators: plans, billing periods, usage, quotas and alerts. Clocks are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tier, name, price in USD, monthly calls, sessions, idle days of a session.
PLANS = (
    ("free", "Free", 0, 50, 1, 7),
    ("starter", "Starter", 19, 25_000, 10, 7),
    ("pro", "Pro", 49, 100_000, 50, 7),
    ("scale", "Scale", 199, 500_000, 250, 7),
)
#: The tier that an account may move up to.
NEXT_TIER = {"free": "starter", "starter": "pro", "pro": "scale"}


def plan_value(tier: Column, field: int) -> Column:
    """A plan's field by tier, null for unknown tiers: a constant map, so no join."""
    return F.try_element_at(F.create_map(*[F.lit(x) for p in PLANS for x in (p[0], p[field])]), tier)


def next_tier(tier: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in NEXT_TIER.items() for x in kv]), tier)


def effective_period(as_of: Column) -> tuple[Column, Column]:
    """Start and end: the subscription's own period, which may be missing yet, or without one the UTC month of as_of."""
    month = F.date_trunc("MONTH", as_of).cast("timestamp_ntz")
    own = F.col("subscription_id").isNotNull()
    return F.when(own, F.col("period_start")).otherwise(month), F.when(own, F.when(F.col("period_start").isNotNull(), F.col("period_end"))).otherwise(month + F.expr("interval 1 month"))


def plan_usage(subs: DataFrame, usage: DataFrame, as_of: Column) -> DataFrame:
    """Calls in the effective period, quota and calls left (at least 0) of every account; an account without a period is left out."""
    start, end = effective_period(as_of)
    s = subs.withColumn("start", start).withColumn("end", end).filter("start is not null")
    u = usage.withColumnRenamed("period_start", "start")
    joined = s.join(u, ["user_id", "start"], "left").withColumn("calls", F.coalesce("calls", F.lit(0)))
    quota = F.coalesce(plan_value(F.col("tier"), 3), F.lit(0))
    name = F.coalesce(plan_value(F.col("tier"), 1), F.col("tier"))
    return joined.select("user_id", "tier", name.alias("plan"), F.col("start").alias("period_start"), F.col("end").alias("period_end"), "calls", quota.alias("quota"), F.greatest(F.lit(0), quota - F.col("calls")).alias("remaining"))


# States of a subscription that is metered.
METERED = ("active", "trialing", "past_due")


def usage_report(subs: DataFrame, usage: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """What each account with a metered subscription is told: plan, calls used and left in the effective period, live sessions against their limit, and when the period ends.

    subs: user_id, tier, status, quota, session_limit, idle_days, subscription_id, period_start, period_end. usage: user_id, period_start, calls. sessions: user_id,
    expires_at, revoked_at, deleted_at. Sessions are counted before the join. An account whose subscription has no period yet has used nothing.
    """
    start, end = effective_period(as_of)
    s = subs.filter(F.col("status").isin(*METERED)).withColumn("start", start).withColumn("end", end)
    live = sessions.filter(F.col("revoked_at").isNull() & F.col("deleted_at").isNull() & (F.col("expires_at") > as_of)).groupBy("user_id").agg(F.count("*").alias("sessions_used"))
    joined = s.join(usage.select("user_id", F.col("period_start").alias("start"), "calls"), ["user_id", "start"], "left").join(live, "user_id", "left")
    tier, calls = F.col("tier"), F.coalesce("calls", F.lit(0))
    return joined.select(
        "user_id", F.coalesce(plan_value(tier, 1), tier).alias("plan"), "status", calls.alias("calls_used"), F.col("quota").alias("monthly_quota"), F.greatest(F.lit(0), F.col("quota") - calls).alias("remaining"),
        F.coalesce("sessions_used", F.lit(0)).alias("sessions_used"), F.coalesce("session_limit", plan_value(tier, 4), F.lit(0)).alias("session_limit"),
        F.coalesce("idle_days", plan_value(tier, 5), F.lit(7)).alias("session_idle_ttl_days"), F.coalesce("end", "period_end").alias("period_ends"),
    )


def alert_state(calls: Column, quota: Column, notified_80: Column, notified_100: Column) -> Column:
    """cap from the full quota on, nudge from four fifths, each unless its notice is out; else null."""
    share = calls / quota
    return F.when((share >= 1) & ~notified_100, "cap").when((share >= 0.8) & (share < 1) & ~notified_80, "nudge")


def usage_alerts(subs: DataFrame, usage: DataFrame) -> DataFrame:
    """Alerts due: active accounts with a quota and a period start, by their counter of just that period."""
    s = subs.filter((F.col("quota") > 0) & F.col("period_start").isNotNull())
    due = s.join(usage, ["user_id", "period_start"]).withColumn("state", alert_state(F.col("calls"), F.col("quota"), F.col("notified_80"), F.col("notified_100")))
    return due.filter("state is not null")


def flags_after(usage: DataFrame, alerts: DataFrame, delivered: Column) -> DataFrame:
    """The counters after delivery: a cap sets both flags, a nudge one; undelivered alerts change nothing and come again."""
    sent = alerts.filter(delivered).select("user_id", "period_start", "state")
    out = usage.join(sent, ["user_id", "period_start"], "left")
    return out.withColumn("notified_80", F.col("notified_80") | F.col("state").isNotNull()).withColumn("notified_100", F.col("notified_100") | F.coalesce(F.col("state") == "cap", F.lit(False))).drop("state")


def admit(events: DataFrame, quota: int, key: list[str], order: list[str], piece: Column) -> DataFrame:
    """The first `quota` calls of each key are admitted, the rest refused.

    piece never falls along the order (a day, say). Calls are numbered within a piece, and the pieces' counts before it are added, so no task sorts all
    calls of a key.
    """
    cut = events.withColumn("__piece", piece)
    counts = cut.groupBy(*key, "__piece").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__piece").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(*key, "__piece").orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key] + [F.col("__piece").eqNullSafe(F.col("__p"))]
    joined = cut.withColumn("__place", place).join(starts, same).withColumn("call", (F.col("__start") + F.col("__place")).cast("long"))
    return joined.select(*events.columns, "call", (F.col("call") <= quota).alias("admitted"))


def progress(calls: Column, quota: Column) -> Column:
    """Percent used, 100 at most; a quota of 0 counts as 1."""
    return F.least(F.lit(100.0), calls / F.greatest(F.lit(1), quota) * 100)
