"""Stateful event operators in batch: rate limits, change data, redeem-once codes, caches, jobs and snapshot writes."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .metering import PLANS, plan_value


def folded(rows: DataFrame, key: list[str], order: list[str], values: list[str], start: Callable[[], list], step: Callable[..., None], out: str) -> DataFrame:
    """A fold over the rows of each key in order, one row for each key: the key and out's columns, which are the start of the state list.

    The rows of a key are streamed through a task in sorted batches and never held together, so a key with most of the rows costs time, not memory. Python rows,
    because each step needs the state that the step before left, which neither window frames nor aggregates carry.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), out])
    n_key, n_out = len(key), len(out.split(","))
    arrow = to_arrow_schema(rows.select(*key).schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        names = [*arrow.names, *[x.split()[0] for x in out.split(",")]]

        def packed() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) if done else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), arrow.field(i).type if i < n_key else pa.int64()) for i, c in enumerate(columns)], names)

        now, state = None, None
        for batch in batches:
            for k, row in zip(zip(*[batch.column(i).to_pylist() for i in range(n_key)], strict=True), zip(*[c.to_pylist() for c in batch.columns[n_key:]], strict=True), strict=True):
                if k != now or state is None:
                    if state is not None:
                        done.append((*now, *state[:n_out]))
                    now, state = k, start()
                step(state, *row)
            if len(done) > 10_000:
                yield packed()
                done.clear()
        if state is not None:
            done.append((*now, *state[:n_out]))
        yield packed()

    return rows.select(*key, *values).repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(fold, schema)


def rate_limit(events: DataFrame, key: str, micros: str, order: str, limit: int, window_us: int) -> DataFrame:
    """One row for each key: accepted and rejected runs of a sliding window that refused runs don't fill.

    Acceptance depends on what was accepted before, so it is a fold over the key's ordered times, not a window frame. The state is the
    last `limit` accepted times.
    """

    def step(s: list, t: int, _) -> None:
        kept = s[2]
        while kept and t - kept[0] >= window_us:
            kept.popleft()
        full = len(kept) >= limit
        s[1 if full else 0] += 1
        if not full:
            kept.append(t)

    return folded(events, [key], [micros, order], [micros, order], lambda: [0, 0, deque()], step, "accepted long, rejected long")


def latest_state(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key, in whatever order changes arrive. Reduced map-side."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*key, "s.*")


def apply_subscription_changes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The subscriptions after the latest change of each customer.

    Internal accounts stay as they are. A cancelled one returns to the free tier, without period but with its customer id. Otherwise tier,
    status and period follow the change; an unknown price gives no tier, no quota and 7 idle days. New customers with a user id are added. Session limit, period end and subscription id
    follow too where the snapshot has them; a cancel clears the last two.
    """
    free = {p[0]: p for p in PLANS}["free"]
    c = changes.select("customer_id", *[F.col(x).alias(f"new_{x}") for x in changes.columns if x != "customer_id"])
    both = current.join(c, "customer_id", "full")
    old, touched = F.col("user_id").isNotNull(), F.col("new_status").isNotNull() & ~F.coalesce(F.col("tier") == "internal", F.lit(False))
    cancelled, tier = F.col("new_status") == "canceled", F.col("new_tier")

    def pick(if_cancelled: Column, if_changed: Column, before: str) -> Column:
        return F.when(touched & cancelled & old, if_cancelled).when(touched, if_changed).otherwise(F.col(before))

    none = F.lit(None)
    # What a snapshot may hold besides.
    more = {"session_limit": pick(F.lit(free[4]), F.coalesce(plan_value(tier, 4), F.lit(0)), "session_limit")} if "session_limit" in current.columns else {}
    more |= {name: pick(none, F.col(f"new_{name}"), name) for name in ("period_end", "subscription_id") if name in current.columns}
    out = both.select(
        "customer_id",
        F.coalesce("user_id", "new_user_id").alias("user_id"),
        pick(F.lit("free"), tier, "tier").alias("tier"),
        pick(F.lit("active"), F.col("new_status"), "status").alias("status"),
        pick(F.lit(free[3]), F.coalesce(plan_value(tier, 3), F.lit(0)), "quota").alias("quota"),
        pick(F.lit(free[5]), F.coalesce(plan_value(tier, 5), F.lit(7)), "idle_days").alias("idle_days"),
        pick(none.cast("timestamp_ntz"), F.col("new_period_start"), "period_start").alias("period_start"),
        *[v.alias(name) for name, v in more.items()],
        (old | ~cancelled).alias("stays"),
    )
    return out.filter(F.col("user_id").isNotNull() & F.col("stays")).drop("stays")


def redeem_once(attempts: DataFrame, key: str, order: list[str], valid: Column, numbered: bool = False) -> DataFrame:
    """The first attempt takes the code away and succeeds if it is valid; later ones find nothing. order must tell attempts apart.

    Attempts are reduced to the first of each code map-side, so a code that is tried without end is no burden; numbered adds the number of each attempt,
    which sorts all attempts of a code.
    """
    if numbered:
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
        return attempts.withColumn("attempt", place).withColumn("verdict", F.when(F.col("attempt") > 1, "gone").when(valid, "ok").otherwise("invalid"))
    first = attempts.groupBy(key).agg(F.min(F.struct(*order)).alias("__first")).select(F.col(key).alias("__key"), *[F.col(f"__first.{c}").alias(f"__{c}") for c in order])
    same = [F.col(key).eqNullSafe(F.col("__key")), *[F.col(c).eqNullSafe(F.col(f"__{c}")) for c in order]]
    marked = first.withColumn("__won", F.lit(True))
    verdict = F.when(F.col("__won").isNull(), "gone").when(valid, "ok").otherwise("invalid")
    # The order columns are part of the join key, so a hot code's rows spread over all tasks.
    return attempts.join(marked, same, "left").select(*attempts.columns, verdict.alias("verdict"))


def cache_status(requests: DataFrame, key: list[str], ts: str, order: str, ttl_us: Column) -> DataFrame:
    """bypass without a TTL; hit while the last filling of the key is younger than the request's TTL; else miss.

    The last filling is the key's previous request that asked for caching and was no hit, so this is a fold over the key's requests.
    """
    rows = requests.select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("__t"), F.col(order).alias("__i"), ttl_us.cast("long").alias("__ttl"))

    def step(s: list, t: int, _, ttl: int) -> None:
        if not ttl:
            s[2] += 1
        elif s[3] is not None and t - s[3] < ttl:
            s[0] += 1
        else:
            s[1], s[3] = s[1] + 1, t

    return folded(rows, key, ["__t", "__i"], ["__t", "__i", "__ttl"], lambda: [0, 0, 0, None], step, "hit long, miss long, bypass long")


def cache_log(requests: DataFrame, key: list[str], start: str, end: str, order: str, ttl_us: Column) -> DataFrame:
    """Each request with its cache status, from the times it began and ended.

    bypass: without a TTL (null or not above 0). Else coalesced while the key's last fetch is still under way; hit if that has ended less than the request's
    own TTL ago; miss otherwise, which makes it the last fetch. Equal starts go by order. What a request finds depends on which earlier ones were misses, and that
    on their own TTLs, so no window frame says it: a fold over the key's requests, streamed through a task in sorted batches. The state is one time.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = requests.select(*key, F.col(order).alias("__id"), us(start).alias("__from"), us(end).alias("__to"), F.coalesce(ttl_us.cast("long"), F.lit(0)).alias("__ttl"))
    n, names = len(key), [*key, order, "status"]
    kinds = to_arrow_schema(rows.select(*key, "__id").schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, None  # done: when the last fetch of the key ends
        for batch in batches:
            keys = zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True)
            out = []
            for k, began, ended, ttl in zip(keys, *[c.to_pylist() for c in batch.columns[n + 1 :]], strict=True):
                if k != now:
                    now, done = k, None
                if ttl <= 0:
                    out.append("bypass")
                elif done is not None and began < done:
                    out.append("coalesced")
                elif done is not None and began - done < ttl:
                    out.append("hit")
                else:
                    out.append("miss")
                    done = ended
            yield pa.RecordBatch.from_arrays([*[batch.column(i).cast(kinds.field(i).type) for i in range(n + 1)], pa.array(out, pa.string())], names)

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in key), f"`{order}` {types['__id']}", "status string"])
    return rows.repartition(*key).sortWithinPartitions(*key, "__from", "__id").mapInArrow(label, schema)


def set_where(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """Update as a new snapshot: rows that meet the predicate (not null) get the values."""
    ok = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(ok, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(table: DataFrame, where: Column) -> DataFrame:
    """Delete as a new snapshot: rows for which the predicate is null stay."""
    return table.filter(~F.coalesce(where, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Insert or update by key; columns that rows don't have keep their old values."""
    new = rows.select(*key, *[F.col(c).alias(f"__{c}") for c in rows.columns if c not in key], F.lit(True).alias("__new"))
    both = table.join(new, key, "full")
    value = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in rows.columns and c not in key else F.col(c)
    return both.select(*[value(c) for c in table.columns])
