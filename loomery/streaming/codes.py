"""One-time codes and quotas over streams: the batch operators' results, whatever the cut into micro-batches.

Rows of a micro-batch are taken in order of time and id, micro-batches in order of arrival. State lives in the state store (RocksDB is the provider that this
kind of state needs) and is lost to no executor.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.deliveries import CLIENT, EXPIRED, GONE, INVALID, OK, PKCE, REDIRECT, well_formed


class _Codes(StatefulProcessor):
    """The code of a hash until the first attempt takes it, or its time to live is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.code = handle, handle.getValueState("code", "expires long, client string, redirect string, challenge string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # An issue comes before attempts of the same time.
        given = pd.concat(list(rows)).sort_values(["us", "attempt_id"], na_position="first", kind="stable")
        out = []
        for r in given.itertuples():
            if pd.isna(r.attempt_id):
                self.code.update((int(r.expires), r.client, r.redirect, r.challenge))
                self.handle.registerTimer(int(r.until_ms))
            else:
                out.append((int(r.attempt_id), self._take(r)))
        yield pd.DataFrame(out, columns=["attempt_id", "verdict"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.code.clear()
        yield pd.DataFrame({"attempt_id": [], "verdict": []}).astype({"attempt_id": "int64", "verdict": "object"})

    def _take(self, r) -> str:
        if not self.code.exists():
            return GONE
        expires, client, redirect, challenge = self.code.get()
        self.code.clear()
        if expires < r.us:
            return EXPIRED
        if client != r.client:
            return CLIENT
        if redirect != r.redirect:
            return REDIRECT
        digest = hashlib.sha256((r.verifier or "").encode()).digest()
        return OK if base64.urlsafe_b64encode(digest).decode().rstrip("=") == challenge else PKCE

    def close(self) -> None:
        pass


def redeem_stream(codes: DataFrame, attempts: DataFrame, lateness: str = "1 hour", ttl: str = "1 day") -> DataFrame:
    """attempt_id and verdict, as redeem_codes gives them; columns are the same.

    Rows later than the watermark (the latest time of either stream, less lateness) are dropped. A code that nobody tries is forgotten once the watermark is
    ttl past its expiry; attempts after that find nothing, where redeem_codes says that it has expired.
    """
    none, time = F.lit(None), lambda c: F.col(c).cast("timestamp")
    us, ttl_ms = lambda c: F.unix_micros(time(c)), int(pd.Timedelta(ttl).total_seconds() * 1000)
    issued = codes.select(
        F.col("code_hash").alias("hash"), time("issued_at").alias("time"), us("issued_at").alias("us"), none.cast("long").alias("attempt_id"), us("expires_at").alias("expires"), (F.unix_millis(time("expires_at")) + ttl_ms).alias("until_ms"),
        F.col("client_id").alias("client"), F.col("redirect_uri").alias("redirect"), "challenge", none.cast("string").alias("verifier"),
    )
    # Malformed attempts touch no code, so they pass by the state.
    formed = well_formed(F.col("code"), F.col("verifier"), F.col("client_id"))
    tried = attempts.filter(formed).select(
        F.sha2("code", 256).alias("hash"), time("at").alias("time"), us("at").alias("us"), F.col("attempt_id").cast("long"), none.cast("long").alias("expires"), none.cast("long").alias("until_ms"),
        F.col("client_id").alias("client"), F.col("redirect_uri").alias("redirect"), none.cast("string").alias("challenge"), "verifier",
    )
    both = issued.withWatermark("time", lateness).unionByName(tried.withWatermark("time", lateness))
    taken = both.groupBy("hash").transformWithStateInPandas(_Codes(), "attempt_id long, verdict string", "Append", "EventTime")
    return taken.unionByName(attempts.filter(~formed).select(F.col("attempt_id").cast("long"), F.lit(INVALID).alias("verdict")))


class _Quota(StatefulProcessor):
    """The calls of a user's period so far; forgotten when the watermark has passed the period's end."""

    def __init__(self, quota: int):
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.calls = handle, handle.getValueState("calls", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        given = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        n = self.calls.get()[0] if self.calls.exists() else 0
        if not n:
            self.handle.registerTimer(int(given["until_ms"].iloc[0]))
        self.calls.update((n + len(given),))
        call = range(n + 1, n + len(given) + 1)
        yield pd.DataFrame({"user": key[0], "id": given["id"].to_numpy(), "call": list(call), "admitted": [k <= self.quota for k in call]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.calls.clear()
        yield pd.DataFrame({"user": [], "id": [], "call": [], "admitted": []}).astype({"user": "int64", "id": "int64", "call": "int64", "admitted": "bool"})

    def close(self) -> None:
        pass


def admit_stream(events: DataFrame, quota: int, user: str, at: str, order: str, lateness: str = "1 hour") -> DataFrame:
    """user, id, call and admitted of each event: the first `quota` calls of each user and UTC month of `at` are admitted, as `admit` does.

    Events later than the watermark (the latest time less lateness) are dropped. A month's counter goes when the watermark passes the month's end.
    """
    month = F.date_trunc("MONTH", F.col(at))
    until = F.unix_millis((month + F.expr("interval 1 month")).cast("timestamp")) + 1
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)
    shaped = rows.select(F.col(user).cast("long").alias("user"), month.alias("month"), F.col(at).alias("at"), F.col(order).cast("long").alias("id"), until.alias("until_ms"))
    return shaped.groupBy("user", "month").transformWithStateInPandas(_Quota(quota), "user long, id long, call long, admitted boolean", "Append", "EventTime")
