"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stateful import latest_state


def rate_limit_stream(events: DataFrame, key: str, ts_us: str, order: str, limit: int, window_us: int, lateness: str = "1 hour") -> DataFrame:
    """Each event with whether it was accepted. State of a key: at most `limit` accepted times, so it is bounded at any rate.

    Events of a micro-batch are taken in order of time; micro-batches in order of arrival. A key is forgotten once the watermark (the
    latest time less `lateness`; older events are dropped) has passed its last event by a window.
    """

    def decide(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values([ts_us, order], kind="stable")
        accepted = []
        for t in rows[ts_us]:
            kept = [x for x in kept if t - x < window_us]
            accepted.append(len(kept) < limit)
            if accepted[-1]:
                kept.append(int(t))
        state.update((kept,))
        state.setTimeoutTimestamp(max((int(rows[ts_us].iloc[-1]) + window_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({key: rows[key], order: rows[order], "accepted": accepted})

    types = {f.name: f.dataType.simpleString() for f in events.schema}
    out = f"{key} {types[key]}, {order} {types[order]}, accepted boolean"
    timed = events.withColumn("__at", F.timestamp_micros(ts_us)).withWatermark("__at", lateness)
    return timed.groupBy(key).applyInPandasWithState(decide, out, "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def keep_latest(path: str, key: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that holds the last state of each key under path/<batch>: a repeated batch writes the same folder again.

    Out-of-order changes are safe, since the order columns decide and not the arrival. A batch builds on the newest folder before it, whatever its number, and
    folders older than that one are removed.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        there = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        # A folder counts once its writer has finished it.
        done = sorted(int(p.getName()) for p in there if p.getName().isdigit() and int(p.getName()) < number and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))
        merged = spark.read.schema(batch.schema).parquet(f"{path}/{done[-1]}").unionByName(batch) if done else batch
        latest_state(merged, key, order).select(batch.columns).write.mode("overwrite").parquet(f"{path}/{number}")
        for old in done[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)

    return apply
