"""A table as snapshots in hash buckets: a change rewrites the buckets that it touches and no others.

Layout: <path>/data/<version>-<attempt>/bucket=<b>/*.parquet and <path>/log/<version>.json, which names the folder of each bucket. A version exists once its log file does, which is
written under another name and then renamed, so readers see the old snapshot or the new one, never a mix. A change that is made again under its number
(a repeated micro-batch) leaves the table as it is. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stateful import latest_state, upsert


class Snapshot:
    """key: the columns that say which bucket a row is in; buckets: their number, fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _fs(self, path: str):
        p = self._hadoop.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/log")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].lstrip("-").isdigit())

    def _log(self, version: int | None = None) -> dict[str, str]:
        """The folder of each bucket that has rows."""
        there = self.versions()
        if version is None and there:
            version = there[-1]
        if version is None:
            return {}
        text = self.spark.read.text(f"{self.path}/log/{version}.json", wholetext=True).first().value
        found = json.loads(text)
        if found["buckets"] != self.buckets or found["key"] != self.key:
            raise ValueError(f"the table has {found['buckets']} buckets by {found['key']}")
        return found["folders"]

    def _read(self, folders: dict[str, str]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in folders.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of another one that hasn't been cleaned away."""
        return self._read(self._log(version))

    def bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None) -> int:
        """Writes the next version: merge(old, rows) in each bucket that rows touch. number: the version to write (a micro-batch's); a known one is left as it is."""
        there = self.versions()
        if number is not None and there and number <= there[-1]:
            return there[-1]
        version = number if number is not None else (there[-1] + 1 if there else 0)
        folders = self._log()
        # At most as many numbers as buckets.
        touched = sorted(r.b for r in rows.select(self.bucket().alias("b")).distinct().collect())
        old = self._read({str(b): folders[str(b)] for b in touched if str(b) in folders})
        folder = f"{version}-{uuid.uuid4().hex[:8]}"
        made = merge(old, rows).select(*self.schema.names).withColumn("bucket", self.bucket())
        made.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        fs, p = self._fs(f"{self.path}/data/{folder}")
        full = {s.getPath().getName().partition("=")[2] for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
        kept = {b: f for b, f in folders.items() if int(b) not in touched} | {str(b): folder for b in touched if str(b) in full}
        self._write(version, {"buckets": self.buckets, "key": self.key, "folders": kept})
        return version

    def _write(self, version: int, content: dict) -> None:
        fs, part = self._fs(f"{self.path}/log/.{version}-{uuid.uuid4().hex[:8]}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not fs.rename(part, self._hadoop.Path(f"{self.path}/log/{version}.json")):
            raise RuntimeError(f"version {version} was written by someone else")

    def upsert(self, rows: DataFrame, number: int | None = None) -> int:
        """Insert or update by key; rows of one key count once each, so there should be one."""
        return self.change(rows, lambda old, new: upsert(old, new, self.key), number)

    def delete(self, keys: DataFrame, number: int | None = None) -> int:
        return self.change(keys, lambda old, gone: old.join(gone.select(*self.key).distinct(), self.key, "left_anti"), number)

    def keep_latest(self, rows: DataFrame, order: list[str], number: int | None = None) -> int:
        """Of the stored and the new rows of each key the last by order, in whatever order they arrive."""
        return self.change(rows, lambda old, new: latest_state(old.unionByName(new.select(*old.columns)), self.key, order), number)

    def clean(self, keep: int = 2) -> None:
        """Deletes what the newest `keep` versions don't use."""
        there = self.versions()
        used = {f for v in there[-keep:] for f in self._log(v).values()}
        fs, p = self._fs(f"{self.path}/data")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in used:
                fs.delete(s.getPath(), True)
        for v in there[:-keep]:
            fs.delete(self._hadoop.Path(f"{self.path}/log/{v}.json"), False)


def latest_sink(snapshot: Snapshot, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last state of each key in the snapshot."""

    def apply(batch: DataFrame, number: int) -> None:
        snapshot.keep_latest(batch, order, number)
        snapshot.clean()

    return apply
