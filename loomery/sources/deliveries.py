"""A streaming source of captured deliveries, and the chain of guards over it.

The source reads a folder of JSON-lines files, each line a delivery: id, timestamp, signature, body and received (seconds). Files are written once, under names
that ascend. An offset is the last name taken, so a restarted stream goes on where its checkpoint says, and a repeated micro-batch reads the same files
again. A micro-batch takes all files that are new. Each file is a partition, read on an executor through the file system of its URI.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.deliveries import ACCEPTED, guard

SCHEMA = "id string, timestamp string, signature string, body string, received double, file string, line long"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _listed(folder: str, after: str = "", upto: str | None = None) -> list[str]:
    """The folder's .jsonl files in order of their names, behind one and up to another."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and f.path.endswith(".jsonl"))
    base = [n.rsplit("/", 1)[-1] for n in names]
    return [f"{folder.rstrip('/')}/{n}" for n in base if n > after and (upto is None or n <= upto)]


def _lines(path: str) -> Iterator[tuple]:
    """The deliveries of a file. A line that is no JSON object is a delivery without headers, so that the guards name it."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    name = path.rsplit("/", 1)[-1]
    with store.open_input_stream(at) as f:
        rest, number = b"", 0
        while True:
            block = f.read(1 << 20)
            *whole, rest = (rest + block).split(b"\n") if block else [*(rest + b"\n").split(b"\n")]
            for line in whole:
                if line.strip():
                    yield (*_fields(line), name, number)
                number += 1
            if not block:
                return


def _fields(line: bytes) -> tuple:
    try:
        r = json.loads(line)
    except ValueError:
        r = None
    if not isinstance(r, dict):
        return None, None, None, line.decode("utf-8", "replace"), None
    text = lambda k: None if r.get(k) is None else r[k] if isinstance(r[k], str) else json.dumps(r[k])
    received = r.get("received")
    return text("id"), text("timestamp"), text("signature"), text("body"), float(received) if isinstance(received, int | float) else None


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [_File(p) for p in _listed(self.folder)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _lines(partition.path) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        there = _listed(self.folder)
        return {"after": there[-1].rsplit("/", 1)[-1] if there else ""}

    def partitions(self, start: dict, end: dict):
        return [_File(p) for p in _listed(self.folder, start["after"], end["after"])]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _lines(partition.path)

    def commit(self, end: dict) -> None:
        """Files stay; their names are the log."""


class Deliveries(DataSource):
    """spark.read or spark.readStream .format("deliveries").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "deliveries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self._folder())

    def _folder(self) -> str:
        path = self.options["path"]
        return path if "://" in path or path.startswith("file:") else f"file://{path}"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Deliveries)


def judged(deliveries: DataFrame, secret: str, tag: str, tolerance_s: int = 300) -> DataFrame:
    """Adds reason to deliveries (of a batch or a stream)."""
    return deliveries.withColumn("reason", guard(secret, F.col("id"), F.col("timestamp"), F.col("signature"), F.col("body"), F.col("received"), tag, tolerance_s))


def accepted_stream(deliveries: DataFrame, secret: str, tag: str, within: str = "10 minutes") -> DataFrame:
    """Accepted deliveries, each id once: repeats of an id within the watermark are dropped, and ids are forgotten after it."""
    taken = judged(deliveries, secret, tag).filter(F.col("reason") == ACCEPTED)
    return taken.withColumn("at", F.timestamp_seconds("received")).withWatermark("at", within).dropDuplicatesWithinWatermark(["id"])
