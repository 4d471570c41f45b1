"""The folder that all machines share, written tables in it, and state that a Python worker keeps between tasks."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Folders made where a local session names none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster's is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="loomery-shared-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/loomery-{uuid.uuid4().hex}"


@contextlib.contextmanager
def batches_of(spark: SparkSession, most_bytes: int) -> Iterator[None]:
    """Arrow batches of jobs that run within hold at most so many bytes (or one row), on both sides of the pipe to the Python workers."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stash(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, and survives lost executors.

    group_bytes: for rows of some MB. Row groups end at so many bytes, and are measured after each row, not after the first hundred, so that neither the writing
    nor the reading task holds more.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    sized = {} if group_bytes is None else {"parquet.block.size": group_bytes, **{f"parquet.{x}.size.row.check.{y}": 1 for x in ("block", "page") for y in ("min", "max")}}
    df.write.options(**sized).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def free(*stashed: DataFrame) -> None:
    """Deletes stashes whose last reader has run. An operator's result lists those that it still reads as its behind."""
    for df in stashed:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path.rpartition("/")[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def worker_state() -> dict:
    """A dict that lives as long as the Python worker, for things costly to build (a loaded tokenizer, a word cache)."""
    name = "loomery_worker_state"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    return sys.modules[name].state


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
