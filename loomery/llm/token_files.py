"""Token ids as Arrow IPC files of fixed-size lists.

A shard file holds record batches of two columns, ids: fixed_size_list<uint16 or uint32>[L] and mask: fixed_size_list<bool>[L] (false for padding).
Ids are read as NumPy views and masks as Arrow views of the mapped file: neither is copied.
Sequence k of a file is row k % rows of batch k // rows, so any sequence is found without a scan and read as a view of the
mapped file. The ids of a shard's documents follow one another, each document closed by an end id; the last sequence
is padded, with its mask off. Beside it lies an index file: the documents of the shard with their place in its ids.

Documents are dealt to partitions by ranges of doc_id and the text's first characters, and a partition's task closes a file when it holds SHARD_IDS ids and opens the
next, so that files in order hold ascending ids (equal ids by text). Partitions grow as the bytes of all texts to the power 0.7. Null ids come first; null and empty texts are one end id. Very long texts are whole; a reader holds the ids of one
shard. Repeated rows stay; extra columns of any name are ignored. An empty table gives no files.
A task writes under a name of its own, and only names that reached the manifest count, so a lost
executor leaves at worst an unused file.
"""

from __future__ import annotations

import gc
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .shared import batches_of, shared_dir, stash, worker_state
from .token_counts import PRE_TOKENS, load, shortcut_holds

SEQUENCE = 2048
#: Sequences in a record batch.
ROWS = 256
#: Pre-tokens that a worker remembers; beyond it the memory starts afresh. It only saves time.
CACHE_WORDS = 500_000
#: Ids after which a file is closed, and the bytes of text that are about as many.
SHARD_IDS, SHARD_BYTES = 4 << 20, 16 << 20


def _open_out(path: str):
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(at)


def _open_in(path: str):
    """The file, mapped where it is local."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)


class SequenceWriter:
    """Packs a stream of ids into batches of fixed-size lists."""

    def __init__(self, path: str, dtype: np.dtype, length: int = SEQUENCE, rows: int = ROWS, pad: int = 0):
        self.length, self.rows, self.pad, self.dtype = length, rows, pad, dtype
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = _open_out(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.total += len(ids)
        block = self.length * self.rows
        if self.held >= block:
            all_ids = np.concatenate(self.rest)
            cut = len(all_ids) // block * block
            for at in range(0, cut, block):
                self._emit(all_ids[at : at + block], block)
            self.rest, self.held = [all_ids[cut:]], len(all_ids) - cut

    def _emit(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        ids = np.concatenate([*self.rest, np.zeros(0, self.dtype)])
        if len(ids):
            full = -(-len(ids) // self.length) * self.length
            self._emit(np.concatenate([ids, np.full(full - len(ids), self.pad, self.dtype)]), len(ids))
        self.out.close()
        self.sink.close()


class SequenceReader:
    """Random access to the sequences of a file, without copies."""

    def __init__(self, path: str):
        self.file = pa.ipc.open_file(_open_in(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.counts = [self.file.get_batch(i).num_rows for i in range(self.file.num_record_batches)]

    def __len__(self) -> int:
        return sum(self.counts)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence k, both views of the file."""
        rows = self.counts[0]
        batch = self.file.get_batch(k // rows)
        at = (k % rows) * self.length
        ids, mask = (batch.column(c).values.slice(at, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def ids(self) -> np.ndarray:
        """All ids whose mask is on."""
        parts = []
        for i in range(self.file.num_record_batches):
            b = self.file.get_batch(i)
            parts.append(b.column("ids").values.filter(b.column("mask").values).to_numpy())
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _encode(chunks: list[str], path: str, dtype: np.dtype) -> list[bytes]:
    """The ids of each chunk, as bytes of dtype.

    ASCII chunks are cut into pre-tokens, which recur far more often than chunks; special strings and other chunks go whole to the library.
    """
    known = worker_state().setdefault(("ids", path, dtype.str), {})
    if len(known) > CACHE_WORDS:
        known.clear()
    # A chunk that is known is a pre-token of its own, or was taken whole.
    out = [known.get(w) for w in chunks]
    rest = [i for i, x in enumerate(out) if x is None]
    cuts = [PRE_TOKENS.findall(w.lower()) if w.isascii() and "<|" not in w else [w] for w in map(chunks.__getitem__, rest)]
    names = list({p: None for c in cuts for p in c if p not in known})
    for at in range(0, len(names), 10_000):
        some = names[at : at + 10_000]
        ids = [e.ids for e in load(path).encode_batch_fast(some, add_special_tokens=False)]
        data = np.fromiter(itertools.chain.from_iterable(ids), dtype).tobytes()
        ends = list(itertools.accumulate(len(x) * dtype.itemsize for x in ids))
        known.update(zip(some, [data[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)], strict=True))
    for i, c in zip(rest, cuts, strict=True):
        out[i] = known[c[0]] if len(c) == 1 else b"".join([known[p] for p in c])
    return out


def _lowered(a: pa.StringArray, as_is: np.ndarray, lowered: np.ndarray) -> pa.StringArray:
    """The texts with white space as spaces and A-Z lower-cased, but for letters before a non-ASCII byte.

    The library composes letters with combining marks before it lower-cases them, so such a letter stays for it; any other stands alone in that step.
    """
    data = a.buffers()[2]
    if data is None or not len(a):
        return a
    plain = np.frombuffer(data, np.uint8)
    out = lowered[plain]
    at = np.flatnonzero(plain[1:] >= 0x80)
    out[at] = as_is[plain[at]]
    return pa.StringArray.from_buffers(len(a), a.buffers()[1], pa.py_buffer(out), offset=a.offset)


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, vocab_size: int, folder: str | None = None, length: int = SEQUENCE, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files and returns their manifest, one row for each file: path, index_path, first id, n_docs, n_tokens, base.

    base: ids in all files before, summed within each partition and over the partitions before; shards: the number of partitions.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tokens"
    as_is, lowered = words.byte_table(lower=False), words.byte_table(lower=True)
    dtype = np.dtype(np.uint16 if max(vocab_size, end_id + 1) <= 1 << 16 else np.uint32)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    order = [F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    if not shards:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(1, round((total / SHARD_BYTES) ** 0.7))
    # A prefix sorts as its text does, and keeps the sample for the ranges small.
    dealt = rows.repartitionByRange(shards, order[0], F.left("text", F.lit(32)).asc_nulls_first())
    if not shortcut_holds(tokenizer_path):
        raise ValueError("texts are cut at white space here, which this vocabulary file does not allow")

    names = ["path", "index_path", "first", "n_docs", "n_tokens", "part", "number"]

    class Shard:
        """A file that is being written, and its index."""

        def __init__(self, number: int, first: pa.Array):
            self.name, self.number, self.first = f"{folder}/shard-{uuid.uuid4().hex}", number, first
            self.ids, self.docs = SequenceWriter(f"{self.name}.arrow", dtype, length), 0
            self.sink, self.schema = _open_out(f"{self.name}.index.arrow"), pa.schema([("id", first.type), ("start", pa.int64()), ("n_tokens", pa.int64())])
            self.index = pa.ipc.new_file(self.sink, self.schema)

        def add(self, id_: pa.Array, stream: np.ndarray, n: np.ndarray) -> None:
            self.index.write_batch(pa.RecordBatch.from_arrays([id_, pa.array(self.ids.total + np.cumsum(n) - n), pa.array(n)], schema=self.schema))
            self.ids.add(stream)
            self.docs += len(n)

        def close(self) -> pa.RecordBatch:
            for x in (self.ids, self.index, self.sink):
                x.close()
            facts = [f"{self.name}.arrow", f"{self.name}.index.arrow", None, self.docs, self.ids.total, TaskContext.get().partitionId(), self.number]
            return pa.RecordBatch.from_arrays([self.first if x is None else pa.array([x]) for x in facts], names)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing here makes cycles, and the collector would walk the worker's memory of pre-tokens again and again.
        gc.disable()
        try:
            yield from write_shards(batches)
        finally:
            gc.enable()
            # Workers stay; what their buffers took goes back to the machine.
            pa.default_memory_pool().release_unused()

    def write_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = None, 0
        for batch in batches:
            for part in words.slices(batch, "text", 8 << 20):
                if shard is None:
                    shard, number = Shard(number, part.column("id").slice(0, 1)), number + 1
                text = words.texts(part, "text")
                # The vocabulary's special strings are matched as they are.
                flat, per_doc = words.split(words.mapped(text, as_is) if words.contains(text, b"<|") else _lowered(text, as_is, lowered), None)
                coded = flat.dictionary_encode()
                ids = [*_encode(coded.dictionary.to_pylist(), tokenizer_path, dtype), np.array([end_id], dtype).tobytes()]
                lens = np.fromiter(map(len, ids), np.int64, len(ids)) // dtype.itemsize
                begins, pool = np.cumsum(lens) - lens, np.frombuffer(b"".join(ids), dtype)
                use = np.insert(coded.indices.to_numpy().astype(np.int64), np.cumsum(per_doc), len(ids) - 1)
                each = lens[use]
                ends = np.cumsum(each)
                # Half as wide where it is enough: these are the largest arrays of a task.
                wide = np.int32 if max(int(ends[-1]), len(pool)) < 1 << 31 else np.int64
                at = np.repeat((begins[use] - (ends - each)).astype(wide), each)
                at += np.arange(len(at), dtype=wide)
                stream = pool[at]
                shard.add(part.column("id"), stream, np.diff(np.concatenate([[0], ends[np.cumsum(per_doc + 1) - 1]])))
                if shard.ids.total >= SHARD_IDS:
                    yield shard.close()
                    shard = None
        if shard is not None:
            yield shard.close()

    with batches_of(spark, 8 << 20):
        files = stash(dealt.sortWithinPartitions(*order).mapInArrow(write, f"path string, index_path string, first {kind}, n_docs long, n_tokens long, part long, number long"), "manifest")
    # One row for each partition, then one for each of its files.
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("within", within).join(sums, "part").select(*names[:5], (F.col("parts_before") + F.col("within")).alias("base"))


def read_documents(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the files back: id, start (among the ids of all shards), n_tokens and ids_crc32 of each document."""
    kind = manifest.schema["first"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = SequenceReader(row["path"]).ids().astype("<u4")
                index = pa.ipc.open_file(_open_in(row["index_path"]))
                for i in range(index.num_record_batches):
                    b = index.get_batch(i)
                    start, n = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(ids[s : s + k]) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(start + row["base"]), b.column("n_tokens"), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    # One small row is a whole shard of work: as many tasks as shards.
    rows = manifest.select("path", "index_path", "base")
    spread = rows.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism * 4), "path")
    return spread.mapInArrow(read, f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def read_sequences(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The sequences themselves: path, k, ids and mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = pa.ipc.open_file(_open_in(row["path"]))
                k = 0
                for i in range(f.num_record_batches):
                    b = f.get_batch(i)
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]] * b.num_rows), pa.array(np.arange(k, k + b.num_rows)), pc.cast(b.column("ids"), pa.list_(pa.int64())), pc.cast(b.column("mask"), pa.list_(pa.bool_()))], ["path", "k", "ids", "mask"])
                    k += b.num_rows

    return manifest.select("path").mapInArrow(read, "path string, k long, ids array<long>, mask array<boolean>")
