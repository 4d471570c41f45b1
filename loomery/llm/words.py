"""Vectorised word splitting over Arrow string columns. Bounded memory: texts go through in slices of a few MB."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the word rules: space and 0x09 to 0x0D.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_UPPER = range(0x41, 0x5B)


def byte_table(lower: bool, keep_alnum_only: bool = False) -> np.ndarray:
    """A map of UTF-8 bytes: separators become a space, A-Z is lower-cased if asked; bytes of 0x80 and more stay.

    keep_alnum_only makes every ASCII character but letters and digits a separator.
    """
    t = np.arange(256, dtype=np.uint8)
    if lower:
        t[_UPPER.start : _UPPER.stop] += 32
    for b in range(128):
        c = t[b]
        if b in WHITE or (keep_alnum_only and not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)):
            t[b] = 0x20
    return t


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its texts reach max_bytes; a longer text is a slice of its own, whole."""
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(size, done + max_bytes, side="right")))
        yield batch.slice(at, to - at)
        at, done = to, int(size[to - 1])


def texts(batch: pa.RecordBatch, column: str) -> pa.StringArray:
    """The column without nulls (they are empty texts), in an array that owns a plain buffer."""
    a = batch.column(column)
    return pc.fill_null(a, "") if a.null_count else a


def mapped(a: pa.StringArray, table: np.ndarray) -> pa.StringArray:
    _, offsets, data = a.buffers()
    if data is None or not len(a):
        return a
    return pa.StringArray.from_buffers(len(a), offsets, pa.py_buffer(table[np.frombuffer(data, np.uint8)]), offset=a.offset)


def contains(a: pa.StringArray, what: bytes) -> bool:
    """Whether the bytes occur anywhere in the texts (or where two texts meet)."""
    data = a.buffers()[2]
    if data is None or not len(a):
        return False
    lo, hi = np.frombuffer(a.buffers()[1], np.int32)[[a.offset, a.offset + len(a)]]
    return data.slice(int(lo), int(hi - lo)).to_pybytes().find(what) >= 0


def split(a: pa.StringArray, table: np.ndarray | None) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts one after another, and how many each text has. Without a table the texts are mapped already."""
    if not len(a):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    lists = pc.ascii_split_whitespace(a if table is None else mapped(a, table))
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off -= off[0]
    full = pc.binary_length(flat).to_numpy() > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), np.diff(before[off])


def hash_strings(a: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of the bytes of each string."""
    if not len(a):
        return np.zeros(0, np.uint64)
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    size = np.diff(at)
    if not size.any():
        return mix64(np.zeros(len(a), np.uint64))
    b = np.frombuffer(data, np.uint8)[at[0] : at[-1]].astype(np.uint64) + np.uint64(1)
    start = at[:-1] - at[0]
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(b * power[np.arange(len(b)) - np.repeat(start, size)], dtype=np.uint64)])
    return mix64(total[start + size] - total[start] + size.astype(np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near values give unrelated ones."""
    x = x.astype(np.uint64, copy=True)
    for shift, mul in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(mul)
    return x ^ (x >> np.uint64(33))
