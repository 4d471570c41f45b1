"""A distributed positional inverted index over training documents, and exact phrase and proximity search in it.

The index is cut by documents into segments of a few MB of text, one row each: for every term the ascending positions of all its
occurrences in the segment, documents being laid one after another with a gap, so that no phrase runs from one into the next. It is
written as Parquet to the shared folder. A search needs no shuffle: each segment holds whole documents. All terms of all documents are kept, whatever
will be searched for. Positions are stored as steps from one to the next, the lowest bytes of all steps first, then the next ones, which compresses well.

A phrase search starts from the postings of the phrase's rarest term in the segment, moved back by the term's offset, and keeps the
starts found, in order of rarity, in the offset-adjusted postings of every other term. All phrases of a block of the test set are intersected at once; the
candidates held at a time are bounded. A proximity search asks for all terms of a window, in any order: it starts from the window's anchor, its rarest term in
all documents (equally rare: the lesser), and keeps the places that have every other term within `slop` words, before or after, in the same document.

The test set goes to the tasks in blocks of at most BLOCK_WORDS words (or one item), one pass over the index for each block, so what is sent, and held by the
driver, is bounded at any size of the test set.

Words: A-Z lower-cased, then runs of ASCII digits, ASCII letters and all non-ASCII characters. Null and empty texts have none: such documents have no hits,
such items no windows. A very long text is a segment of its own, whole. Repeated rows are separate documents, and null ids stay null. Items with equal windows all
count. The words of an item without an id are hit like others, but it has no name to be listed by. Extra columns of any name are ignored; empty
tables give empty results or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import batches_of, free, stash

SEGMENT_BYTES = 4 << 20
#: Of the index, a few segments.
GROUP_BYTES = 16 << 20
#: Places between documents of a segment.
GAP = 64
BLOCK_WORDS = 500_000
#: Candidate starts held at a time.
CANDIDATES = 1 << 20
#: The widest proximity search.
MOST_SLOP = 1 << 10

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def steps_of(positions: np.ndarray, offsets: np.ndarray) -> bytes:
    """Positions that ascend between offsets, as steps, byte by byte."""
    steps = np.diff(positions, prepend=0)
    first = offsets[:-1]
    steps[first] = positions[first]
    return steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def positions_of(steps: bytes, offsets: np.ndarray) -> np.ndarray:
    out = np.cumsum(np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)
    before = np.concatenate([[0], out])[offsets[:-1]]
    return out - np.repeat(before, np.diff(offsets))


class TestSet:
    """Windows of a block of items: each window's terms, length and items. __test__: not a test case."""

    __test__ = False

    def __init__(self, items: list[tuple[str, list[str]]], width: int):
        vocabulary: dict[str, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        self.item_ids = [i for i, _ in items]
        for k, (_, w) in enumerate(items):
            ids = [vocabulary.setdefault(x, len(vocabulary)) for x in w]
            for at in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[at : at + width]), set()).add(k)
        self.terms = list(vocabulary)
        self.lens = np.array([len(w) for w in windows], np.int64)
        self.windows = np.full((len(windows), width), -1, np.int64)
        for row, w in zip(self.windows, windows, strict=True):
            row[: len(w)] = w
        self.items = [sorted(s) for s in windows.values()]
        self.anchors = self.others = None

    def anchor(self, counts: np.ndarray) -> None:
        """Chooses the windows' anchors by the terms' counts in all documents, and lists the other terms, rare ones first (-1 pads)."""
        by_name = np.empty(len(self.terms), np.int64)
        by_name[sorted(range(len(self.terms)), key=self.terms.__getitem__)] = np.arange(len(self.terms))
        order = np.lexsort([by_name, counts])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ranked = np.sort(np.where(self.windows >= 0, place[self.windows], np.iinfo(np.int64).max), axis=1)
        ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = np.iinfo(np.int64).max
        ranked = np.sort(ranked, axis=1)
        sorted_terms = np.where(ranked < len(order), order[np.minimum(ranked, max(0, len(order) - 1))], -1) if len(order) else ranked
        self.anchors, self.others = sorted_terms[:, 0], sorted_terms[:, 1:]


class Segment:
    """Postings of a segment for the terms of a test set, ready to be intersected."""

    def __init__(self, row: dict, terms: list[str]):
        offsets = row["offsets"].astype(np.int64)
        at = pc.fill_null(pc.index_in(pa.array(terms, pa.string()), value_set=row["terms"]), -1).to_numpy().astype(np.int64)
        self.begin = np.where(at >= 0, offsets[at], 0)
        self.count = np.where(at >= 0, offsets[np.minimum(at + 1, len(offsets) - 1)] - self.begin, 0)
        self.positions = positions_of(row["steps"], offsets)
        # Terms and, in them, positions ascend, so these keys do too.
        self.shift = (int(self.positions.max(initial=0)) + MOST_SLOP).bit_length() + 1
        self.row_of = at
        lens = np.diff(offsets)
        self.keys = (np.repeat(np.arange(len(lens), dtype=np.int64), lens) << self.shift) | self.positions

    def holds(self, terms: np.ndarray, positions: np.ndarray) -> np.ndarray:
        want = (self.row_of[terms] << self.shift) | np.maximum(positions, 0)
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        return (positions >= 0) & (self.keys[at] == want)

    def phrases(self, test: TestSet) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window numbers and start positions of all occurrences, a bounded number at a time."""
        if not len(test.windows) or not len(self.keys):
            return
        count = np.where(test.windows >= 0, self.count[test.windows], np.iinfo(np.int64).max)
        alive = np.flatnonzero(count.min(axis=1) > 0)
        order = np.argsort(count[alive], axis=1, kind="stable")  # the rarest first
        n = count[alive, order[:, 0]]
        done = np.cumsum(n)
        at = 0
        while at < len(alive):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CANDIDATES, side="right")))
            which = np.repeat(np.arange(at, to), n[at:to])
            rank = np.arange(len(which)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])
            offset = order[which, 0]
            start = self.positions[self.begin[test.windows[alive[which], offset]] + rank] - offset
            for level in range(1, order.shape[1]):
                offset = order[which, level]
                term = test.windows[alive[which], offset]
                ok = (term < 0) | self.holds(np.maximum(term, 0), start + offset)
                which, start = which[ok & (start >= 0)], start[ok & (start >= 0)]
                if not len(which):
                    break
            if len(which):
                ok = start >= 0
                yield alive[which[ok]], start[ok]
            at = to

    def has_near(self, terms: np.ndarray, positions: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term stands within slop words of the position."""
        row = self.row_of[terms] << self.shift
        at = np.minimum(np.searchsorted(self.keys, row | np.maximum(positions - slop, 0)), max(0, len(self.keys) - 1))
        return (self.keys[at] <= (row | (positions + slop))) & (self.keys[at] >= row)

    def nearby(self, test: TestSet, slop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Window numbers and anchor positions of all proximity matches, a bounded number at a time."""
        if not len(test.windows) or not len(self.keys):
            return
        there = np.where(test.windows >= 0, self.count[test.windows], 1).min(axis=1) > 0
        alive = np.flatnonzero(there)
        n = self.count[test.anchors[alive]]
        done, at = np.cumsum(n), 0
        while at < len(alive):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + CANDIDATES, side="right")))
            which = np.repeat(np.arange(at, to), n[at:to])
            rank = np.arange(len(which)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])
            place = self.positions[self.begin[test.anchors[alive[which]]] + rank]
            for level in range(test.others.shape[1]):
                term = test.others[alive[which], level]
                ok = (term < 0) | self.has_near(np.maximum(term, 0), place, slop)
                which, place = which[ok], place[ok]
                if not len(which):
                    break
            if len(which):
                yield alive[which], place
            at = to

    def near(self, terms: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest of the terms that have every other term within slop words."""
        terms = sorted(set(terms), key=lambda t: self.count[t])
        if not terms or not self.count[terms[0]]:
            return np.zeros(0, np.int64)
        lists = [self.positions[self.begin[t] : self.begin[t] + self.count[t]] for t in terms]
        p = lists[0]
        for other in lists[1:]:
            i = np.searchsorted(other, p)
            after = np.where(i < len(other), other[np.minimum(i, len(other) - 1)] - p, slop + 1) if len(other) else np.full(len(p), slop + 1)
            before = np.where(i > 0, p - other[np.maximum(i - 1, 0)], slop + 1) if len(other) else np.full(len(p), slop + 1)
            p = p[np.minimum(after, before) <= slop]
        return p


def test_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, list[str]]]]:
    """Items with words, some at a time, so that a block has at most block_words words (or is one item)."""
    block, n = [], 0
    for r in items.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        w = words_of(r[1])
        if w:
            if block and n + len(w) > block_words:
                yield block
                block, n = [], 0
            block.append((r[0], w))
            n += len(w)
    if block:
        yield block


test_blocks.__test__ = False


def build_index(docs: DataFrame, gap: int = GAP, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes the index of all documents and returns it, a row for each segment.

    gap: the longest phrase or slop that may be searched for.
    """
    table = words.byte_table(lower=True, keep_alnum_only=True)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text", segment_bytes):
                flat, n = words.split(words.texts(part, "text"), table)
                coded = flat.dictionary_encode()
                term = coded.indices.to_numpy()
                start = np.cumsum(n + gap) - (n + gap)
                position = np.arange(len(flat)) + np.repeat(start - (np.cumsum(n) - n), n)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))])
                steps = steps_of(position[np.argsort(term, kind="stable")], offsets)
                lists = [part.column("id"), pa.array(start, pa.int32()), pa.array(n, pa.int64()), coded.dictionary, pa.array(offsets, pa.int32())]
                cols = [*(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists), pa.array([steps], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["ids", "starts", "n_words", "terms", "offsets", "steps"])

    made = rows.mapInArrow(post, f"ids array<{kind}>, starts array<int>, n_words array<long>, terms array<string>, offsets array<int>, steps binary")
    with batches_of(docs.sparkSession, SEGMENT_BYTES):
        return stash(made.withColumn("segment", F.expr("uuid()")), "index", GROUP_BYTES)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda c: batch.column(c)[i].values  # noqa: B023, E731
            row = {c: value(c).to_numpy(zero_copy_only=False) for c in ("starts", "n_words", "offsets")}
            yield row | {"segment": batch.column("segment")[i].as_py(), "steps": batch.column("steps")[i].as_py(), "ids": value("ids"), "terms": value("terms")}


def term_counts(index: DataFrame, terms: list[str]) -> np.ndarray:
    """How often each of some terms (those of a block of the test set) occurs in all documents. Reads the terms and offsets of the index alone."""
    sent = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(sent.value, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                lens = np.diff(batch.column("offsets")[i].values.to_numpy())
                at = pc.fill_null(pc.index_in(asked, value_set=batch.column("terms")[i].values), -1).to_numpy()
                some = np.flatnonzero(at >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(lens[at[some]].astype(np.int64))], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    found = index.select("terms", "offsets").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def window_matches(index: DataFrame, items: list[tuple[str | None, list[str]]], width: int, slop: int | None = None) -> DataFrame:
    """For every document of the index: segment, place, id, n_words, spans (disjoint, of words in any occurrence of a window), items, and near_items.

    near_items: the items of windows whose terms stand within slop words of their anchor; null without a slop.
    """
    kind, test = index.schema["ids"].dataType.elementType.simpleString(), TestSet(items, width)
    if slop is not None and slop > min(MOST_SLOP, GAP):
        raise ValueError("the slop is wider than the gap between documents")
    if slop is not None:
        test.anchor(term_counts(index, test.terms))
    sent = index.sparkSession.sparkContext.broadcast(test)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = sent.value
        for row in _segments(batches):
            starts, n_docs = row["starts"].astype(np.int64), len(row["starts"])
            end = int(starts[-1] + row["n_words"][-1]) + 1 if n_docs else 0
            segment, edge, pairs = Segment(row, test.terms), np.zeros(end + 1, np.int64), []
            doc_of = lambda at, starts=starts: np.searchsorted(starts, at, side="right") - 1

            def listed(pairs: list[np.ndarray], n_docs=n_docs) -> pa.Array:
                found: list[set[int]] = [set() for _ in range(n_docs)]
                for d, w in (np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist() if pairs else ()):
                    found[d].update(test.items[w])
                return pa.array([[test.item_ids[k] for k in sorted(s) if test.item_ids[k] is not None] for s in found], pa.list_(pa.string()))

            for window, at in segment.phrases(test):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + test.lens[window], -1)
                pairs.append(np.unique(np.stack([doc_of(at), window]), axis=1))
            near = [np.unique(np.stack([doc_of(at), window]), axis=1) for window, at in segment.nearby(test, slop)] if slop is not None else None
            hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
            change = np.diff(hit)
            lo, hi = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            doc = doc_of(lo)
            spans = pa.StructArray.from_arrays([pa.array(lo - starts[doc], pa.int32()), pa.array(hi - starts[doc], pa.int32())], ["start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)), pa.int32()), spans)
            near_items = pa.nulls(n_docs, pa.list_(pa.string())) if near is None else listed(near)
            yield pa.RecordBatch.from_arrays([pa.array([row["segment"]] * n_docs), pa.array(np.arange(n_docs), pa.int32()), row["ids"], pa.array(row["n_words"]), spans, listed(pairs), near_items], ["segment", "place", "id", "n_words", "spans", "items", "near_items"])

    return index.mapInArrow(search, f"segment string, place int, id {kind}, n_words long, spans array<struct<start: int, end: int>>, items array<string>, near_items array<string>")


def proximity_matches(index: DataFrame, items: list[tuple[str, list[str]]], slop: int) -> DataFrame:
    """id, item and word offset of every place where an item's rarest term has all its other terms within slop words (at most the index's gap).

    items: a block of the test set (see test_blocks), which is sent to the tasks.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    sent = index.sparkSession.sparkContext.broadcast((TestSet(items, 1), items))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test, items = sent.value
        number = {t: i for i, t in enumerate(test.terms)}
        for row in _segments(batches):
            segment, starts = Segment(row, test.terms), row["starts"].astype(np.int64)
            found = [segment.near([number[x] for x in w], slop) for _, w in items]
            at, which = np.concatenate([*found, np.zeros(0, np.int64)]), np.repeat(np.arange(len(items)), [len(p) for p in found])
            doc = np.searchsorted(starts, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([row["ids"].take(pa.array(doc)), pa.array([n for n, _ in items], pa.string()).take(pa.array(which)), pa.array(at - starts[doc], pa.int64())], ["id", "item", "word"])

    return index.mapInArrow(search, f"id {kind}, item string, word long")


def _hit_words(spans: Column) -> Column:
    """Words in a union of spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).cast("long").alias("n"))
    return F.aggregate(F.sort_array(spans), zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS, segment_bytes: int = SEGMENT_BYTES, slop: int | None = None) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), spans and items of every document.

    With a slop also n_near_items and near_items: items that have a window whose words all stand within slop words of its rarest one, in any order.
    """
    index = build_index(docs, max(GAP, width), id_col, text_col, segment_bytes)
    behind, merged = [], None
    # A segment goes to the Python worker at a time, and a block is done before the next is held.
    with batches_of(docs.sparkSession, SEGMENT_BYTES):
        for block in test_blocks(benchmark, item_col, "text", block_words):
            behind.append(stash(window_matches(index, block, width, slop), "found"))
            merged = behind[-1] if merged is None else merged.unionByName(behind[-1])
        if not behind:
            merged = stash(window_matches(index, [], width, slop), "found")
            behind.append(merged)
    free(index)
    if len(behind) > 1:
        merged = merged.groupBy("segment", "place").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("near_items")).alias("near_items"))
    merged = merged.withColumn("items", F.array_distinct("items"))
    out = merged.select(F.col("id").alias(id_col), "n_words", _hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), "spans", "items", "near_items")
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    if slop is not None:
        out = out.withColumn("near_items", F.array_distinct("near_items")).withColumn("n_near_items", F.size("near_items").cast("long"))
    else:
        out = out.drop("near_items")
    out.behind = behind
    return out
