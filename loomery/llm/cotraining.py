"""A quality classifier by co-training on two views of a document.

The content view sees the text alone: hashed words and word pairs, shares of characters, word length, repeated words and lines. The metadata view sees the
other columns alone: hashed strings, and numbers on a log scale. Each view is a ridge logistic regression.

From a bounded sample of labelled rows (MOST_LABELLED) and all other rows, the views teach each other: in each round
a view scores all of them on the executors and hands its most confident good and bad rows, as pseudo-labels, to the other view's training set. Each
view is then calibrated on labelled rows that no view trained on, and the calibrated log odds are added (less the prior, which both
hold). The result scores every row of the corpus by its whole text. Features are computed once for each row and written, in half precision, for all rounds.

Sampling is by a hash of the id, so reruns agree. Null and empty texts have no words (all features 0); very long texts are read whole. Null metadata is a value
of its own. Labels that are null, or of unknown documents, are not used; a document with several labels counts as good if any is. Of rows that share a labelled id
one is learnt from, the least by its features; ties among the surest go by id. Rows without an id are scored, but teach nothing. Without labels every score
is 0.5. Repeated rows stay; extra columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import words
from .shared import free, stash

MOST_LABELLED = 4000
ROUNDS, TAKEN = 5, 100
HASHED, WORDS, PAIRS = 64, 256, 128


def content_features(text: pa.StringArray) -> np.ndarray:
    """Shares of ASCII characters and of 8 ranges of other bytes, four measures of words and lines, and shares of hashed words and word pairs."""
    m = len(text)
    kind = np.concatenate([np.arange(128), 128 + np.arange(128) // 16])
    n_kinds = 136
    size = pc.binary_length(text).to_numpy().astype(np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + m + 1]
    data = text.buffers()[2]
    b = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    share = np.bincount(np.repeat(np.arange(m) * n_kinds, size) + kind[b], minlength=m * n_kinds).reshape(m, n_kinds) / np.maximum(size, 1)[:, None]

    def distinct(flat: pa.StringArray, n: np.ndarray) -> np.ndarray:
        coded = flat.dictionary_encode()
        each = np.unique(np.repeat(np.arange(m), n) * np.int64(max(1, len(coded.dictionary))) + coded.indices.to_numpy())
        return np.bincount(each // max(1, len(coded.dictionary)), minlength=m) / np.maximum(n, 1)

    flat, n = words.split(text, words.byte_table(lower=True))
    lines = pc.split_pattern(text, "\n")
    n_lines = pc.list_value_length(lines).to_numpy().astype(np.int64)
    more = [np.log1p(n), (size - n) / np.maximum(n, 1), distinct(flat, n), distinct(lines.flatten(), n_lines)]
    coded = flat.dictionary_encode()
    each = words.mix64(pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)) if len(flat) else np.zeros(0, np.uint64)
    h, doc = each[coded.indices.to_numpy()], np.repeat(np.arange(m), n)
    same = doc[1:] == doc[:-1]
    pair = words.mix64(h[:-1] * np.uint64(31) + h[1:])[same]

    def hashed(x: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        at = (x % np.uint64(size)).astype(np.int64)
        return np.sqrt(np.bincount(of * size + at, minlength=m * size).reshape(m, size) / np.maximum(n, 1)[:, None])

    return np.hstack([np.sqrt(share), np.stack(more, axis=1), hashed(h, doc, WORDS), hashed(pair, doc[1:][same], PAIRS)])


def metadata_features(columns: list[pa.Array]) -> np.ndarray:
    out = []
    for c in columns:
        if pa.types.is_string(c.type):
            at = pd.util.hash_array(np.array(pc.fill_null(c, "\0").to_pylist(), object), categorize=False) % HASHED
            out.append(np.eye(HASHED)[at.astype(np.int64)])
        else:
            x = pc.cast(c, pa.float64()).to_numpy(zero_copy_only=False)
            null = np.isnan(x)
            x = np.log1p(np.maximum(np.where(null, 0, x), 0))
            out.append(np.stack([x, x * x / 10, null], axis=1))
    return np.hstack(out)


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale = np.where(scale > 1e-9, scale, np.inf)
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            w += step * min(1, 5 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]


@dataclass
class CoTrained:
    views: list[Logistic]
    calibration: list[Logistic]
    prior: float

    def log_odds(self, view: int, x: np.ndarray) -> np.ndarray:
        return self.calibration[view].log_odds(self.views[view].log_odds(x)[:, None])

    def combined(self, odds: Sequence[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sum(odds) - self.prior * (len(odds) - 1), -30, 30)))


#: Picks of a round: for (pupil, label), the features of the chosen rows in the pupil's view.
Picks = dict[tuple[int, float], np.ndarray]
Give = Callable[[list[Logistic], dict[float, int]], Picks]


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray] | Give, rounds: int = ROUNDS, taken: int = TAKEN) -> CoTrained | None:
    """labelled: a feature matrix for each view, rows in the same order; pool: the same of the other rows, or what gives a round's picks."""
    if not len(y):
        return None
    held = np.arange(len(y)) % 4 == 3 if len(y) >= 8 else np.zeros(len(y), bool)
    good = (y.sum() + 1) / (len(y) + 2)
    sets = [([x[~held]], [y[~held]]) for x in labelled]
    give = pool if callable(pool) else _local(pool)
    # A view of many features needs a stronger ridge.
    fit = lambda: [Logistic.fit(np.vstack(xs), np.concatenate(ys), ridge=max(1.0, xs[0].shape[1] / 10)) for xs, ys in sets]
    views = fit()
    quota = {1.0: max(1, round(taken * good)), 0.0: max(1, round(taken * (1 - good)))}
    for _ in range(rounds):
        picks = {k: x for k, x in give(views, quota).items() if len(x)}
        for (pupil, label), x in picks.items():
            sets[pupil][0].append(x)
            sets[pupil][1].append(np.full(len(x), label))
        if not picks:
            break
        views = fit()
    use = held if held.any() else ~held
    calibration = [Logistic.fit(m.log_odds(x[use])[:, None], y[use], ridge=1e-1) for m, x in zip(views, labelled, strict=True)]
    return CoTrained(views, calibration, float(np.log(good / (1 - good))))


def _local(pool: list[np.ndarray]) -> Give:
    left = [np.ones(len(pool[0]), bool) for _ in pool]

    def give(views: list[Logistic], quota: dict[float, int]) -> Picks:
        out = {}
        for teacher, model in enumerate(views):
            pupil = 1 - teacher
            odds = model.log_odds(pool[teacher])
            for label, n in quota.items():
                sure = np.flatnonzero(left[pupil] & (odds * (2 * label - 1) > 2))
                pick = sure[np.argsort(-np.abs(odds[sure]), kind="stable")[:n]]
                left[pupil][pick] = False
                out[pupil, label] = pool[pupil][pick]
        return out

    return give


def _rows(a: pa.Array) -> np.ndarray:
    """Vectors in half precision, as a matrix."""
    return np.frombuffer(b"".join(a.to_pylist()), np.float16).reshape(len(a), -1).astype(float)


def features_of(rows: DataFrame, metadata: list[str]) -> DataFrame:
    """id, content and metadata (vectors of half floats) of every row."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, "text"):
                x = [content_features(words.texts(part, "text")), metadata_features([part.column(c) for c in metadata])]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array([row.tobytes() for row in v.astype(np.float16)], pa.binary()) for v in x)], ["id", "content", "metadata"])

    return rows.mapInArrow(features, f"id {rows.schema['id'].dataType.simpleString()}, content binary, metadata binary")


def _distributed(rows: DataFrame) -> Give:
    """Scores all rows (id and both views' vectors) in each round; every task keeps its surest ids of each view and class, of which the surest of all are taken."""
    kind = rows.schema["id"].dataType.simpleString()
    given: list[set] = [set(), set()]

    def give(views: list[Logistic], quota: dict[float, int]) -> Picks:
        used = [set(x) for x in given]

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept: dict = {(1 - t, label): {} for t in range(2) for label in quota}
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    ids = part.column("id").to_pylist()
                    x = [_rows(part.column("content")), _rows(part.column("metadata"))]
                    for teacher, model in enumerate(views):
                        pupil, odds = 1 - teacher, model.log_odds(x[teacher])
                        for label, n in quota.items():
                            top = kept[pupil, label]
                            sure, seen = np.flatnonzero(odds * (2 * label - 1) > 2), set()
                            # The n surest ids of a slice are enough, of equal odds those of least id.
                            for i in sorted(sure, key=lambda i, odds=odds: (-abs(odds[i]), ids[i])):
                                k = ids[i]
                                if len(seen) == n and k not in seen:
                                    break
                                if k not in used[pupil]:
                                    seen.add(k)
                                    # Of rows that share an id the surest counts, of equal odds that of the greatest vector.
                                    top[k] = max(top.get(k, (0.0, b"")), (float(abs(odds[i])), x[pupil][i].tobytes()))
                            if len(top) > n:
                                kept[pupil, label] = dict(sorted(top.items(), key=lambda e: (-e[1][0], e[0]))[:n])
            flat = [(p, label, k, *v) for (p, label), top in kept.items() for k, v in top.items()]
            cols = list(zip(*flat, strict=True)) if flat else [[]] * 5
            types = [pa.int32(), pa.float64(), batch_type, pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["pupil", "label", "id", "sure", "x"])

        batch_type = to_arrow_type(rows.schema["id"].dataType)
        surest = stash(rows.mapInArrow(best, f"pupil int, label double, id {kind}, sure double, x binary"), "surest")
        found = surest.groupBy("pupil", "label", "id").agg(F.max("sure").alias("sure"), F.max_by("x", F.struct("sure", "x")).alias("x"))
        out = {}
        for pupil in range(2):
            for label, n in quota.items():
                top = found.filter((F.col("pupil") == pupil) & (F.col("label") == label)).orderBy(F.desc("sure"), "id").limit(n).collect()
                given[pupil].update(r.id for r in top)
                out[pupil, label] = np.stack([np.frombuffer(r.x) for r in top]) if top else np.zeros((0, 1))
        free(surest)
        return out

    return give


def quality_scores(docs: DataFrame, labels: DataFrame, metadata: Sequence[str] = ("lang", "source", "n_chars"), label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """id, text_score, metadata_score, quality (both views together) and kept (quality >= least) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(metadata)])
    kind, m = rows.schema["id"].dataType.simpleString(), [f"m{i}" for i in range(len(metadata))]
    order = [F.xxhash64(F.lit(11), "id"), F.col("id")]
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    # The sample has at most as many ids as its bound says, so it may be sent to every task.
    chosen = known.join(rows.select("id"), "id", "left_semi").orderBy(*order).limit(most_labelled)
    chosen = stash(chosen, "labelled")
    made = stash(features_of(rows, m), "features")
    unlabelled = made.filter("id is not null").join(F.broadcast(chosen), "id", "left_anti")
    # At most one row of each chosen id reaches the driver.
    one = made.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("content", "metadata", "y")).alias("s")).select("id", "s.*")
    got = one.withColumn("h", F.xxhash64("id")).orderBy("h", "id").toArrow()
    view = [_rows(got.column(c).combine_chunks()) if got.num_rows else np.zeros((0, 1)) for c in ("content", "metadata")]
    model = co_train(view, got.column("y").to_numpy().astype(float), _distributed(unlabelled)) if got.num_rows else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                cols = [np.full(batch.num_rows, 0.5)] * 3
            else:
                odds = [model.log_odds(v, _rows(batch.column(c))) if batch.num_rows else np.zeros(0) for v, c in enumerate(("content", "metadata"))]
                cols = [*(1 / (1 + np.exp(-np.clip(o, -30, 30))) for o in odds), model.combined(odds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, cols)], ["id", "text_score", "metadata_score", "quality"])

    scored = made.mapInArrow(score, f"id {kind}, text_score double, metadata_score double, quality double")
    out = scored.withColumn("kept", F.col("quality") >= least).withColumnRenamed("id", id_col)
    free(chosen)
    out.behind = [made]
    return out
