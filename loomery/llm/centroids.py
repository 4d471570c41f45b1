"""Centroid clustering of whole-number vectors: float32 screening with proven error intervals, exact integers where they overlap.

A vector's component x becomes the integer floor(scale * x), x as a double. Centroids start as the k vectors of smallest sha256 of `<salt>:<id>`. A round assigns every
vector to its nearest centroid (squared Euclidean distance, ties to the smaller number), then replaces each centroid that has vectors by their componentwise
floor(sum / count). After the last round vectors are assigned once more.

Screening: of |v - c|^2 all centroids share |v|^2, so |c|^2 - 2 v.c decides. One float32 matrix product gives all v.c of a batch; each is off by at most
gamma * |v| * |c|, gamma = m u / (1 - m u) with u = 2^-24 and m = components + 2 (rounded inputs, products and sums in any order), taken a little larger than that in
doubles. Centroids whose interval meets the lowest upper end are the shortlist; where it holds several, their distances are computed in integers, and the
least number of the nearest wins. The distance of the chosen one is always computed in integers.

Scale: vectors are read and assigned in Arrow batches, with no shuffle; a task sends a sum for each cluster and component (k * components rows), which Spark adds in
decimals; only k centroids go to the tasks. The vectors are read once for each round and never held.

Vectors that don't have exactly the number of components, or hold a null or non-finite one, are left out, as are null vectors. Null ids are kept, last in the order
of the start; rows of equal ids are vectors of their own (of equal hashes the smaller vector starts first). With fewer vectors than k there are as many centroids as
vectors. An empty table gives an empty result; columns of other names are ignored. Integers from 2^26 on are assigned by Python's integers alone; a distance or
an integer beyond a long is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Integers below this have exact float32 products bounds, and distances that fit a long with room.
SMALL = 1 << 26
BATCH = 1 << 15


def kept_vectors(vectors: DataFrame, components: int, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of doubles) of the rows that are clustered."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter((F.size("v") == components) & F.coalesce(sound, F.lit(False)))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64; scale is a power of two, so the product is exact."""
    y = np.floor(scale * x)
    if not (np.abs(y) < 2.0**62).all():
        raise OverflowError("a component is too large for exact distances")
    return y.astype(np.int64)


def assign(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the squared distance to it, both exact."""
    n, width = v.shape
    largest = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if largest >= SMALL:
        return _exact(v.astype(object), centroids.astype(object))
    unit = 2.0**-24
    gamma = (width + 2) * unit / (1 - (width + 2) * unit) * (1 + 1e-6)
    product = (v.astype(np.float32) @ centroids.T.astype(np.float32)).astype(np.float64)
    own, theirs = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)), (centroids.astype(np.float64) ** 2).sum(axis=1)
    # Twice the bound of the product, and what the doubles below may lose.
    error = 2 * gamma * own[:, None] * np.sqrt(theirs) * (1 + 1e-9) + 1e-9 * (theirs + own[:, None] * np.sqrt(theirs)) + 1e-3
    score = theirs - 2 * product
    near = score - error <= (score + error).min(axis=1, keepdims=True)
    out = near.argmax(axis=1)
    open_rows = np.flatnonzero(near.sum(axis=1) > 1)
    best = np.full(len(open_rows), np.iinfo(np.int64).max)
    for k in range(len(centroids)):  # in rising order, so that a tie leaves the smaller number
        at = np.flatnonzero(near[open_rows, k])
        d = ((v[open_rows[at]] - centroids[k]) ** 2).sum(axis=1)
        closer = d < best[at]
        best[at[closer]], out[open_rows[at[closer]]] = d[closer], k
    return out, ((v - centroids[out]) ** 2).sum(axis=1)


def _exact(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As assign, in Python's integers."""
    d = [[int(((row - c) ** 2).sum()) for c in centroids] for row in v]
    out = np.array([x.index(min(x)) for x in d], np.int64)
    least = [min(x) for x in d]
    if any(x >= 1 << 63 for x in least):
        raise OverflowError("a distance is too large for a long")
    return out, np.array(least, np.int64)


def _matrix(batch: pa.RecordBatch, components: int, scale: int) -> np.ndarray:
    return whole(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, components), scale)


def _starts(kept: DataFrame, k: int, scale: int, salt: str) -> np.ndarray:
    first = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    rows = kept.select(first.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return whole(np.array([r.v for r in rows], np.float64), scale)


def _moved(kept: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round."""
    k, width = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, width), object), np.zeros(k, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                v = _matrix(batch.slice(at, BATCH), width, scale)
                to, _ = assign(v, centroids)
                count += np.bincount(to, minlength=k)
                part = np.zeros((k, width), np.int64)
                # A batch's sums fit a long if its integers are small; else they are added as Python's.
                if np.abs(v).max(initial=0) < SMALL:
                    np.add.at(part, to, v)
                    sums += part
                else:
                    np.add.at(sums, to, v.astype(object))
        there = np.flatnonzero(count)
        cluster, component = np.repeat(there, width), np.tile(np.arange(width), len(there))
        text = pa.array([str(sums[i, j]) for i, j in zip(cluster, component, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(component), text, pa.array(count[cluster])], ["cluster", "component", "total", "n"])

    sums = kept.select("v").mapInArrow(add, "cluster long, component long, total string, n long")
    out = centroids.copy()
    for r in sums.groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r.cluster, r.component] = int(r.total) // r.n
    return out


def cluster(vectors: DataFrame, k: int = 16, components: int = 64, scale: int = 64, rounds: int = 3, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """id_col, cluster and distance of each kept vector (a stash), and the final centroids."""
    kept = kept_vectors(vectors, components, id_col, vector_col)
    kind = kept.schema["id"].dataType.simpleString()
    centroids = _starts(kept, k, scale, salt)
    if not len(centroids):
        return stash(kept.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), "assigned"), centroids
    for _ in range(rounds):
        centroids = _moved(kept, centroids, scale)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                to, d = assign(_matrix(part, components, scale), centroids)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(to.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    return stash(kept.mapInArrow(place, f"id {kind}, cluster int, distance long").withColumnRenamed("id", id_col), "assigned"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia (sums of distances) and centroid_sha256 (of the components as decimal integers joined by commas) to cluster's rows.

    The sums are of at most k rows; a sum beyond a long is an error.
    """
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    if sum(sums.values()) >= 1 << 63:
        raise OverflowError("the inertia is too large for a long")
    facts = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    few = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(few), "cluster")
