"""Centroid clustering against plain integers, and the query against SQL."""

import hashlib
import math
import random

import numpy as np
import pytest
from compare import assert_same

from loomery.llm import centroids
from loomery.llm.centroids import assign, cluster, with_inertia
from loomery.llm.plans import op12_centroid_clusters


def plain(rows, k, components, scale, rounds):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in first[:k]]
    near = lambda v: min(((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c)))
    for _ in range(rounds):
        to = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), t in zip(kept, to, strict=True) if t == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=str), c


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)


@pytest.mark.parametrize("spread", [1, 0.02, 8e5])
def test_against_plain_integers(spark, spread):
    rnd = random.Random(7)
    rows = [(i // 2, [rnd.gauss(0, spread) for _ in range(5)]) for i in range(300)]
    rows += [(None, [1.0] * 5), (None, [0.5] * 5), (7, None), (8, [1.0] * 4), (9, [1.0, None, 1.0, 1.0, 1.0]), (10, [float("nan")] * 5), (11, [float("inf")] + [0.0] * 4), (12, [-0.01] * 5), (12, [-0.01] * 5), (13, [])]
    got, found = cluster(frame(spark, rows), k=6, components=5)
    want, c = plain(rows, 6, 5, 64, 3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and found.tolist() == c
    full = with_inertia(got, found).collect()
    assert all(r.inertia == sum(d for _, _, d in want) and r.cluster_inertia == sum(d for _, j, d in want if j == r.cluster) for r in full)
    assert {r.centroid_sha256 for r in full if r.cluster == 0} <= {hashlib.sha256(",".join(map(str, c[0])).encode()).hexdigest()}


def test_screening_is_exact_at_near_ties():
    rnd = np.random.default_rng(3)
    c = rnd.integers(-5000, 5000, (16, 64))
    c[5], c[9] = c[2], c[2] + 1
    middle = (c[rnd.integers(0, 16, 4000)] + c[rnd.integers(0, 16, 4000)]) // 2 + rnd.integers(-1, 2, (4000, 64))
    to, d = assign(middle, c)
    every = ((middle[:, None, :] - c) ** 2).sum(axis=2)
    assert (to == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all() and (to != 5).all()
    big = middle.astype(np.int64) * 40_000
    to, d = assign(big, c * 40_000)
    assert (d == every.min(axis=1) * 40_000**2).all() and (to == every.argmin(axis=1)).all()


def test_few_none_and_too_large(spark):
    rows = [(1, [0.25] * 64), (2, [1.0] * 64)]
    got, c = cluster(frame(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == sorted([(1, 0 if c[0][0] == 16 else 1, 0), (2, 0 if c[0][0] == 64 else 1, 0)]) and len(c) == 2
    got, c = cluster(frame(spark, []))
    assert with_inertia(got, c).count() == 0 and len(c) == 0
    with pytest.raises(OverflowError):
        centroids.whole(np.array([1e300]), 64)
    with pytest.raises(OverflowError):
        assign(np.array([[1 << 40]]), np.array([[-(1 << 40)]]))


def test_query_equals_sql(spark, sf):
    assert assert_same(spark, op12_centroid_clusters.query, op12_centroid_clusters.SQL, sf) > 100
