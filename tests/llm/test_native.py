"""Quality rules, mixing and sharding against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from compare import assert_same
from loomery.llm import registry
from loomery.llm.mixing import hash_hex, mix_sources
from loomery.llm.plans import op4_weak_rules, op5_systematic_mix, op10_hypergeometric_shards
from loomery.llm.quality_rules import RULES, fit_rules, fit_votes, judge_quality, keep_good
from loomery.llm.sharding import communication_matrix, hypergeometric, shard_uniformly

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n ", "a", "a b c", "a b a b a b", "x\ny\nx\n\n \n \nx ", "#*$%&|<> é😀 a", "w " * 4000, "one two three\none two three\none two three four", "\x0b\x0c a\x00b c d", "A B C d"]


def stats(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) for k in range(3) if seen[tuple(w[i : i + 3])] > 1}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(None if i == 4 else i, t, ["b", None, "a"][i % 3], 9) for i, t in enumerate(ODD)] + [(3, "a", "a", 9)], "doc_id long, text string, source string, size long")


def test_statistics(spark, sf, odd):
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        text = {r.doc_id: r.text for r in df.collect()}
        rows = judge_quality(df).collect()
        assert len(rows) == df.count()
        for r in rows:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stats(text[r.doc_id]), r.doc_id


def test_verdicts(spark):
    sf = "/root/testdata/sf0.01"
    got = op4_weak_rules.query(spark, sf).toPandas()
    rule = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert (got.base_failed == rule).all() and not (got.kept & rule).any()
    known = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    known = known[~known.base_failed]
    assert known[known.quality_y == 1].kept.mean() > 0.97
    assert known[known.quality_y == 0].kept.mean() < 0.3


def test_verdicts_by_brute_force(spark, sf):
    # Votes and expectation-maximisation over documents, one by one, with nothing counted together.
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    votes = {}
    for r in docs.collect():
        t = r.text or ""
        w, c, sym, dup, rep = stats(t)
        up, lines = len(re.findall("[A-Z]", t)), sum(bool(WORD.search(x)) for x in t.split("\n"))
        good = (w >= 100, 3 * w <= c <= 10 * w, 20 * sym <= w, 100 * sym <= c, 5 * up <= c, lines > 1 and 10 * dup <= lines, 5 * rep <= w)
        bad = (w < 50, c < 2 * w or c > 20 * w, 4 * sym > w, 20 * sym > c, 2 * up > c, 2 * dup > lines, 2 * rep > w)
        votes[r.doc_id] = [-1 if b else int(g) for g, b in zip(good, bad, strict=True)], w < 50 or 100 * rep > 50 * w
    p = {i: 0.05 if -1 in v else 0.95 for i, (v, _) in votes.items()}
    before = None
    for _ in range(100):
        prior = (sum(p.values()) + 1) / (len(p) + 2)
        rate = []
        for j in range(7):
            up, down = ([sum(q(i) for i, (v, _) in votes.items() if v[j] == s) + 1 for q in (lambda i: 1 - p[i], lambda i: p[i])] for s in (1, -1))
            rate.append([up[k] / (up[k] + down[k]) for k in (0, 1)])
        odds = {i: math.log(prior / (1 - prior)) + sum(math.log(g / b) if x > 0 else math.log((1 - g) / (1 - b)) for (b, g), x in zip(rate, v, strict=True) if x) for i, (v, _) in votes.items()}
        p = {i: 1 / (1 + math.exp(-o)) for i, o in odds.items()}
        if before is not None and abs(prior - before) < 1e-9:
            break
        before = prior
    got = {r.doc_id: r for r in op4_weak_rules.query(spark, sf).collect()}
    assert all(got[i].quality == pytest.approx(x, abs=1e-6) for i, x in p.items())
    assert {i for i, r in got.items() if r.kept} == {i for i, x in p.items() if x >= 0.5 and not votes[i][1]}
    assert {r.doc_id for r in keep_good(docs, fit_rules(docs)).collect()} == {i for i, r in got.items() if r.kept}


def test_em_finds_accuracies():
    rnd, counts = random.Random(1), Counter()
    right = [0.95, 0.9, 0.8, 0.7]
    for _ in range(20_000):
        good = rnd.random() < 0.8
        counts[tuple(0 if rnd.random() < 0.3 else (1 if (rnd.random() < a) == good else -1) for a in right)] += 1
    m = fit_votes(counts, 4)
    assert abs(m.prior - 0.8) < 0.03
    for j, a in enumerate(right):
        assert all(abs(x - a) < 0.06 for x in m.accuracy(j)), (j, m.accuracy(j))


def test_empty(odd):
    none = odd.limit(0)
    assert judge_quality(none).count() == 0 and mix_sources(none).count() == 0 and shard_uniformly(none).count() == 0
    assert fit_votes({}, len(RULES)).prior == 0.5


def test_mix_twin(spark):
    assert_same(spark, op5_systematic_mix.query, registry.oracle_sql()["op5_systematic_mix"], "/root/testdata/sf0.01")


def test_mix_nears_targets(spark):
    got = op5_systematic_mix.query(spark, "/root/testdata/sf0.1").toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    assert abs(got.groupby(["source_size", "target"]).taken.sum().sum() / (1.5 * got["size"].sum()) - 1) < 0.02
    for (_, target), g in got.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - target) <= 1.1 * g["size"].max()


def test_mix_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None if k % 2 else k, "s", "w " * (3 + k % 2) + str(k)) for k in range(800)] + [(None, "s", "same text")] * 30, "doc_id long, source string, text string")
    assert df.select(hash_hex("order", F.col("doc_id"), F.col("text")).alias("h")).distinct().count() == 801
    runs = [sorted(map(tuple, mix_sources(df.repartition(p), total=1.3719, seed=seed).collect()), key=str) for p, seed in ((2, 0), (5, 0), (3, 4))]
    assert runs[0] == runs[1] != runs[2]
    for rows in runs:
        assert abs(sum(r[-1] for r in rows) - rows[0][3]) <= 5


def test_mix_targets_and_odd_rows(odd):
    got = mix_sources(odd).toPandas()
    assert len(got) == len(ODD) + 1 and sorted(got["size"]) == sorted([stats(t)[0] for t in ODD] + [1])
    size = Counter()
    for r in odd.collect():
        size[r.source] += stats(r.text)[0]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, open_, target, left = dict(zip(order, (3, 1, 2), strict=True)), set(order), {}, 1.5 * sum(size.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    assert {(r.source_size, round(r.target, 6)) for r in got.itertuples()} == {(size[s], round(target[s], 6)) for s in order}


def test_shards(spark, sf, odd):
    for df, n in ((spark.read.parquet(f"{sf}/documents.parquet"), 24), (odd, 4), (odd, 40)):
        got = shard_uniformly(df, n).toPandas()
        counts = got.groupby("shard").size().reindex(range(n), fill_value=0)
        assert counts.sum() == df.count() and counts.max() - counts.min() <= 1
        for _, g in got.groupby("shard"):
            assert sorted(g.slot) == list(range(len(g)))
        want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.size, r.text_crc32) for r in got[["doc_id", "size", "text_crc32"]].itertuples(index=False)) == want
        again = shard_uniformly(df.repartition(3), n).toPandas()
        assert sorted(map(str, again.values.tolist())) == sorted(map(str, got.values.tolist()))


def test_shards_are_uniform(spark):
    got = op10_hypergeometric_shards.query(spark, "/root/testdata/sf0.1").toPandas()
    half = got[got.doc_id < 5000].groupby("shard").size()
    assert half.between(208 - 60, 208 + 60).all()
    assert abs(got[["doc_id", "slot"]].corr().iloc[0, 1]) < 0.05
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()


def test_hypergeometric_law():
    rnd = random.Random(3)
    n = 20_000
    xs = [hypergeometric(rnd, 30, 70, 20) for _ in range(n)]
    mean = sum(xs) / n
    assert abs(mean - 6) < 0.05 and abs(sum((x - mean) ** 2 for x in xs) / n - 20 * 0.3 * 0.7 * 80 / 99) < 0.12
    m = communication_matrix([5, 0, 100, 17], [40, 41, 41], 1)
    assert [sum(r) for r in m] == [5, 0, 100, 17] and [sum(c) for c in zip(*m, strict=True)] == [40, 41, 41]
    big = hypergeometric(rnd, 10**9, 23 * 10**9, 10**7)
    assert abs(big - 10**7 / 24) < 10_000
