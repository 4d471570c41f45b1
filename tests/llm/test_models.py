"""Held-out accuracy of the trained operators, and odd rows."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomery.llm.context_mixing import END, HEAD, LEAN, Code, Mixer, beside_costs, chained, score_texts, sightings, token_costs, word_costs
from loomery.llm.cotraining import Logistic, _distributed, co_train, features_of, quality_scores
from loomery.llm.plans import op6_context_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}
SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n", "A a a", "é" * 40, "x" * 20_000, "the the of", "\x00 \x1c y", "w " * 3000]


def test_base_and_score(spark):
    got = {r.doc_id: r for r in op6_context_mixing.query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    tokens = {r.doc_id: [*WORD.findall((r.text or "").translate(LOWER)), END] for r in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n = sum(c.values())
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in t), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.bits_per_byte for r in out) / len(out) < 2.5
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_order_of_words_counts_and_cores_do_not(spark):
    rnd = random.Random(2)
    some = [" ".join(f"{x}{k % 7}" for x in "abcdefgh") for k in range(60)]
    texts = [" ".join(rnd.sample(some, 5)) for _ in range(200)]
    mixed = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in texts[:40]]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, t, False) for i, t in enumerate(texts[:40])] + [(2000 + i, t, False) for i, t in enumerate(mixed)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in score_texts(df, F.col("train")).collect()}
    assert all(got[1000 + i] > 1.5 * got[2000 + i] for i in range(40))
    cut = {r.doc_id: r.score for r in score_texts(df, F.col("train"), part_tokens=500).collect()}
    assert all(cut[1000 + i] > cut[2000 + i] for i in range(40))
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    again = {r.doc_id: r.score for r in score_texts(df.repartition(5), F.col("train"), part_tokens=500).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert all(again[i] == pytest.approx(x, rel=1e-5) for i, x in cut.items())


def plain_scores(docs, train):
    """Scores of few texts, bit by bit, as the model gives them before any weight has moved."""
    tokens = [[*WORD.findall((t or "").translate(LOWER)), END] for t in docs]
    c = Counter(w for t, k in zip(tokens, train, strict=True) if k for w in t)
    coded = [*sorted((w for w in c if w != END and c[w] > 1), key=lambda w: (-c[w], w)), END]
    n_escaped = sum(n for w, n in c.items() if w not in coded)
    code = Code(pa.array(coded), np.array([max(1, c[w]) for w in coded]), max(1, n_escaped))

    def token_bits(w, one, two):
        at = coded.index(w) if w in coded else len(coded)
        out = []
        while at != code.root:
            up = code.parent[at]
            out.append((float(code.one[up]), [(one, up), (two, one, up)], int(code.bit[at])))
            at = up
        return out

    def letter_bits(w):
        b, out = f"{w} ".encode(), []
        for i, x in enumerate(b):
            last = (b" " * 3 + b[:i])[-3:]
            for k in range(8):
                known = (x | 256) >> (8 - k)
                out.append((0.5, [(last[2:], known), (last, known), (b[:i], known)], x >> (7 - k) & 1))
        return out

    def cost(bits, seen, own):
        total = 0.0
        for p, contexts, bit in bits:
            stretched = []
            for k, x in enumerate(contexts):
                n = [seen[k, x, b] - own * (b == bit) for b in (0, 1)]
                p = min(max((n[1] + LEAN * p) / (sum(n) + LEAN), 1e-6), 1 - 1e-6)
                stretched.append(math.log(p / (1 - p)))
            z = 0.3 * stretched[-2] + 0.7 * stretched[-1]
            p = 1 / (1 + math.exp(-z))
            total -= math.log10(p if bit else 1 - p)
        return total

    def learn(all_bits):
        seen = Counter()
        for bits in all_bits:
            seen.update((k, x, bit) for _, contexts, bit in bits for k, x in enumerate(contexts))
        return seen

    places = [[(w, (t[i - 1] if i else END), (t[i - 2] if i > 1 else END)) for i, w in enumerate(t)] for t in tokens]
    near = learn(token_bits(*x) for t, k in zip(places, train, strict=True) if k for x in t)
    letters = learn(letter_bits(w) for w, n in c.items() if w not in coded for _ in range(n))
    return [-sum(cost(token_bits(*x), near, k) + (0 if x[0] in coded else cost(letter_bits(x[0]), letters, x[0] in c)) for x in t) for t, k in zip(places, train, strict=True)]


def test_scores_by_brute_force(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["the", "cat", "Sat", "on", "a", "mat", "zé", f"new{rnd.randint(0, 9)}"]) for _ in range(rnd.randint(0, 12))) for _ in range(40)] + ODD[:4] + ODD[6:8] + ["q" * 300]
    train = [i % 3 > 0 for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(zip(texts, train, strict=True))], "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in score_texts(df, F.col("train")).collect()}
    # Hashed tables may lose a context to others in its slots; that touches few texts, and these little.
    off = [abs(got[i] / w - 1) for i, w in enumerate(plain_scores(texts, train))]
    assert sum(x < 1e-4 for x in off) > 0.8 * len(texts) and max(off) < 0.05


def test_probabilities_of_all_words_add_up():
    code = Code(pa.array([*"abcdef", END]), np.array([50, 20, 9, 9, 3, 1, 30]), 2)
    assert code.depth[:8].max() > 3
    which, node, bit = code.path(np.arange(8))
    for zero, one in ((0, 0), (3, 0), (1, 7)):
        full = np.full(len(bit), 1, np.float32)
        x, gate = chained(code.one[node], [(zero * full, one * full), (one * full, zero * full)])
        m = Mixer(3)
        cost = np.bincount(which, m.cost(m.mixed(x, gate), gate, bit))
        assert (2.0**-cost).sum() == pytest.approx(1, abs=1e-4)


def test_sightings_lose_no_context():
    rnd = np.random.default_rng(5)
    codes = [(0, 1), (2, 2), (6, 3), (7, 3)]  # code words 0, 10, 110, 111
    symbol, weight = rnd.integers(0, 4, 4000), rnd.integers(0, 5, 4000)
    # Contexts that differ in their lowest or highest bits alone, and others.
    context = np.concatenate([rnd.integers(0, 8, 2000), rnd.integers(0, 8, 1000) << 60, rnd.integers(0, 1 << 62, 1000)]).astype(np.uint64)
    word = np.array([w << (64 - n) for w, n in codes], np.uint64)[symbol]
    seen, row = sightings(context, symbol, word, weight, 3)
    want = Counter()
    for c, s, w in zip(context.tolist(), symbol.tolist(), weight.tolist(), strict=True):
        for n in range(codes[s][1] + 1):
            want[c, n, codes[s][0] >> (codes[s][1] - n)] += w
    for k, (c, s) in enumerate(zip(context.tolist(), symbol.tolist(), strict=True)):
        assert [seen[row[k], n] for n in range(codes[s][1] + 1)] == [want[c, n, codes[s][0] >> (codes[s][1] - n)] for n in range(codes[s][1] + 1)]


def test_bits_that_share_all_they_depend_on_are_predicted_once(monkeypatch):
    rnd, predicted, cost = np.random.default_rng(6), [], Mixer.cost
    monkeypatch.setattr(Mixer, "cost", lambda self, z, gate, bit: predicted.append(len(z)) or cost(self, z, gate, bit))
    code = Code(pa.array([*"abcdef", END]), np.array([50, 20, 9, 9, 3, 1, 30]), 2)
    symbol, training = rnd.integers(0, 8, 6000), np.arange(6000) % 7 > 0
    # One word before all, and another before it each time: 14 bits follow in all, for tokens that are learnt from and for those that aren't.
    got = token_costs(code, symbol, np.full(6000, 9, np.uint64), np.arange(6000, dtype=np.uint64) << np.uint64(20), np.ones(6000, np.int64), training)
    assert sum(predicted) <= 2 * 14
    assert len(set(zip(symbol.tolist(), training.tolist(), got.tolist(), strict=True))) == 16
    # The probabilities of all symbols add up to 1, as by their counts.
    share = np.bincount(symbol, training, 8) / training.sum()
    assert np.abs(2.0 ** -np.array([got[(symbol == k) & ~training][0] for k in range(8)]) - share).max() < 0.02


def test_spelling_of_a_part_is_small():
    rnd = random.Random(1)
    some = pa.array(["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(6, 10))) for _ in range(100_000)])
    count = np.array([k % 2 for k in range(100_000)])
    tracemalloc.start()
    try:
        cost = word_costs(some, np.maximum(count, 1), count > 0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (cost > 0).all() and peak < 230e6


def test_head_changes_no_count(spark):
    df = spark.createDataFrame([(None if i == 3 else i, t, 1.0) for i, t in enumerate(ODD)] + [(6, "the the of", 1.0)], "doc_id long, text string, score double")
    df = df.withColumns({c: F.lit(1) for c in ("id", "k1", "k2", "row", "tail", "training", "word", "slice", "cost")})
    train = F.col("doc_id") % 2 == 0
    plain = lambda rows: sorted(repr((r.doc_id, r.training, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in rows)
    whole = score_texts(df, train).collect()
    assert len(whole) == len(ODD) + 1 and all(r.score < 0 and r.bits_per_byte > 0 for r in whole)
    assert len({r.score for r in whole if r.doc_id == 6}) == 1
    for head in (1, 2):
        assert plain(score_texts(df, train, head=head, part_tokens=100).collect()) == plain(whole)
    assert score_texts(df.limit(0), train).count() == 0
    assert {r.train_tokens for r in score_texts(df, F.lit(False)).collect()} == {0}


def test_words_beyond_the_head_have_neighbours_too(spark):
    rnd = random.Random(12)
    some = [" ".join(f"{x}{rnd.randint(0, 40)}" for x in "abcdefgh") for _ in range(60)]
    texts = [" ".join(rnd.sample(some, 5)) for _ in range(200)]
    rows = [(i, t, True) for i, t in enumerate(texts)] + [(1000 + i, t, False) for i, t in enumerate(texts[:40])]
    rows += [(2000 + i, " ".join(rnd.sample(t.split(), 40)), False) for i, t in enumerate(texts[:40])]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    whole, few, none = ({r.doc_id: r.score for r in score_texts(df, F.col("train"), head=head, part_tokens=n).collect()} for head, n in ((HEAD, 2000), (8, 2000), (1, 2000)))
    for got in (few, none):
        assert all(got[1000 + i] > got[2000 + i] / 3 for i in range(40))
        assert sum(got[k] for k in range(200)) > 1.25 * sum(whole[k] for k in range(200))


def test_words_beyond_the_head_teach_spelling(spark):
    rnd = random.Random(13)
    new = lambda: "".join(rnd.choices("abcdefghij", k=8))
    rows = [(i, " ".join(2 * [f"{new()}!!" for _ in range(20)]), True) for i in range(40)]
    tests = [[new() for _ in range(10)] for _ in range(20)]
    rows += [(k + i, " ".join(w + end for w in t), False) for k, end in ((1000, "!!"), (2000, "??")) for i, t in enumerate(tests)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in score_texts(df, F.col("train"), head=2).collect()}
    assert all(got[1000 + i] > got[2000 + i] + 10 for i in range(20))


def test_what_contexts_tell_of_words_adds_up():
    rnd = np.random.default_rng(3)
    context, word = rnd.integers(0, 5, 400).astype(np.uint64), rnd.integers(0, 30, 400).astype(np.uint64)
    longer = context << np.uint64(8) | rnd.integers(0, 3, 400).astype(np.uint64)
    # All words, known or not, in each context: what is told of the known ones, and what the others have left, is 1 in all.
    asked = [np.repeat(np.unique(longer), 31), np.tile(np.arange(31, dtype=np.uint64), len(np.unique(longer)))]
    pairs = [np.append(longer, asked[0]), np.append(context, asked[0] >> np.uint64(8))]
    training = np.arange(len(pairs[0])) < 400
    cost, told = beside_costs(pairs, np.append(word, asked[1]), np.ones(len(training), np.int64), training)
    for x in np.unique(longer):
        here = ~training & (pairs[0] == x)
        share = 2.0 ** -cost[here]
        near, far = (set(word[c == v].tolist()) for c, v in ((longer, x), (context, x >> np.uint64(8))))
        known = np.array([w in far for w in range(31)])
        assert (told[here] == known).all()
        # Words of the shorter context that the longer one has seen could be told by either; that share is lost.
        lost = [(word[context == x >> np.uint64(8)] == w).mean() for w in near]
        left = share[[w not in far for w in range(31)]][0]
        not_near = 1 - share[sorted(near)].sum()
        assert share[known].sum() + left == pytest.approx(1 - (not_near - left) * sum(lost), abs=1e-4)
    # A token that is learnt from doesn't see itself.
    alone, n = beside_costs([np.array([7, 7], np.uint64)], np.array([1, 2], np.uint64), np.ones(2, np.int64), np.ones(2, bool))
    assert not n.any() and (alone > 0).all() and beside_costs([np.array([7], np.uint64)], np.array([1], np.uint64), np.ones(1, np.int64), np.ones(1, bool))[0][0] == 0


def test_bits_in_unseen_contexts_are_mixed_and_learnt_from():
    # Code words of 17 bits; no context is seen twice, and the last four bits are ones.
    code = Code(pa.array([*(f"{k}" for k in range((1 << 17) - 2)), END]), np.ones((1 << 17) - 1, np.int64), 1)
    which, _, bit = code.path(np.arange(code.n))
    bits = bit[np.argsort(which, kind="stable")].reshape(code.n, 17)  # the last bit first
    symbol = np.repeat(np.flatnonzero(bits[:, :4].all(axis=1)), 8)
    alone = np.arange(len(symbol), dtype=np.uint64) << np.uint64(30)
    got = token_costs(code, symbol, alone, alone + np.uint64(1), np.ones(len(symbol), np.int64), np.ones(len(symbol), bool))
    assert len(symbol) == 1 << 16 and got.mean() < 16.9


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.filter("doc_id % 3 <> 0")
    got = quality_scores(docs, fit).join(labels.filter("doc_id % 3 = 0").withColumnRenamed("quality", "y"), "doc_id").toPandas()
    assert len(got) > 100 and ((got.quality > 0.5) == (got.y == 1)).mean() > 0.95
    assert (got[got.y == 1].kept).mean() > 0.97


def test_views_teach_each_other():
    rnd = np.random.default_rng(0)
    y = rnd.integers(0, 2, 3000).astype(float)
    view = lambda: np.stack([y * 2 - 1 + rnd.normal(0, 1.2, 3000), rnd.normal(size=3000)], axis=1)
    a, b = view(), view()
    model = co_train([a[:12], b[:12]], y[:12], [a[500:1500], b[500:1500]])
    both = model.combined([model.log_odds(0, a[1500:]), model.log_odds(1, b[1500:])])
    assert ((both > 0.5) == y[1500:]).mean() > 0.8


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(None if i == 3 else i, t, None if i % 2 else "en", "s", None, 0.1) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, quality double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (4, None), (None, 1), (99, 1)], "doc_id long, quality int")
    got = quality_scores(df, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.quality <= 1 for r in got)
    assert {r.quality for r in quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(df.limit(0), labels).count() == 0


def test_surest_rows_of_the_whole_pool(spark):
    # The surest rows are the last few of many; all of them are found, each id once.
    n = 2000
    vector = lambda *x: np.array(x, np.float16).tobytes()
    rows = [(i, vector(0), vector(i)) for i in range(n)] + [(n - 1, vector(0), vector(n - 1))]
    df = spark.createDataFrame(rows, "id long, content binary, metadata binary")
    flat, rising = Logistic(np.zeros(1), np.ones(1), np.zeros(2)), Logistic(np.zeros(1), np.ones(1), np.array([1.0, 0]))
    give = _distributed(df)
    for first in (n - 5, n - 10):
        got = give([flat, rising], {1.0: 5, 0.0: 5})
        assert {k: len(x) for k, x in got.items()} == {(0, 1.0): 5, (0, 0.0): 0, (1, 1.0): 0, (1, 0.0): 0}, first
    assert [c.cell_contents for c in give.__closure__ if isinstance(c.cell_contents, list) and isinstance(c.cell_contents[0], set)] == [[set(range(n - 10, n)), set()]]


def test_ties_among_the_surest_go_by_id(spark):
    vector = lambda *x: np.array(x, np.float16).tobytes()
    rows = [(i, vector(0), vector(3)) for i in reversed(range(600))] * 2
    flat, rising = Logistic(np.zeros(1), np.ones(1), np.zeros(2)), Logistic(np.zeros(1), np.ones(1), np.array([1.0, 0]))
    for parts in (1, 5):
        give = _distributed(spark.createDataFrame(rows, "id long, content binary, metadata binary").repartition(parts))
        for first in (0, 10):
            assert len(give([flat, rising], {1.0: 10})[0, 1.0]) == 10
            assert [c.cell_contents for c in give.__closure__ if isinstance(c.cell_contents, list) and isinstance(c.cell_contents[0], set)] == [[set(range(first + 10)), set()]]


def test_quality_against_one_process(spark):
    # The same rounds with all features in one place, ties by id.
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(4)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("doc_id % 3 = 0")
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("m0"), F.col("source").alias("m1"), F.col("n_chars").alias("m2"))
    made = features_of(rows, ["m0", "m1", "m2"]).withColumn("h", F.xxhash64("id")).toPandas().sort_values("id")
    y = {r.doc_id: float(r.quality) for r in labels.collect()}
    known, rest = made[made.id.isin(list(y))].sort_values(["h", "id"]), made[~made.id.isin(list(y))]
    matrix = lambda some, c: np.stack([np.frombuffer(x, np.float16) for x in some[c]]).astype(float)
    views = ("content", "metadata")
    model = co_train([matrix(known, c) for c in views], np.array([y[i] for i in known.id]), [matrix(rest, c) for c in views])
    want = dict(zip(made.id, model.combined([model.log_odds(v, matrix(made, c)) for v, c in enumerate(views)]), strict=True))
    got = {r.doc_id: r.quality for r in quality_scores(docs, labels).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_moving_weights_against_a_plain_loop():
    rnd = np.random.default_rng(11)
    mixer, inputs = Mixer(3), 3
    weights = {g: [0.0, 0.3, 0.7] for g in range(len(mixer.weights))}
    speed = {g: [1e-2] * inputs for g in weights}
    refine = Counter()
    squash = lambda z: 1 / (1 + math.exp(-min(20, max(-20, z))))
    step = lambda z: min(32, max(0, round(z * 2) + 16))
    for _ in range(25):
        n = 40
        x, gate = rnd.normal(0, 2, (n, inputs)).astype(np.float32), rnd.integers(0, len(weights), n)
        bit, weight = rnd.integers(0, 2, n), rnd.integers(0, 4, n).astype(float)
        z = mixer.mixed(x, gate)
        plain = [sum(float(x[i, j]) * weights[g][j] for j in range(inputs)) for i, g in enumerate(gate)]
        assert np.abs(z - plain).max() < 1e-4
        # Costs are those of the state before the batch is learnt from.
        cost = mixer.cost(z, gate, bit)
        for i, g in enumerate(gate):
            zero, one = refine[g, step(z[i]), 0], refine[g, step(z[i]), 1]
            p = min(1 - 1e-7, max(1e-7, (squash(z[i]) + (one + 20 * squash(z[i])) / (zero + one + 20)) / 2))
            assert abs(cost[i] + math.log2(p if bit[i] else 1 - p)) < 1e-4
        mixer.learn(x, z, gate, bit, weight)
        for i, g in enumerate(gate):
            refine[g, step(z[i]), bit[i]] += weight[i]
        for g in weights:
            own = [i for i in range(n) if gate[i] == g]
            total = max(1e-9, sum(weight[i] for i in own))
            for j in range(inputs):
                slope = sum(weight[i] * (bit[i] - squash(z[i])) * float(x[i, j]) for i in own) / total
                speed[g][j] += slope * slope
                weights[g][j] += 0.05 * slope / math.sqrt(speed[g][j])
    assert np.abs(mixer.weights - np.array([weights[g] for g in range(len(weights))])).max() < 1e-4
    assert sum(refine.values()) == mixer.refine.sum()
