"""Decontamination and near-duplicates against plain Python and their DuckDB twins."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from compare import assert_same
from loomery.llm import minhash, positional_index, registry
from loomery.llm.minhash import common_counts, components, near_duplicates, shingle_sets
from loomery.llm.plans import op2_positional_decontam, op8_oph_dedup
from loomery.llm.positional_index import build_index, contamination, positions_of, proximity_matches, steps_of, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_twins(spark, sf_dir):
    assert_same(spark, op2_positional_decontam.query, registry.oracle_sql()["op2_positional_decontam"], sf_dir)
    assert_same(spark, op8_oph_dedup.query, registry.oracle_sql()["op8_oph_dedup"], sf_dir)


def plain_hits(text, items, width=13):
    w, hit, found = words_of(text), set(), set()
    for name, t in items:
        iw = words_of(t)
        for at in range(max(1, len(iw) - width + 1) if iw else 0):
            g = iw[at : at + width]
            for p in range(len(w) - len(g) + 1):
                if w[p : p + len(g)] == g:
                    hit |= set(range(p, p + len(g)))
                    found |= {str(name)} - {"None"}
    return len(w), len(hit), sorted(found)


def test_contamination_of_odd_rows(spark):
    rnd = random.Random(1)
    text = lambda n, k: " ".join(rnd.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(1, text(20, 3)), (2, "A b"), (10, "a-b"), (3, None), (4, ""), (5, "..."), (6, text(13, 2)), (None, "a"), (7, "é1 Ü\x00x"), (8, text(14, 2)), (None, "q r"), (None, "h g")]
    docs = [(i, text(rnd.randint(0, 60), 3)) for i in range(40)] + [(40, None), (41, ""), (42, "!!"), (None, "a b"), (43, "É1 é1, ü"), (43, "x é1 Ü x"), (44, text(20, 3) + " " + items[0][1] * 3), (45, "a b " * 3000), (46, "q r s"), (47, "x " * 200_000 + "h g")]
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(*x, "n") for x in items], "item_id long, text string, spans string")
    for kw in ({}, {"block_words": 15}, {"segment_bytes": 50}):
        got = contamination(d, b, **kw).collect()
        want = sorted(repr((i, n, k, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), 20 * k >= n and k > 0)) for i, t in docs for n, k, f in [plain_hits(t, items)])
        assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got) == want, kw
    assert got and {r.n_hit for r in got if r.doc_id in (46, 47)} == {2}  # an item without an id
    inner = d.withColumns({c: F.lit(1) for c in ("segment", "place", "spans", "items", "id", "terms", "steps")})
    assert contamination(inner, b.withColumn("items", F.lit(1))).count() == len(docs)
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).filter("contaminated or n_hit > 0").count() == 0


def plain_near(docs, items, slop, width=13):
    w = {k: words_of(t) for k, (_, t) in enumerate(docs)}
    counts = {}
    for x in w.values():
        for t in x:
            counts[t] = counts.get(t, 0) + 1
    out = {}
    for k, x in w.items():
        found = set()
        for name, t in items:
            iw = words_of(t)
            for at in range(max(1, len(iw) - width + 1) if iw else 0):
                terms = set(iw[at : at + width])
                if all(y in counts for y in terms):
                    anchor = min(terms, key=lambda y: (counts[y], y))
                    if any(y == anchor and all(z in x[max(0, p - slop) : p + slop + 1] for z in terms) for p, y in enumerate(x)):
                        found |= {str(name)} - {"None"}
        out[k] = len(found)
    return out


def test_windows_nearby(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    items = [(1, text(14)), (2, "a b c"), (3, "z z z"), (4, None), (5, "q nowhere"), (None, "x y"), (6, text(30))]
    shuffled = lambda t: " ".join(rnd.sample(t.split(), len(t.split())))
    docs = [(i, text(rnd.randint(0, 40))) for i in range(40)] + [(40, None), (41, "c - b ... a"), (42, shuffled(items[0][1])), (43, shuffled(items[6][1]) * 2), (44, "a " + "- w " * 8 + "b c"), (45, "z"), (45, "c b a"), (None, items[0][1])]
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, k int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for slop in (3, 8, 26):
        want = plain_near(docs, items, slop)
        for kw in ({}, {"segment_bytes": 60}, {"block_words": 1000}):
            got = {r.k: (r.n_near_items, r.n_items) for r in contamination(d, b, slop=slop, id_col="k", **kw).collect()}
            assert {k: n for k, (n, _) in got.items()} == want, (slop, kw)
        assert max(want.values()) > 0
    many = contamination(d, b, slop=8, id_col="k", block_words=10).collect()
    assert {r.k: r.n_near_items for r in many} == plain_near(docs, items, 8)
    with pytest.raises(ValueError):
        contamination(d, b, slop=100)


def test_index_is_held_a_few_segments_at_a_time(spark, monkeypatch):
    rnd = random.Random(8)
    names = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(20_000)]
    d = spark.createDataFrame([(i, " ".join(rnd.choices(names, k=150_000))) for i in range(32)], "doc_id long, text string").coalesce(1)
    plain, built = positional_index._segments, positional_index.build_index

    def small(batches):
        for batch in batches:
            assert batch.nbytes < 12 << 20, batch.nbytes
            yield from plain([batch])

    def measured(*args):
        index = built(*args)
        files = [pq.ParquetFile(f).metadata for f in index.inputFiles()]
        groups = [f.row_group(k) for f in files for k in range(f.num_row_groups)]
        assert sum(g.num_rows for g in groups) >= 32 and max(g.total_byte_size for g in groups) < 24 << 20
        return index

    monkeypatch.setattr(positional_index, "_segments", small)
    monkeypatch.setattr(positional_index, "build_index", measured)
    b = spark.createDataFrame([(1, d.first().text[: 7 * 13 - 1])], "item_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = {r.doc_id: r.n_hit for r in contamination(d, b, segment_bytes=1 << 20, slop=26).collect()}
    assert len(got) == 32 and got[0] == 13 and not any(v for k, v in got.items() if k)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x a y y b z"), (2, "b a"), (3, "a q q q q b"), (4, None), (5, "a"), (6, "b")], "doc_id long, text string")
    index = build_index(d)
    got = {(r.id, r.item) for r in proximity_matches(index, [("ab", ["a", "b"]), ("zz", ["z", "nowhere"])], 3).collect()}
    assert got == {(1, "ab"), (2, "ab")}
    assert {t for r in index.select("terms").collect() for t in r.terms} == {"x", "a", "y", "b", "z", "q"}


def test_positions_come_back():
    rnd = np.random.default_rng(0)
    lists = [np.sort(rnd.choice(1 << 22, n, replace=False)) for n in (1, 5, 1000, 3)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    assert positions_of(steps_of(np.concatenate(lists), offsets), offsets).tolist() == np.concatenate(lists).tolist()
    assert positions_of(steps_of(np.zeros(0, np.int64), np.array([0])), np.array([0])).tolist() == []


def plain_components(docs, width, percent):
    def sets(t):
        w = [x.lower() if x.isascii() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    s = [(i, sets(t)) for i, t in docs]
    root = {i: i for i, _ in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(s, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: (len(a), find(i)) for i, a in s}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_against_all_pairs(spark, width, percent):
    rnd = random.Random(width)
    vocabulary = [f"w{i}é" for i in range(300)]
    docs, at = [], 0
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 4, 8, 30, 200]))]
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            docs.append((at, " ".join(w)))
            at += 1
    # A chain whose ends are far apart, and odd texts.
    chain = [f"c{i}" for i in range(120)]
    docs += [(1000 + k, " ".join(chain[k * 3 : k * 3 + 90])) for k in range(8)]
    docs += [(2000, None), (2001, ""), (2002, " \n"), (2003, "A B"), (2004, "a\tb"), (2005, "a b c"), (2006, "z " * 5000), (2007, "Z " * 4000), (2008, "x" * 100_000)]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, id string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, width, percent).collect()}
    assert got == plain_components(docs, width, percent)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == [(-1, None, True), (-1, None, True), (2, 2, True), (2, 2, True), (3, 2, False), (9, 9, True)]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 3, 5])
def test_shingles_of_few_words(width):
    for texts in (["a b"], ["a b c"], [""], [], ["a"], ["a b", "A  B", "b a"], ["x" * 3_000_000, "y " * 300_000], ["a b c d e f g", "", "a"]):
        h, doc = shingle_sets(pa.array(texts, pa.string()), width)
        got = [frozenset(h[doc == k]) for k in range(len(texts))]
        assert [len(x) for x in got] == [n for n, _ in plain_components(list(enumerate(texts)), width, 80).values()]
        if len(texts) == 3 and texts[0] == "a b":
            assert got[0] == got[1] and (width == 1 or got[0] != got[2])


def test_one_short_text_with_clashing_columns(spark):
    df = spark.createDataFrame([(0, "a b", 1)], "doc_id long, text string, k1 long")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("id", "n", "key", "component", "salt", "final", "kept", "n_shingles")})
    assert [(r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, 5).collect()] == [(1, 0, True)]


def test_ids_of_several_texts(spark):
    # One id is one node; a repeated row and a null id change nothing.
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (3, c), (3, c), (None, a), (4, c + " d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(df).collect()) == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3)]


def test_components_of_long_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 400), (300, 300)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[500] == 400


def test_planted_pairs_in_a_large_family(spark):
    # Members share a template (similarity of about 0.74); the two of a planted pair share half of their own words too (about 0.86).
    rnd = random.Random(5)
    template, docs = [f"t{i}" for i in range(240)], []
    for k in range(1500):
        slots = rnd.sample(range(2, 238, 4), 9)
        for half in range(2 if k % 4 == 0 else 1):
            w = list(template)
            for n, at in enumerate(slots[:3] + slots[3 + 3 * half : 6 + 3 * half]):
                w[at] = f"m{k}x{n}" if n < 3 else f"m{k}h{half}x{n}"
            docs.append((2 * k + half, " ".join(w)))
    rnd.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # By construction: each pair differs in 18 of 238 shingles, others in about 36.
    got = {r.doc_id: r.component_id for r in near_duplicates(df, 3, 85).collect()}
    assert [i for i, _ in docs if got[i] != i - i % 2] == []


def test_family_of_two_thousand_keeps_its_planted_pairs(spark):
    # 1,000 pairs of 0.85 and more among 2,000 documents that are about 0.75 alike.
    rnd = random.Random(9)
    template, docs = [f"t{i}" for i in range(200)], []
    for k in range(1000):
        own = {at: f"m{k}x{at}" for at in rnd.sample(range(200), 10)}
        for half in range(2):
            w = [own.get(i, t) for i, t in enumerate(template)]
            for at in rnd.sample(range(200), 2):
                w[at] = f"h{k}{half}x{at}"
            docs.append((2 * k + half, " ".join(w)))
    sets = {i: {tuple(t.split()[at : at + 3]) for at in range(198)} for i, t in docs}
    linked = [i for i in range(0, 2000, 2) if 100 * len(sets[i] & sets[i + 1]) >= 85 * len(sets[i] | sets[i + 1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df, 3, 85).collect()}
    assert len(linked) > 900 and [i for i in linked if got[i] != got[i + 1]] == []


def test_common_counts_by_both_ways():
    rnd = np.random.default_rng(3)
    # Every other hash is in nearly all sets, the rest in few.
    sets = [np.unique(np.concatenate([rnd.choice(40, 35, replace=False), 100 + rnd.integers(0, 5000, 60)])).astype(np.uint64) for _ in range(90)]
    a, b = sets[:50], sets[50:]
    flat = lambda some: (np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some]), len(some))
    got = common_counts(*flat(a), *flat(b))
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_members_of_a_bucket_are_dealt_in_packed_blocks(spark):
    # 3,000 members in one bucket: a row for each block and pair, not for each member and block.
    members = spark.range(3000).selectExpr("7L as key", "0 as band", "id", "10L as n", "id as component")
    got = minhash._dealt(members, spark.createDataFrame([(7, 3000, 30000)], "key long, m long, total long"), 512).collect()
    assert len(got) == 36
    for i, j in itertools.combinations_with_replacement(range(6), 2):
        assert sorted(r.s for r in got if (r.i, r.j) == (i, j)) == sorted({i, j})
    assert sorted(m.id for r in got if r.i == r.j for m in r.members) == list(range(3000))


def test_many_small_blocks_change_no_component(spark, monkeypatch):
    # Tiles of 3 and blocks of 7 while sketches are compared; a chain and a family within few buckets.
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 3)
    monkeypatch.setattr(minhash, "SIFTED_MEMBERS", 7)
    rnd = random.Random(8)
    template, docs = [f"t{i}" for i in range(150)], []
    for k in range(40):
        own = {at: f"m{k}x{at}" for at in rnd.sample(range(150), 7)}
        for half in range(2):
            w = [own.get(i, t) for i, t in enumerate(template)]
            w[rnd.randrange(150)] = f"h{k}{half}"
            docs.append((2 * k + half, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()}
    assert got == plain_components(docs, 3, 85)
