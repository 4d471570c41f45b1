"""The divergence audit against plain counting, and the query against SQL."""

import random
import re
from collections import Counter, defaultdict

from compare import assert_same

from loomery.llm.divergence import source_divergence
from loomery.llm.plans import op13_source_divergence

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, most):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERMS.findall((text or "").translate(lower))
        docs[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        sources = [s for x, s in counts if x == lang]
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pair = [(other, sum(abs(p[s][t] - p[other][t]) for t in kept)) for other in sources if other != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, cut in (("pair", pair, None), ("term", term, most)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:cut]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, lang, s, t, 1, "x") for k, (lang, s, t) in enumerate(rows)], "doc_id int, lang string, source string, text string, term int, n string").repartition(5)


def test_against_plain_counting(spark):
    rnd = random.Random(2)
    names = ["the", "The", "étÉ", "x9y", "日本", "a-b", "Z", "ﬁn", "q", "r"]
    rows = [(rnd.choice(["en", "de", None, ""]), rnd.choice(["s1", "s2", "s3", "ü", None]), " ".join(rnd.choices(names, k=rnd.randrange(12)))) for _ in range(400)]
    rows += [("xx", "lone", "word"), ("yy", "a", None), ("yy", "b", ""), ("en", "empty", None), ("en", "long", "the " * 50_000), *[("en", "s1", "the same text")] * 5, (None, None, None)]
    for shards in (1, 4):
        got = source_divergence(frame(spark, rows), min_docs=8, most=3, shards=shards)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, 8, 3)


def test_large_counts_stay_exact(spark):
    rows = [("en", "a", "x " * 300_000 + "y"), ("en", "b", "y " * 7)] * 2
    got = source_divergence(frame(spark, rows), min_docs=1)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 1, 50)


def test_empty_table_and_no_kept_terms(spark):
    assert source_divergence(frame(spark, [])).count() == 0
    rows = [("en", "a", "x"), ("en", "b", "y")]
    assert sorted(tuple(r) for r in source_divergence(frame(spark, rows)).collect()) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_query_equals_sql(spark, sf):
    assert assert_same(spark, op13_source_divergence.query, op13_source_divergence.SQL, sf) > 100
    assert assert_same(spark, op13_source_divergence.query, op13_source_divergence.SQL, "/root/testdata/sf0.01") > 1000
